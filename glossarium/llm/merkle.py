"""A Merkle manifest of a dataset: a tree of hashes for each group, a tree of the groups' roots, and every row's proof."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, table

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A hash as text, and what stands in a path where a node has no sibling.
DIGEST, NONE = 64, " " * 64


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts' text in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A null as ``-``, else the number of its UTF-8 bytes, ``:``, and the text itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: Column) -> Column:
    """Text that orders groups as they should be: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes with their place (``i``, from 0) in their group ``g`` by ``order``, and the size of the group (``n``).

    Rows are sorted by range, which splits a group of any size, and numbered within a part; the sizes of the parts before,
    a row for each part and group, are added.
    """
    at = F.monotonically_increasing_id()
    parts = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    parts = stored(parts.withColumn("part", F.spark_partition_id()).withColumn("at", at), "sorted")
    sizes = parts.groupBy("part", "g").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("size"))
    one = Window.partitionBy("g")
    before = F.sum("size").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", "g", "from", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(one).alias("n"))
    return parts.join(sizes, ["part", "g"]).withColumn("i", F.col("at") - F.col("from") + F.col("before")).drop("part", "at", "from", "before")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all groups, leaves (g, i, n, hash) first.

    A level has for each node its group, index, the group's nodes at this level (n), hash, its sibling (blanks if it has
    none) and whether that stands before (L) or after it (R; - if none). A window by group and parent's index gives the
    hashes of a run in order, which make the parent and are each other's siblings; a run's first node stands for it at the
    next level. A group's only node goes no further.
    """
    run = Window.partitionBy("g", F.shiftright("i", 1)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    odd = F.col("i") % 2 == 1
    levels, height = [], max(0, (leaves.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    level = leaves
    for _ in range(height):
        level = level.withColumn("run", F.collect_list("hash").over(run))
        level = level.withColumns({
            "side": F.when(F.col("n") == 1, None).when(odd, "L").when(F.size("run") > 1, "R").otherwise("-"),
            "sibling": F.when(F.size("run") > 1, F.when(odd, F.col("run")[0]).otherwise(F.col("run")[1])).otherwise(NONE),
            "parent": F.when(F.col("n") > 1, digest(F.array_join("run", ""))),
        }).drop("run")
        level = stored(level, "level")
        levels.append(level.drop("parent"))
        level = level.where(~odd & (F.col("n") > 1)).select("g", F.shiftright("i", 1).alias("i"), F.ceil(F.col("n") / 2).alias("n"), F.col("parent").alias("hash"))
    levels.append(level.withColumns({"side": F.lit(None).cast("string"), "sibling": F.lit(NONE)}))
    return levels


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``sides`` and ``siblings`` of each on its way up, NONE where there is no sibling, and what ``tops``
    (g, sides, siblings and more) say of the group's root. A node has what its parent has, after its own."""
    own = ("sides", "siblings")
    more = [c for c in tops.columns if c not in ("g", *own)]
    above = None
    for level in reversed(levels):
        rest = [c for c in level.columns if c not in ("side", "sibling")]
        here = level.where("side is null").join(tops, "g").select(*rest, *own, *more)
        if above is not None:
            up = above.select("g", F.col("i").alias("above"), *own, *more)
            inner = level.where("side is not null").withColumn("above", F.shiftright("i", 1)).join(up, ["g", "above"])
            joined = {"sides": F.concat("side", "sides"), "siblings": F.concat("sibling", "siblings")}
            here = here.unionByName(inner.withColumns(joined).select(*rest, *own, *more))
        above = here
    return above


def folded(leaf: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings on the way up give."""

    def step(acc: Column, k: Column) -> Column:
        side, sibling = F.substr(sides, k + 1, F.lit(1)), F.substr(siblings, k * DIGEST + 1, F.lit(DIGEST))
        return digest(F.when(side == "L", F.concat(sibling, acc)).when(side == "R", F.concat(acc, sibling)).otherwise(acc))

    steps = F.when(F.length(sides) > 0, F.sequence(F.lit(0), F.length(sides) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, leaf, step)


def manifest(rows: DataFrame, fields: tuple[str, ...], group: str, order: str, changed: dict[str, Column], where: Column) -> DataFrame:
    """A row for each row: ``order``, leaf, subroot of its group, root, proof_sha256 (the hash of its siblings on the way to
    the root), folded_root (from the row as it is with ``changed`` columns ``where`` that holds, and its original siblings)
    and verified.

    A null is a value of its own in every field; rows whose group is null are a group, the first. Rows without ``order``
    come first in their group; rows that are alike in it are ordered by their leaf, so equal rows have leaves next to each
    other. Empty and very long texts are hashed whole. An empty table gives none; further columns are not read. A group of
    any size is numbered and hashed by many tasks.
    """
    now = digest(*(field(F.col(c)) for c in fields))
    then = F.when(where, digest(*(field(changed.get(c, F.col(c))) for c in fields))).otherwise(now)
    leaves = stored(rows.select(F.col(order).alias("id"), group_key(F.col(group)).alias("g"), now.alias("hash"), then.alias("then")), "leaves")
    low = tree(stored(numbered(leaves, "id", "hash"), "numbered"))
    roots = stored(reduce(DataFrame.unionByName, [x.where("side is null").select("g", "hash") for x in low]), "subroots")
    high = tree(stored(numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("id"), "hash"), "id"), "numbered"))
    root = stored(reduce(DataFrame.unionByName, [x.where("side is null").select("g", F.col("hash").alias("root")) for x in high]), "root")
    tops = root.withColumns({"sides": F.lit(""), "siblings": F.lit("")})
    tops = stored(paths(high, tops).select(F.col("id").alias("g"), F.col("hash").alias("subroot"), "root", "sides", "siblings"), "tops")
    release(rows.sparkSession)
    proven = stored(paths(low, tops), "paths")
    out = proven.withColumns({"proof_sha256": digest(F.replace("siblings", F.lit(" "), F.lit(""))), "folded_root": folded(F.col("then"), F.col("sides"), F.col("siblings"))})
    return out.select(F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return manifest(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", more, touched)


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(changed: dict[str, str]) -> str:
    return "sha256(" + " || ".join(_field_sql(changed.get(c, c)) for c in FIELDS) + ")"


_WALK = "CASE WHEN s.h IS NULL THEN sha256(acc) WHEN f.i % 2 = 0 THEN sha256(acc || s.h) ELSE sha256(s.h || acc) END, sibs || coalesce(s.h, '')"
#: CRC-32 of the decimal id, byte by byte by its table, is all that is not plain SQL.
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
rows AS (SELECT *, coalesce('=' || lang, '') AS g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 7 = 0 AS touched FROM documents, crc),
leaves AS (SELECT doc_id, g, h, CASE WHEN touched THEN th ELSE h END AS th, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, g, touched, {_leaf_sql({})} AS h, {_leaf_sql({"n_chars": "(n_chars::HUGEINT + 1)"})} AS th FROM rows)),
low AS (SELECT 0 AS lvl, g, i, n, h FROM leaves UNION ALL SELECT lvl + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lvl + 1, g, i // 2, (n + 1) // 2),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, i, n, h FROM subroots UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl + 1, i // 2, (n + 1) // 2),
up AS (SELECT doc_id, g, i, n, 0 AS lvl, h AS leaf, th AS acc, '' AS sibs FROM leaves
  UNION ALL SELECT doc_id, f.g, f.i // 2, (f.n + 1) // 2, f.lvl + 1, leaf, {_WALK} FROM up f LEFT JOIN low s ON s.lvl = f.lvl AND s.g = f.g AND s.i = xor(f.i, 1) WHERE f.n > 1),
top AS (SELECT doc_id, r.i, r.n, 0 AS lvl, leaf, r.h AS subroot, acc, sibs FROM up JOIN subroots r USING (g) WHERE up.n = 1
  UNION ALL SELECT doc_id, f.i // 2, (f.n + 1) // 2, f.lvl + 1, leaf, subroot, {_WALK} FROM top f LEFT JOIN high s ON s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT doc_id, leaf, subroot, x.h AS root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = x.h AS verified FROM top, (SELECT h FROM high WHERE n = 1) x WHERE top.n = 1
"""
