"""Line dedup by an exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text, stored, table

THRESHOLD = 0.8
#: Buckets of token counts; a token's rarity is the count of its bucket. Any order of tokens gives the same result,
#: a better one fewer candidates.
BUCKETS = 1 << 17


def _spaced(text: Column, more: str = "") -> Column:
    """The lower-cased text with a space for every tab, VT, FF, CR and each of ``more``. Few texts hold one of the former, and
    looking for them costs less than replacing them."""
    odd = "\t\x0b\f\r"
    spaces = lambda out, chars: reduce(lambda o, c: F.replace(o, F.lit(c), F.lit(" ")), chars, out)
    plain = F.lower(text)
    return spaces(F.when(reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in odd]), spaces(plain, odd)).otherwise(plain), more)


def _hashes(spaced: Column) -> Column:
    """Hashes of the tokens of a line of ``_spaced`` text: lower-cased runs without white space."""
    hashes = F.transform(F.split(spaced, " "), lambda t: F.xxhash64(t))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * threshold - 1e-9).cast("int")


def rarity_levels(docs: DataFrame) -> Column:
    """Number of bits of the count of each bucket of token hashes over all lines, as a literal array of bytes: its size is fixed,
    whatever the corpus. Bytes, as the driver keeps the array in every plan that has it."""
    words = F.split(_spaced(F.col("text"), "\n"), " ")
    tokens = doc_text(docs).select(F.explode(words).alias("token"))
    counts = tokens.groupBy(F.xxhash64("token").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("k")).count()
    levels = [0] * BUCKETS
    for r in counts.collect():
        levels[r["k"]] = int(r["count"]).bit_length()
    return F.from_json(F.lit(json.dumps(levels, separators=(",", ":"))), "array<tinyint>")


def _ordered(line: Column, levels: Column) -> Column:
    """A line's distinct tokens, the rarest first: level in the upper 8 bits, hash below."""
    # never null, as arrays that can hold nulls are sorted by a comparator
    level = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), F.lit(0).cast("long"))
    key = lambda h: F.shiftleft(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(F.array_distinct(_hashes(line)), key))


def _parity(t: Column, half: bool) -> Column:
    """A word of bits, each the parity of the number of tokens that fall on it: of all tokens, or of those of one half. With
    the word of the other half, which the two give, every token turns one bit of 128."""
    one = (lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(1))) if half else (lambda h: F.lit(1).cast("long"))
    return F.aggregate(t, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", one(h), h.bitwiseAND(F.lit(63)).cast("int"))))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """The lines of the ``_spaced`` text, which is made once for all lines of a text."""
    return doc_text(docs).select("doc_id", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line_no", "line"))


def line_classes(docs: DataFrame, levels: Column, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each distinct set of tokens: where it comes first (doc_id, line_no), its size, its bits of parity and
    its prefix."""
    lines = numbered_lines(docs).where(F.rlike("line", F.lit(r"\S")))
    lines = lines.select("doc_id", "line_no", _ordered(F.col("line"), levels).alias("t"))
    lines = lines.select("doc_id", "line_no", F.size("t").alias("n"), "t")
    prefix = F.slice("t", F.lit(1), F.col("n") - _needed(F.col("n"), threshold) + 1)
    keyed = lines.select(F.xxhash64("t").alias("k1"), F.xxhash64("t", F.lit(1)).alias("k2"), "n", F.struct("doc_id", "line_no").alias("at"), prefix.alias("prefix"), _parity(F.col("t"), False).alias("s0"), _parity(F.col("t"), True).alias("s1"))
    first = keyed.groupBy("k1", "k2", "n").agg(F.min("at").alias("at"), F.first("s0").bitwiseXOR(F.first("s1")).alias("s0"), F.first("s1").alias("s1"), F.first("prefix").alias("prefix"))
    return first.select(F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no"), "n", "s0", "s1", "prefix")


def _alike(a: str, b: str, threshold: float) -> Column:
    """The length filter and a bound by parity: every token that only one of two sets has turns one bit, so they differ in
    at least as many tokens as in bits."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    turned = sum(F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("s0", "s1"))
    return (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (turned <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _first_shared(a: str, b: str, threshold: float) -> Column:
    """The positional filter of two prefixes at the first token that they share: before it they share none, so what is left
    of either must hold all that they share. Two alike sets pass it at their first shared token at least."""
    na, nb, pa, pb = (F.col(f"{x}{c}") for c in ("n", "pos") for x in (a, b))
    return F.least(na - pa, nb - pb) >= F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)


def _place(side: str) -> Column:
    return F.struct(F.col(f"{side}doc_id").alias("doc_id"), F.col(f"{side}line_no").alias("line_no"))


def _led(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of rows b and the first row a of their token, if alike and the token has more than CROWD rows: no pair need be
    found here, and tokens of few rows give few pairs in any case."""
    columns = ("doc_id", "line_no", "n", "s0", "s1")
    crowds = rows.groupBy("token").count().where(F.col("count") > CROWD).select("token")
    rows = stored(rows.join(crowds, "token", "left_semi"), "line_crowds")
    lead = rows.groupBy("token").agg(F.min(F.struct(*columns)).alias("l")).select("token", "l.*").alias("a")
    both = lead.join(rows.alias("b"), F.col("a.token") == F.col("b.token"))
    return both.where((_place("a.") < _place("b.")) & _alike("a.", "b.", threshold)).select(_place("a.").alias("a"), _place("b.").alias("b")).distinct()


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of rows that share a prefix token, b not matched yet (``open``) and seen after a, past the filters."""
    both = rows.drop("open").alias("a").join(rows.where("open").alias("b"), F.col("a.token") == F.col("b.token"))
    return both.where((_place("a.") < _place("b.")) & _first_shared("a.", "b.", threshold) & _alike("a.", "b.", threshold)).select(_place("a.").alias("a"), _place("b.").alias("b")).distinct()


def _matched(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The later ends b of the pairs (a, b) whose whole token sets have a Jaccard similarity of the threshold."""
    pairs = stored(pairs, "line_pairs")
    places = pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).distinct()
    per_doc = stored(places.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_set("at.line_no").alias("wanted")), "wanted")
    per_doc = per_doc.withColumnRenamed("doc_id", "_doc")
    lines = doc_text(docs).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "wanted", F.split(_spaced(F.col("text")), "\n").alias("parts"))
    found = F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.get("parts", i).alias("line")))
    lines = lines.select("doc_id", F.explode(found).alias("l")).select("doc_id", "l.line_no", "l.line")
    sets = stored(lines.select(F.struct("doc_id", "line_no").alias("at"), F.array_distinct(_hashes(F.col("line"))).alias("t")), "line_sets")
    both = pairs.join(sets.select(F.col("at").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("at").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return stored(both.where(common >= (F.size("ta") + F.size("tb") - common) * threshold - 1e-9).select("b").distinct(), "matched")


#: Of tokens one in LEADERS looks for its first row's likes before all tokens do; short prefixes have all tokens looking.
LEADERS, SHORT = 2, 8
#: Rows of a token from which on they meet its first row before they meet each other.
CROWD = 256
#: Parts of the tokens that join one after the other, so that the shuffles of one part at a time lie on disk.
PARTS = 3


def _all_candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """``_candidates`` of all tokens, a part of them at a time. A pair is found where the first token it shares is, so parts
    lose none."""
    found = [stored(_candidates(rows.where(F.pmod("token", F.lit(PARTS)) == k), threshold), "line_candidates") for k in range(PARTS)]
    return reduce(DataFrame.unionByName, found).distinct()


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, the text that is left, and the columns ``more`` of each row as they are.

    Lines are cut at newlines; a line's set is its distinct tokens (lower-cased runs without white space). A line
    goes if any line before it, by (doc_id, line number), has a set with a Jaccard similarity of ``threshold`` or
    more; lines of white space stay. The join is exact: lines of equal sets are one class, a class lists the prefix
    of its tokens in order of rarity, classes that share a prefix token and pass the length and positional filters,
    and a bound by bits of parity that loses no pair, are verified. For some tokens of many classes every class first meets
    the token's first class only; classes matched so need no further candidates, so a great group of alike lines does not
    give all its pairs. Then all tokens join.

    Null and empty texts have one empty line and keep it; of rows with the same doc_id the lines count as the same
    places, in each of them; rows without doc_id come before all others, as one; an empty table gives none; further
    columns are not read.
    """
    levels = rarity_levels(docs)
    classes = stored(line_classes(docs, levels, threshold), "line_classes")
    some = classes.withColumn("few", F.size("prefix") <= SHORT).select("doc_id", "line_no", "n", "s0", "s1", "few", F.posexplode("prefix").alias("pos", "token"))
    first = _matched(_led(some.where(F.col("few") | (F.col("token") % LEADERS == 0)).drop("few", "pos"), threshold), docs, threshold)
    known = first.select(F.col("b.doc_id").alias("_d"), F.col("b.line_no").alias("_l"))
    marked = classes.join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line_no") == F.col("_l")), "left")
    marked = stored(marked.select("doc_id", "line_no", "n", "s0", "s1", F.col("_l").isNull().alias("open"), "prefix"), "line_marked")
    rows = marked.select("doc_id", "line_no", "n", "s0", "s1", "open", F.posexplode("prefix").alias("pos", "token"))
    second = _matched(_all_candidates(rows, threshold), docs, threshold)
    gone = first.unionByName(second).select(F.col("b.doc_id").alias("_d"), F.col("b.line_no").alias("_l"))
    kept = classes.select("doc_id", "line_no").join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line_no") == F.col("_l")), "left_anti")
    per_doc = kept.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set("line_no")).alias("kept"))
    out = doc_text(docs, *more).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", *more, F.split("text", "\n").alias("parts"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    blank = lambda s: ~F.rlike(s, F.lit(r"\S"))
    left = F.filter("parts", lambda s, i: F.array_contains("kept", i) | blank(s))
    return out.select("doc_id", *more, F.size("parts").alias("n_lines"), left.alias("left")).select(
        "doc_id", *more, "n_lines", (F.col("n_lines") - F.size("left")).alias("n_removed"), F.array_join("left", "\n").alias("text")
    )


def op3_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
