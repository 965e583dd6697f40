"""Comparison of corpora: keys, coverage, exact and fuzzy alignment, differences, matches, clusters and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .graph import components


def effective(field: str, columns: list[str]) -> Column:
    """The edited value if it is not blank, else the raw one, stripped."""
    options = [T.nonblank(F.col(c)) for c in (f"{field}_edit", f"{field}_raw") if c in columns]
    return T.strip(F.coalesce(*options, F.lit("")))


def with_key(entries: DataFrame, key_field: str = "headword_norm_effective") -> DataFrame:
    cols = entries.columns
    names = {"headword_norm_effective": ("headword_norm", "form_norm"), "form_norm_effective": ("form_norm",)}.get(key_field)
    if names is None:
        names = (key_field,) if key_field in cols else ()
    options = [T.nonblank(F.col(c)) for c in names if c in cols]
    return entries.withColumn("headword_key", T.normalized_key(F.coalesce(*options, effective("headword", cols))))


def first_per_key(keyed: DataFrame, corpus: str = "dict_id") -> DataFrame:
    """The first entry of each corpus and key by (line_no, entry_id); an aggregate, so a frequent key combines early."""
    rest = [c for c in keyed.columns if c not in (corpus, "headword_key", "line_no", "entry_id")]
    first = F.min_by(F.struct("line_no", "entry_id", *rest), F.struct("line_no", "entry_id")).alias("e")
    return keyed.where("headword_key <> ''").groupBy(corpus, "headword_key").agg(first).select(corpus, "headword_key", "e.*")


def coverage(keyed: DataFrame, corpora: list[str], corpus: str = "dict_id") -> DataFrame:
    """headword_key and a column in_<corpus> for each corpus."""
    has = [F.max(F.col(corpus) == c).alias(f"in_{c}") for c in corpora]
    return keyed.where(F.col(corpus).isin(*corpora) & (F.col("headword_key") != "")).groupBy("headword_key").agg(*has)


def coverage_filter(mode: str, corpora: list[str]) -> Column:
    a, b = (F.col(f"in_{c}") for c in corpora[:2])
    all_, n = F.lit(True), F.lit(0)
    for c in corpora:
        all_, n = all_ & F.col(f"in_{c}"), n + F.col(f"in_{c}").cast("int")
    return {
        "common_all": all_, "only_a": a & (n == 1), "only_b": b & (n == 1), "a_not_b": a & ~b, "b_not_a": b & ~a,
    }.get(mode, F.lit(True))


def coverage_counts(covered: DataFrame, corpora: list[str]) -> DataFrame:
    count = lambda mode, name: F.count_if(coverage_filter(mode, corpora)).alias(name)
    return covered.agg(F.count(F.lit(1)).alias("union_count"), count("common_all", "common_all"), count("only_a", "unique_a"), count("only_b", "unique_b"))


def align_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each key that both have, of first entries per key."""
    x = a.select("headword_key", F.col("entry_id").alias("entry_id_a"))
    y = b.select("headword_key", F.col("entry_id").alias("entry_id_b"))
    return x.join(y, "headword_key")


#: Characters of a segment at least, for keys to meet on segments. Else on combinations of so many signs, as long as keys have
#: no more edits than this; of one sign beyond.
SEGMENT, SIGNS = 3, ((3, 8), (2, 14))


def _needed(m: Column, n: Column, t: float) -> Column:
    """Characters that two keys of these lengths must have in common, in order, for a ratio of ``t``."""
    return F.ceil((m + n) * t / 200 - 1e-9).cast("int")


def _partners(keys: DataFrame, own: str, other: str, t: float) -> DataFrame:
    """A row for each length that a partner can have."""
    n = F.col(own)
    low, high = F.ceil(n * t / (200 - t) - 1e-9).cast("int"), F.floor(n * (200 - t) / t + 1e-9).cast("int")
    return keys.withColumn(other, F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))


def _with_edits(rows: DataFrame, t: float) -> DataFrame:
    """Rows with lengths na and nb: the most edits between such keys, and whether they meet on segments of kb."""
    rows = rows.withColumn("edits", F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), t))
    return rows.withColumn("by_segment", F.floor(F.col("nb") / (F.col("edits") + 1)) >= SEGMENT)


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each of edits + 1 segments of kb: number (i), start (from 0) and length, as even as can be."""
    parts = F.col("edits") + 1
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start = lambda i: F.floor(i * F.col("nb") / parts).cast("int")
    return rows.withColumns({"start": start(F.col("i")), "size": start(F.col("i") + 1) - start(F.col("i"))})


def _on_segments(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by the segments they can meet on.

    So many edits leave one of edits + 1 segments of kb untouched. Going through the segments there is a first one that is
    untouched and has as many edits before it as segments; so it stands in ka shifted by that number at most, and what
    is left of the shift between the ends by the number of segments after it.
    """
    y = _segments(right).select("kb", "nb", "na", "bits", "i", F.substr("kb", F.col("start") + 1, "size").alias("part"))
    x = _segments(left)
    i, rest, gap = F.col("i"), F.col("edits") - F.col("i"), F.col("na") - F.col("nb")
    first, last = F.greatest(-i, gap - rest, -F.col("start")), F.least(i, gap + rest, F.col("na") - F.col("start") - F.col("size"))
    x = x.withColumns({"first": first, "last": last}).where("first <= last").withColumn("shift", F.explode(F.sequence("first", "last")))
    return x.select("ka", "na", "nb", "bits", "i", F.substr("ka", F.col("start") + F.col("shift") + 1, "size").alias("part")), y


def _on_signs(rows: DataFrame, key: str, own: str, t: float) -> DataFrame:
    """A row for each combination of signs that keys can meet on.

    At most ``own`` - needed characters of a key are missing from its partner. So of that many and ``k`` more of its rarest
    characters (numbered by their repeats; ``signs``, rarest first) at least ``k`` are in the partner, among its own
    rarest ones: the keys share a combination of ``k`` of them.
    """
    need = _needed(F.col("na"), F.col("nb"), t)
    k = F.lit(1)
    for size, most in reversed(SIGNS):
        k = F.when(F.col("edits") <= most, size).otherwise(k)
    k, top = F.least(k, need), max(size for size, _ in SIGNS)
    rows = rows.withColumn("s", F.slice("signs", F.lit(1), F.col(own) - need + k))
    made = F.transform("s", lambda x, i: F.struct(i.alias("i"), x.alias("part")))
    grown = lambda c: F.flatten(F.transform(c, lambda x: F.transform(F.filter(F.transform("s", lambda y, j: F.struct(j.alias("i"), y.alias("part"))), lambda y: y["i"] > x["i"]), lambda y: F.struct(y["i"].alias("i"), F.concat(x["part"], y["part"]).alias("part")))))
    rows = rows.withColumn("c1", made)
    for size in range(2, top + 1):
        rows = rows.withColumn(f"c{size}", F.when(k >= size, grown(F.col(f"c{size - 1}"))))
    combined = F.coalesce(*(F.col(f"c{size}") for size in range(top, 0, -1)))
    return rows.select(key, "na", "nb", "bits", F.lit(-1).alias("i"), F.explode(F.array_distinct(F.transform(combined, lambda x: x["part"]))).alias("part"))


def candidate_pairs(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """(ka, kb) of distinct keys of two columns ``headword_key``, all that can have a ratio of ``t`` among them.

    A ratio of t over lengths m and n needs a common subsequence of s = ceil(t (m + n) / 200) characters, which bounds
    lengths and edits. Keys meet on lengths and on a segment that no edit touches, where segments are long enough, or else
    on a combination of rare characters. Of those that meet, pairs are left whose characters differ in no more than the
    edits: each character that one has and the other lacks turns one of 64 bits.
    """

    def keys(df: DataFrame, key: str, own: str) -> DataFrame:
        out = df.select(F.col("headword_key").alias(key)).distinct().withColumn(own, F.length(key)).where(F.col(own) > 0)
        out = out.withColumn("chars", F.filter(F.split(key, ""), lambda c: c != ""))
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64)))
        bits = F.aggregate("chars", F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))
        in_order = F.array_sort("chars")
        signs = F.transform(in_order, lambda c, i: F.concat(c, (i - F.array_position(in_order, c) + 1).cast("string")))
        return out.select(key, own, bits.alias("bits"), signs.alias("signs"))

    x, y = keys(a, "ka", "na"), keys(b, "kb", "nb")
    count = x.select(F.explode("signs").alias("s")).unionByName(y.select(F.explode("signs").alias("s"))).groupBy("s").count()

    def ordered(df: DataFrame, key: str, own: str) -> DataFrame:
        rare = df.select(key, F.explode("signs").alias("s")).hint("merge").join(count, "s").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("c"))
        return df.drop("signs").join(rare.select(key, F.transform("c", lambda v: v["s"]).alias("signs")), key)

    left, right = _with_edits(_partners(x, "na", "nb", t), t), _with_edits(_partners(y, "nb", "na", t), t)
    sx, sy = _on_segments(left.where("by_segment").drop("signs"), right.where("by_segment").drop("signs"))
    cx = _on_signs(_with_edits(_partners(ordered(x, "ka", "na"), "na", "nb", t), t).where("not by_segment"), "ka", "na", t)
    cy = _on_signs(_with_edits(_partners(ordered(y, "kb", "nb"), "nb", "na", t), t).where("not by_segment"), "kb", "nb", t)
    left, right = sx.unionByName(cx), sy.unionByName(cy)
    met = left.join(right.withColumnRenamed("bits", "other"), ["na", "nb", "i", "part"])
    edits = F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), t)
    return met.where(F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= edits).select("ka", "kb").distinct()


def similar_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(ka, kb, score) of distinct keys at the threshold or above, by an exact filter and then the ratio."""
    t = float(threshold)
    scored = candidate_pairs(a, b, t).withColumn("score", T.similarity("ka", "kb"))
    return scored.where(F.col("score") >= t)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best; ties go to the lesser key."""
    best_b = pairs.groupBy("ka").agg(F.min(F.struct((-F.col("score")).alias("d"), F.col("kb"))).alias("b")).select("ka", F.col("b.kb").alias("kb"))
    best_a = pairs.groupBy("kb").agg(F.min(F.struct((-F.col("score")).alias("d"), F.col("ka"))).alias("a")).select("kb", F.col("a.ka").alias("ka"))
    return pairs.join(best_b, ["ka", "kb"], "left_semi").join(best_a, ["ka", "kb"], "left_semi")


def greedy(pairs: DataFrame) -> DataFrame:
    """Keys of a in ascending order each take the best key of b not yet taken, the lesser of equals.

    In rounds: every key of a asks its best, every key of b holds the least that asks it, and pairs of that key of b with
    greater keys of a go, as it will never be held by one of those. When no key of b is asked twice, all have what they would
    have got in turn. Rounds are as many as the longest chain of refusals; each is two aggregates and a join, so no
    component of the pairs need fit into a task.
    """
    pairs = stored(pairs.select("ka", "kb", "score"), "pairs")
    while True:
        best = pairs.groupBy("ka").agg(F.min(F.struct((-F.col("score")).alias("d"), F.col("kb"))).alias("b")).select("ka", "b.kb", (-F.col("b.d")).alias("score"))
        asked = stored(best.groupBy("kb").agg(F.min("ka").alias("holder"), F.count(F.lit(1)).alias("n")), "asked")
        if asked.where("n > 1").isEmpty():
            return best
        pairs = stored(pairs.join(asked, "kb", "left").where("holder is null or ka <= holder").select("ka", "kb", "score"), "pairs")


def align(a: DataFrame, b: DataFrame, algorithm: str = "mutual_best", threshold: float = 80.0, fuzzy: bool = True) -> DataFrame:
    """headword_key, key_b, score, method (exact, fuzzy, none) of first entries per key: exact pairs, then fuzzy pairs of
    what is left, then what has no partner on either side. Scores and the threshold are compared as whole numbers."""
    a, b = stored(a.select("headword_key", "entry_id"), "a"), stored(b.select("headword_key", "entry_id"), "b")
    exact = align_exact(a, b).select("headword_key", F.col("headword_key").alias("key_b"), F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
    out = exact
    if fuzzy:
        left, right = a.join(exact, "headword_key", "left_anti"), b.join(exact, "headword_key", "left_anti")
        pairs = similar_pairs(left, right, int(threshold))
        chosen = stored((greedy if algorithm == "greedy" else mutual_best)(pairs), "fuzzy")
        out = exact.unionByName(chosen.select(F.col("ka").alias("headword_key"), F.col("kb").alias("key_b"), "score", F.lit("fuzzy").alias("method")))
    alone_a = a.join(out.select("headword_key"), "headword_key", "left_anti").select("headword_key", F.lit(None).cast("string").alias("key_b"))
    alone_b = b.join(out.select(F.col("key_b").alias("headword_key")), "headword_key", "left_anti").select(F.lit(None).cast("string").alias("k"), F.col("headword_key").alias("key_b"))
    alone = alone_a.unionByName(alone_b.withColumnRenamed("k", "headword_key")).select("headword_key", "key_b", F.lit(0.0).alias("score"), F.lit("none").alias("method"))
    return out.unionByName(alone)


def alignment_counts(aligned: DataFrame) -> DataFrame:
    m = F.col("method")
    return aligned.agg(
        F.count_if((m != "none") | F.col("headword_key").isNotNull()).alias("total_a"),
        F.count_if((m != "none") | F.col("key_b").isNotNull()).alias("total_b"),
        F.count_if(m == "exact").alias("matched_exact"),
        F.count_if(m == "fuzzy").alias("matched_fuzzy"),
        F.count_if(m == "none").alias("unmatched"),
    )


def aligned_rows(aligned: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """An alignment with what both sides' first entries show: ids, norms, statuses, and why a row has one side only."""
    side = lambda df, s: df.select(
        F.col("headword_key").alias(f"_{s}"), F.col("entry_id").alias(f"entry_id_{s}"), effective("headword", df.columns).alias(f"headword_{s}"),
        F.col("headword_key").alias(f"headword_norm_{s}"), (F.coalesce("status", F.lit("auto")) if "status" in df.columns else F.lit("auto")).alias(f"status_{s}"),
    )
    out = aligned.join(side(a, "a"), F.col("headword_key") == F.col("_a"), "left").join(side(b, "b"), F.col("key_b") == F.col("_b"), "left")
    out = out.withColumns({"headword_key": F.coalesce("headword_key", "key_b"), "reason": F.when(F.col("method") == "none", "no_match").otherwise("")})
    return out.drop("_a", "_b", "key_b")


def alignment_order() -> list[Column]:
    """Exact pairs first, then by score and key."""
    return [F.col("method") != "exact", F.desc("score"), F.col("headword_key")]


def match_order() -> list[Column]:
    """Exact matches first, then by score and label; places settle ties."""
    return [F.col("status") != "exact", F.desc("score"), F.col("label_a"), F.col("entry_id_a"), F.col("entry_id_b")]


def feature_object(c: str) -> Column:
    """A column of JSON objects; what is no object is an empty one."""
    return F.when(F.rlike(c, F.lit(r"^\s*\{")) & F.try_parse_json(F.col(c)).isNotNull(), F.col(c)).otherwise("{}")


def diff_text(stem: str, columns: list[str]) -> Column:
    """pron_norm or pron_render of an entry, or what stands for it."""
    some = lambda c: T.nonblank(T.strip(F.coalesce(F.col(c), F.lit(""))))
    if stem == "pron_norm":
        pron = effective("pron", columns)
        return F.coalesce(some("pron_norm"), some("form_norm"), F.when(pron != "", T.normalized_key(pron)), F.lit(""))
    return F.coalesce(some("pron_render"), some("form_display"), F.lit(""))


def diff_rows(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (entry_id_a, entry_id_b, ..) of two entries that are there, with both pronunciations, features as JSON and
    the differences a - b."""
    f = feature_object("features_json")
    number = lambda k: F.coalesce(F.get_json_object(f, f"$.{k}").try_cast("int"), F.lit(0)).alias(k)
    stress = F.coalesce(F.nullif(F.get_json_object(f, "$.stress_schema"), F.lit("")), F.get_json_object(f, "$.stress"))
    one = entries.select(
        "entry_id", diff_text("pron_norm", entries.columns).alias("pron_norm"), diff_text("pron_render", entries.columns).alias("pron_render"), f.alias("features"),
        F.coalesce("syllables", F.lit(0)).alias("n"), stress.alias("stress"), number("prime_count"), number("accented_vowel_count"),
    )
    side = lambda s: one.select(*(F.col(c).alias(f"{c}_{s}") for c in one.columns))
    both = pairs.join(side("a"), "entry_id_a").join(side("b"), "entry_id_b")
    gap = lambda c: F.col(f"{c}_a") - F.col(f"{c}_b")
    return both.withColumns(
        {
            "syll_count_diff": gap("n"),
            "stress_schema_diff": ~F.col("stress_a").eqNullSafe(F.col("stress_b")),
            "prime_count_diff": gap("prime_count"),
            "accented_vowel_count_diff": gap("accented_vowel_count"),
        }
    ).drop("n_a", "n_b", "stress_a", "stress_b", "prime_count_a", "prime_count_b", "accented_vowel_count_a", "accented_vowel_count_b")


def diff_counts(rows: DataFrame) -> DataFrame:
    count = lambda mode: F.count_if(difference_filter(mode)).alias(mode)
    return rows.agg(F.count(F.lit(1)).alias("total_pairs"), *map(count, ("pron_render_diff", "syll_count_diff", "stress_diff")))


def letter_counts(rows: DataFrame, key: str = "headword_key") -> DataFrame:
    """Rows by the letter of their key."""
    return rows.groupBy(T.alpha_bucket(F.col(key)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def difference_filter(mode: str) -> Column:
    return {
        "pron_render_diff": F.col("pron_render_a") != F.col("pron_render_b"),
        "syll_count_diff": F.col("syll_count_diff") != 0,
        "stress_diff": F.col("stress_schema_diff"),
    }.get(mode, F.lit(True))


#: Entries of one corpus and form that meet the other corpus' entries of it in one task.
BLOCK = 512
#: Pairs that a task makes, about.
TASK = 1 << 26


def _forms(entries: DataFrame, *columns: Column) -> DataFrame:
    norm = T.nonblank(T.strip(F.col("form_norm")))
    return entries.select(*columns, norm.alias("headword_key")).where("headword_key is not null")


def _equal_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(entry_id_a, entry_id_b) of equal forms. A form's entries of a are dealt into blocks, and those of b are copied to each,
    so a form that many have is many tasks'. The pairs grow with the product of both, as they are asked for, and so do the
    tasks. The copies are far more than their table's size lets expect, so both sides are sorted: a broadcast would take the
    copies to the driver."""
    count = lambda df, name: df.groupBy("headword_key").agg(F.count(F.lit(1)).alias(name))
    pairs = count(x, "na").join(count(y, "nb"), "headword_key").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).first()["n"] or 0
    blocks = x.groupBy("headword_key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    left = x.join(blocks, "headword_key").withColumn("block", F.pmod(F.xxhash64("entry_id_a"), F.col("blocks"))).drop("blocks")
    right = y.join(blocks, "headword_key").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    if pairs > TASK:
        left, right = (df.repartition(-(-pairs // TASK), "headword_key", "block") for df in (left, right))
    return left.join(right.hint("merge"), ["headword_key", "block"]).select("entry_id_a", "entry_id_b")


def _fuzzy_links(x: DataFrame, y: DataFrame, min_score: float) -> DataFrame:
    """(entry_id_a, entry_id_b, score, status) of entries of a whose form b lacks: the first entry of b's best form."""
    left = x.join(y.select("headword_key").distinct(), "headword_key", "left_anti")
    best = similar_pairs(left, y, min_score).groupBy("ka").agg(F.min(F.struct((-F.col("score")).alias("d"), F.col("kb"))).alias("b"))
    first = y.groupBy("headword_key").agg(F.min(F.struct("line_no", "entry_id_b"))["entry_id_b"].alias("entry_id_b"))
    fuzzy = left.hint("merge").join(best, left.headword_key == best.ka).select("entry_id_a", F.col("b.kb").alias("kb"), (-F.col("b.d")).alias("score"))
    return fuzzy.join(first, fuzzy.kb == first.headword_key).select("entry_id_a", "entry_id_b", "score", F.lit("fuzzy").alias("status"))


def match_entries(a: DataFrame, b: DataFrame, min_score: float = 80.0) -> DataFrame:
    """(entry_id_a, entry_id_b, score, status) on form_norm: all pairs of equal forms; an entry of a without one gets its
    best form of b at ``min_score`` or above, and that form's first entry by (line_no, entry_id). Where many entries have one
    form these are very many rows; ``match_links`` has as many as there are entries."""
    x, y = _forms(a, F.col("entry_id").alias("entry_id_a")), _forms(b, F.col("entry_id").alias("entry_id_b"), F.col("line_no"))
    exact = _equal_pairs(x, y.drop("line_no")).select("entry_id_a", "entry_id_b", F.lit(100.0).alias("score"), F.lit("exact").alias("status"))
    return exact.unionByName(_fuzzy_links(x, y, min_score))


def match_links(a: DataFrame, b: DataFrame, min_score: float = 80.0) -> DataFrame:
    """The matches of ``match_entries`` with a row for each matched entry of a: entry_id_a, entry_id_b (the first entry of b by
    (line_no, entry_id) that has the form, which stands for all that have it), n_links (how many), score, status."""
    x, y = _forms(a, F.col("entry_id").alias("entry_id_a")), _forms(b, F.col("entry_id").alias("entry_id_b"), F.col("line_no"))
    forms = y.groupBy("headword_key").agg(F.min(F.struct("line_no", "entry_id_b"))["entry_id_b"].alias("entry_id_b"), F.count(F.lit(1)).alias("n_links"))
    exact = x.join(forms, "headword_key").select("entry_id_a", "entry_id_b", "n_links", F.lit(100.0).alias("score"), F.lit("exact").alias("status"))
    return exact.unionByName(_fuzzy_links(x, y, min_score).withColumn("n_links", F.lit(1).cast("long")))


def cluster(matches: DataFrame, labels: DataFrame, min_score: float = 80.0) -> DataFrame:
    """(group_id, label, entry_id, score, status): connected components of matches; the label is the least of the members',
    the id its hash, so components of one label are one group. Members have the score 100 and the status auto."""
    parts = components(matches.where(F.col("score") >= min_score), "entry_id_a", "entry_id_b")
    members = parts.join(labels.select(F.col("entry_id").alias("node"), "label"), "node")
    names = members.groupBy("component").agg(F.min("label").alias("label"))
    out = parts.join(names, "component").select(F.sha2("label", 256).alias("group_id"), "label", F.col("node").alias("entry_id"))
    return out.withColumns({"score": F.lit(100.0), "status": F.lit("auto")})


def commit_clusters(members: DataFrame, new: DataFrame) -> DataFrame:
    """The memberships of a store after those of a new run: what the store has stays, so an entry may stand in several
    groups; a membership (group_id, dict_id, entry_id) that comes again has the new row, of equal ones any."""
    key = ["group_id", *(["dict_id"] if "dict_id" in members.columns else []), "entry_id"]
    new = new.dropDuplicates(key)
    return members.join(new.select(*key), key, "left_anti").unionByName(new.select(*members.columns))


def validated_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (entry_id_a, label_a, entry_id_b, label_b, score) that someone confirmed, as two members of a group each: its
    label is the lesser in lower case, the score that of the pair."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = pairs.withColumn("label", F.least(low("label_a"), low("label_b")))
    out = out.select(F.sha2("label", 256).alias("group_id"), "label", F.explode(F.array("entry_id_a", "entry_id_b")).alias("entry_id"), "score")
    return out.withColumn("status", F.lit("validated"))


def matrix(members: DataFrame, corpora: list[str], missing: str = "ABSENT") -> DataFrame:
    """A row for each label and a column for each corpus with its last value by ``ord``."""
    value = lambda c: F.coalesce(F.max_by(F.when(F.col("dict_id") == c, F.col("value")), F.when(F.col("dict_id") == c, F.col("ord"))), F.lit(missing)).alias(c)
    return members.groupBy("label").agg(*(value(c) for c in corpora))
