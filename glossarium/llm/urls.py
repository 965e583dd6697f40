"""URL filters: given rules by host and path, and rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host, path): the rules that hold before any mined one.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Mining: least share of the labelled pages that hold a combination and its label, and least share of a
#: combination's pages that hold the label.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: And least number of labelled pages that hold a combination and its label: fewer say nothing.
MIN_PAGES = 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    cut = F.instr(url, "://")
    rest = F.substring(url, cut + 3, F.length(url))
    rest = F.when(cut > 0, rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, path


def given_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits and its verdict, or nulls. A rule fits its host and
    all subdomains if the path starts with the rule's."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    rule = verdict = None
    for what, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, all host suffixes, all path segments with digits made 0, and query keys."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, n - i + 1, i), ".")),
    )
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(parts, lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))
    )
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    known = F.when(host != "", F.array_distinct(F.concat(scheme, suffixes, segments, keys)))
    return F.coalesce(known, F.array().cast("array<string>"))


def merged(rows: DataFrame) -> DataFrame:
    """(token, item): tokens that the very same rows hold are one item, so that they do not make a combination each.
    Sets of rows are told apart by their size and the sums of both halves of a hash."""
    h = F.xxhash64("tokens")
    spread = rows.select(F.explode("tokens").alias("token"), F.shiftright(h, 32).alias("hi"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    each = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    items = each.groupBy("n", "hi", "lo").agg(F.collect_list("token").alias("tokens"), F.min("token").alias("item"))
    return items.select(F.explode("tokens").alias("token"), "item")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (items, verdict, confidence, support) from rows (tokens array<string>, label string), by FP-growth
    with the label as one more item, and the items (token, item). The distributed FP-tree holds combinations, not pages."""
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0))
    rows = stored(rows.groupBy("tokens", "label").agg(F.count(F.lit(1)).alias("copies")), "labelled_urls")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    items = stored(merged(rows.select("tokens", copies)), "url_items")
    n = int(rows.agg(F.sum("copies")).first()[0] or 0)
    if not n:
        rules = labelled.sparkSession.createDataFrame([], "items array<string>, verdict string, confidence double, support double")
        return rules, items
    least = min(1.0, max(min_support, MIN_PAGES / n))
    baskets = rows.select("*", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens", "label", "copies")
    baskets = baskets.agg(F.collect_set("item").alias("items"))
    baskets = baskets.select(F.array_append("items", F.concat(F.lit("label:"), F.col("label"))).alias("items"), copies)
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets.select("items"))
    rules = found.associationRules.where(F.col("consequent")[0].startswith("label:"))
    return rules.select(
        F.array_sort("antecedent").alias("items"),
        F.substring(F.col("consequent")[0], 7, 100).alias("verdict"),
        F.round("confidence", 9).alias("confidence"),
        F.round("support", 9).alias("support"),
    ), items


def match(pages: DataFrame, rules: DataFrame, items: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, mined_tokens, mined_verdict) of pages that some mined rule fits: the surest, then the longest in the page's tokens.

    An inverted index of rules: each rule is listed under its rarest item (by the rules' own counts), each page
    looks its items up, and a rule fits if the page has all its items, each by any of the item's tokens.
    """
    spread = rules.select("*", F.explode("items").alias("item"))
    often = spread.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    post = spread.join(often, "item").groupBy("items", "verdict", "confidence", "support")
    post = post.agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    used = items.join(often.select("item"), "item", "left_semi")
    held = pages.select(key, F.explode("tokens").alias("token")).join(used, "token").groupBy(key)
    held = held.agg(F.collect_set(F.struct("item", "token")).alias("held")).withColumn("has", F.array_distinct("held.item"))
    hits = (
        held.select(key, "held", "has", F.explode("has").alias("item"))
        .join(post, "item")
        .where(F.forall("items", lambda t: F.array_contains("has", t)))
    )
    inside = F.filter("held", lambda x: F.array_contains("items", x["item"]))
    hits = hits.withColumn("tokens", F.array_sort(F.transform(inside, lambda x: x["token"])))
    best = F.max(F.struct("confidence", F.size("tokens").alias("n"), "support", "verdict", "tokens"))
    return hits.groupBy(key).agg(best.alias("b")).select(
        key, F.array_join("b.tokens", " ").alias("mined_tokens"), F.col("b.verdict").alias("mined_verdict")
    )


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined_tokens.

    A given rule decides where one fits, else the surest mined rule that fits, else ``default``. Labels
    (doc_id, quality, toxic) of a page's id say block where quality is 0 or toxic is 1, allow otherwise; a null in
    either counts as not known to be bad. Null urls and urls without ``://`` have empty host and path, no tokens
    and the default verdict; repeated page ids are judged alike by their own url; without labels, or with none that
    reach the support, no rule is mined.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "given": verdict, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(bad, "block").otherwise("allow")).alias("label"))
    labelled = base.join(marks, base.page_id == marks.doc_id).select("tokens", "label")
    mined, items = mine(labelled)
    mined = mined.where(F.col("verdict") != default)
    open_urls = base.where("given is null and size(tokens) > 0").groupBy("url").agg(F.first("tokens").alias("tokens"))
    fitted = match(open_urls, mined, items, key="url")
    # null urls match nothing, each in its own way, so that they do not meet in one task
    key = F.coalesce(F.col("url"), F.concat(F.lit("\0"), F.xxhash64("page_id").cast("string")))
    out = base.drop("tokens").join(fitted.withColumnRenamed("url", "mined_url"), key == F.col("mined_url"), "left")
    return out.select(
        "page_id",
        "url",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("given", "mined_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("mined_tokens")).alias("mined_tokens"),
    )


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_tokens")
