"""Pages, lookups, orders, counts and tops of entries, issues and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import not_deleted


def page(entries: DataFrame, size: int = 100, number: int = 1) -> DataFrame:
    """A page of the filtered entries in the order of section, line and id."""
    return entries.orderBy("section", "line_no", "entry_id").offset(size * (number - 1)).limit(size)


def entries_of(entries: DataFrame, dict_id: str, include_deleted: bool = False) -> DataFrame:
    """A corpus' entries by line and id."""
    out = entries.where(F.col("dict_id") == dict_id)
    return (out if include_deleted else out.where(not_deleted())).orderBy("line_no", "entry_id")


def by_id(entries: DataFrame, *ids: str) -> DataFrame:
    return entries.where(F.col("entry_id").isin(*ids))


def in_bucket(bucket: str) -> Column:
    return F.col("alpha_bucket") == bucket.strip().upper()


def count_entries(entries: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Numbers of entries by corpus."""
    return (entries if include_deleted else entries.where(not_deleted())).groupBy("dict_id").agg(F.count(F.lit(1)).alias("n"))


def count_issues(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dict_id").agg(F.count(F.lit(1)).alias("n"))


def next_line_no(entries: DataFrame) -> DataFrame:
    """The line number of a corpus' next entry made by hand."""
    return entries.groupBy("dict_id").agg((F.coalesce(F.max("line_no"), F.lit(0)) + 1).alias("line_no"))


def diagnostics(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each corpus: entries, issues, and issues that point at unknown symbols or a long s."""
    odd = F.count_if(F.col("code").isin("UNKNOWN_SYMBOL", "S_VS_F_CHECK")).alias("unknown")
    n = issues.groupBy("dict_id").agg(F.count(F.lit(1)).alias("issues"), odd)
    out = count_entries(entries).withColumnRenamed("n", "entries").join(n, "dict_id", "full")
    return out.fillna(0, ["entries", "issues", "unknown"])


def newest(history: DataFrame, limit: int = 20, by: str = "created_at", id_: str = "id") -> DataFrame:
    """The latest rows of a log, the last first."""
    return history.orderBy(F.desc(by), F.desc(id_)).limit(limit)


def latest_active(templates: DataFrame, key: str = "corpus_id", order: str = "id") -> DataFrame:
    """The active template of each corpus: the last one saved as such."""
    rest = [c for c in templates.columns if c != key]
    return templates.where("is_active").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("t")).select(key, "t.*")


def capped(rows: DataFrame, order: list[str], limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first rows, and the count of all."""
    return rows.orderBy(*order).limit(limit), rows.agg(F.count(F.lit(1)).alias("count"))


def comparison_rows(groups: DataFrame, members: DataFrame, entries: DataFrame, dict_ids: list[str]) -> DataFrame:
    """Members of groups with the value that a comparison shows, by label and corpus: the rendered pronunciation, else the
    display form, else the norm."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    value = F.coalesce(some("pron_render"), some("form_display"), some("form_norm"), F.lit(""))
    e = entries.select("entry_id", value.alias("value"))
    out = members.where(F.col("dict_id").isin(dict_ids)).join(groups.select("group_id", "label"), "group_id").join(e, "entry_id")
    return out.select("group_id", "label", "dict_id", "value", "entry_id").orderBy("label", "dict_id")


def bucket_counts(rows: DataFrame, bucket: str = "alpha_bucket", distinct: str | None = None) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(bucket), F.lit("")), F.lit("#")).alias("bucket")
    return rows.groupBy(name).agg((F.countDistinct(distinct) if distinct else F.count(F.lit(1))).alias("n"))


def top_issues(issues: DataFrame, k: int = 30) -> DataFrame:
    return issues.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code", "kind").limit(k)


def issue_counts(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """Entries with the number of issues at their source and line."""
    n = issues.groupBy("source_path", "line_no").agg(F.count(F.lit(1)).alias("n_issues"))
    return entries.join(n, ["source_path", "line_no"], "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
