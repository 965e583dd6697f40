"""Sinks: entries, issues, comparisons and runs as CSV, JSON lines and Parquet. All write in parallel, one file a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored

# The fields of an entry export, in order.
ENTRY_FIELDS = (
    "entry_id", "dict_id", "section", "syllables", "headword_raw", "headword_edit", "headword_effective", "pos_raw", "pron_raw", "pron_edit",
    "pron_effective", "definition_raw", "definition_edit", "definition_effective", "status", "origin_raw", "origin_norm", "pos_norm", "parser_id",
    "parser_version", "parser_sha256", "source_record", "source_id", "record_key", "template_id", "template_version", "template_sha256",
    "form_display", "form_display_effective", "form_norm", "form_norm_effective", "headword_norm", "pron_norm", "pron_render", "profile_id",
    "profile_version", "profile_sha256", "features_json", "source_path", "line_no", "page", "created_at",
)


def export_payload(entries: DataFrame) -> DataFrame:
    """Entries with the effective fields that exports carry."""
    raw = lambda f: F.when(T.nonblank(F.coalesce(f"{f}_edit", F.lit(""))).isNotNull(), F.col(f"{f}_edit")).otherwise(F.coalesce(f"{f}_raw", F.lit("")))
    some = lambda c: F.nullif(c, F.lit(""))
    out = entries.withColumns({"headword_effective": raw("headword"), "pron_effective": raw("pron"), "definition_effective": raw("definition")})
    edited = (F.col("headword_effective") != F.coalesce("headword_raw", F.lit(""))) | (F.col("pron_effective") != F.coalesce("pron_raw", F.lit("")))
    pron, head = some(F.col("pron_effective")), F.col("headword_effective")
    shown = F.when(edited, F.coalesce(pron, head)).otherwise(F.coalesce(some(F.col("form_display")), pron, head))
    out = out.withColumn("form_display_effective", shown)
    return out.withColumn("form_norm_effective", F.coalesce(some(F.col("form_norm")), F.lower("form_display_effective")))


def export_fields(entries: DataFrame) -> DataFrame:
    """All fields of an entry export as text, in order; what an entry lacks is empty, its status auto, its features {}."""
    out = export_payload(entries)
    empty = {"status": "auto", "features_json": "{}"}
    text = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(empty.get(c, ""))) if c in out.columns else F.lit(empty.get(c, ""))
    return out.select(*(text(c).alias(c) for c in ENTRY_FIELDS))


def export_issues(issues: DataFrame) -> DataFrame:
    """Issues as their CSV has them, details as JSON with sorted keys."""
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries("details")))
    details = F.coalesce(F.to_json(sorted_), F.lit("{}")) if "details" in issues.columns else F.lit("{}")
    created = F.col("created_at").cast("string") if "created_at" in issues.columns else F.lit("")
    return issues.select("dict_id", "source_path", "line_no", "kind", "code", "raw", details.alias("details_json"), created.alias("created_at"))


def export_alignment(rows: DataFrame) -> DataFrame:
    """A stored alignment as its CSV has it; the headwords are not stored, so they are empty."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
    blank = [F.lit("").alias(f"headword_{s}") for s in "ab"]
    names = ("headword_norm_a", "headword_norm_b", "entry_id_a", "entry_id_b", "status_a", "status_b")
    return rows.select("headword_key", *blank, *map(given, names), "score", "method", given("reason"))


def export_diff(rows: DataFrame) -> DataFrame:
    """Differences as their CSV has them, features and differences as JSON."""
    delta = F.to_json(F.struct("accented_vowel_count_diff", "prime_count_diff", "stress_schema_diff", "syll_count_diff"))
    return rows.select(
        "headword_key", "entry_id_a", "entry_id_b", "pron_render_a", "pron_render_b", "pron_norm_a", "pron_norm_b",
        F.col("features_a").alias("features_a_json"), F.col("features_b").alias("features_b_json"), delta.alias("delta_json"),
    )


def export_selection(entries: DataFrame, issues: DataFrame, ids: list[str]) -> DataFrame:
    """Chosen entries with their effective fields and number of issues, as a selection's CSV has them."""
    n = issues.groupBy("source_path", "line_no").agg(F.count(F.lit(1)).alias("flags"))
    out = export_payload(entries.where(F.col("entry_id").isin(ids))).join(n, ["source_path", "line_no"], "left")
    names = ("entry_id", "headword_effective", "pron_effective", "definition_effective")
    return out.select(*names, F.coalesce("status", F.lit("auto")).alias("status"), F.coalesce("flags", F.lit(0)).cast("string").alias("flags"))


def matrix_flags(matrix: DataFrame, issues: DataFrame, corpora: list[str], limit: int = 30) -> DataFrame:
    """metric and value of the sheet beside a comparison matrix: its corpora, its groups, and the most frequent issues."""
    top = issues.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code", "kind").limit(limit)
    rows = matrix.agg(F.lit("lemma_groups").alias("metric"), F.count(F.lit(1)).cast("string").alias("value"))
    rows = rows.unionByName(rows.select(F.lit("dictionaries").alias("metric"), F.lit(", ".join(corpora)).alias("value")))
    return rows.unionByName(top.select(F.concat(F.lit("issue:"), "code", F.lit(":"), "kind").alias("metric"), F.col("n").cast("string").alias("value")))


def matrix_lines(matrix: DataFrame, corpora: list[str], as_list: bool = False) -> DataFrame:
    """A comparison matrix (group_id, label, a column for each corpus) as rows of a document's table, cells set off by
    tabs; or as a list: the label with 8 digits of its group, then a line for each corpus."""
    if not as_list:
        return matrix.select("label", F.lit(0).alias("k"), F.concat_ws("\t", "group_id", "label", *(F.col(c) for c in corpora)).alias("line"))
    head = F.concat("label", F.lit(" ("), F.substring("group_id", 1, 8), F.lit(")"))
    lines = F.array(head, *(F.concat(F.lit(f"{c}: "), F.col(c)) for c in corpora))
    return matrix.select("label", F.posexplode(lines).alias("k", "line"))


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Tables that a workbook would hold, each a CSV folder of its sheet's name."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def flat(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, for formats without them."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def coverage_export(covered: DataFrame) -> DataFrame:
    flag = lambda c: F.when(F.col(c), "1").otherwise("0").alias(c)
    return covered.select("headword_key", *(flag(c) for c in covered.columns if c.startswith("in_")))


def append_issues(issues: DataFrame, path: str) -> None:
    """Issues after those that are there, partitioned by corpus."""
    issues.write.mode("append").partitionBy("dict_id").parquet(path)


def append_log(spark, path: str, event: str, **summary) -> None:
    """A line of a run log: JSON with the event and its summary."""
    import json

    line = json.dumps({"event": event, "summary": summary}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def session_key(config: dict) -> str:
    """The name of a stored session: the digest of its configuration as sorted JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def save_session(spark, config: dict, path: str) -> str:
    """Store a session's configuration under its key, and return that: an equal configuration replaces itself."""
    import json

    key = session_key(config)
    row = spark.createDataFrame([(json.dumps(config, ensure_ascii=False, sort_keys=True),)], "config string").withColumn("created_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/session_id={key}")
    return key


def load_session(spark, key: str, path: str) -> dict:
    """The configuration of a stored session."""
    import json

    return json.loads(spark.read.parquet(f"{path}/session_id={key}").first()["config"])


def list_sessions(spark, path: str) -> DataFrame:
    """session_id and created_at of stored sessions, the last first."""
    return spark.read.parquet(path).select("session_id", "created_at").orderBy(F.desc("created_at"), "session_id")


def clear_corpus(tables: dict[str, DataFrame], dict_id: str) -> dict[str, DataFrame]:
    """A store's tables (entries, issues, members, ..) without a corpus."""
    return {name: df.where(F.col("dict_id") != dict_id) for name, df in tables.items()}


def write_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entries partitioned by corpus; overwriting replaces only the corpora that come."""
    entries.write.mode(mode).partitionBy("dict_id").option("partitionOverwriteMode", "dynamic").parquet(path)


#: What curation has changed of an entry; an upsert resets it.
CURATION = {"headword_edit": None, "pron_edit": None, "definition_edit": None, "status": "auto", "is_deleted": False, "deleted_at": None, "deleted_reason": None}


def upsert_entries(new: DataFrame, path: str, order: str | None = None, keep_curation: bool = False, buckets: int = 64) -> None:
    """Entries written over a store that lies in buckets by entry_id: only buckets that entries come for are read and
    rewritten, and Spark puts them in place once all are written.

    An entry that comes again replaces the old one and loses its curation (edits, status, deletion), as it does in the store
    that this follows; ``keep_curation`` keeps it. Of several new rows of an id the greatest by ``order`` (else any) comes.
    The first call makes the store; columns are its own, those that a row lacks are null. Rows without an id are one
    entry's.
    """
    spark = new.sparkSession
    rest = [c for c in new.columns if c != "entry_id"]
    if order:
        new = new.groupBy("entry_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("entry_id", "r.*")
    else:
        new = new.dropDuplicates(["entry_id"])
    kinds = dict(new.dtypes)
    if not keep_curation:
        new = new.withColumns({c: F.lit(v).cast(kinds[c]) for c, v in CURATION.items() if c in kinds})
    new = new.withColumn("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(buckets)).cast("int"))
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        new.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return
    new = stored(new, "upsert")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    if keep_curation:
        kept = [c for c in CURATION if c in old.columns]
        was = old.select(F.col("entry_id").alias("_id"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_old_{c}") for c in kept))
        new = new.join(was, F.col("entry_id").eqNullSafe(F.col("_id")), "left")
        value = lambda c: F.when(F.col("_there"), F.col(f"_old_{c}")).otherwise(F.col(c) if c in kinds else F.lit(CURATION[c]).cast(dict(old.dtypes)[c]))
        new = new.withColumns({c: value(c) for c in kept}).drop("_id", "_there", *(f"_old_{c}" for c in kept))
    ids = new.select(F.col("entry_id").alias("_id"))
    left = old.join(ids, F.col("entry_id").eqNullSafe(F.col("_id")), "left_anti")
    both = left.unionByName(new.select(*(c for c in new.columns if c in old.columns)), allowMissingColumns=True).select(*old.columns)
    both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_entries(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def save_run(run_id: str, tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a comparison run, each in its own folder by run."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def list_runs(spark, path: str, limit: int = 30) -> DataFrame:
    """The latest runs of a folder of runs (its table runs: run_id, created_at, ..), the last first."""
    return spark.read.parquet(f"{path}/runs").orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def rehydrate(alignment: DataFrame, entries: DataFrame) -> DataFrame:
    """A stored alignment with the headwords and statuses that its entries have now; entries that are gone leave nulls."""
    head = F.coalesce(T.nonblank(F.col("headword_edit")), F.col("headword_raw"))
    side = lambda s: entries.select(F.col("entry_id").alias(f"entry_id_{s}"), head.alias(f"headword_{s}"), F.col("status").alias(f"status_{s}"))
    out = alignment.drop("headword_a", "headword_b", "status_a", "status_b")
    return out.join(side("a"), "entry_id_a", "left").join(side("b"), "entry_id_b", "left")


def load_run(spark, run_id: str, name: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("run_id") == run_id)
