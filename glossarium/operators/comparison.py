"""Comparison runs: coverage, alignment and differences of corpora as one operation, stored as a whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from . import compare

# The modes and algorithms of an alignment.
MODES, ALGORITHMS = ("exact", "exact+fuzzy", "fuzzy"), ("greedy", "mutual_best")
TABLES = ("coverage", "alignment", "diff")


@dataclass(frozen=True)
class Settings:
    """What a run compares, and how."""

    corpus_ids: tuple[str, ...]
    corpus_a: str
    corpus_b: str
    key_field: str = "headword_norm_effective"
    mode: str = "exact+fuzzy"
    fuzzy_threshold: int = 90
    algorithm: str = "greedy"

    def __post_init__(self):
        wrong = []
        if len(self.corpus_ids) < 2:
            wrong.append("at least two corpora are needed")
        if not {self.corpus_a, self.corpus_b} <= set(self.corpus_ids):
            wrong.append("corpus_a and corpus_b must be among corpus_ids")
        if self.corpus_a == self.corpus_b:
            wrong.append("corpus_a and corpus_b must differ")
        wrong += [f"{name} must be one of {', '.join(known)}" for name, known in (("mode", MODES), ("algorithm", ALGORITHMS)) if getattr(self, name) not in known]
        if wrong:
            raise ValueError("; ".join(wrong))

    def payload(self) -> dict:
        return asdict(self) | {"corpus_ids": sorted(self.corpus_ids), "fuzzy_threshold": int(self.fuzzy_threshold)}

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(self.payload(), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Comparison:
    """A run's settings and tables: coverage (headword_key, corpus_id, present), alignment and diff."""

    settings: Settings
    coverage: DataFrame
    alignment: DataFrame
    diff: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def with_corpora(rows: DataFrame, s: Settings) -> DataFrame:
    return rows.withColumns({"corpus_a": F.lit(s.corpus_a), "corpus_b": F.lit(s.corpus_b)})


def run_comparison(entries: DataFrame, settings: Settings) -> Comparison:
    """Coverage of all corpora, the alignment of two, and the differences of the aligned pairs.

    Entries are keyed, and cut to the first of each corpus and key, once; that table is stored and feeds coverage and
    alignment. Deleted entries and other corpora take no part.
    """
    s = settings
    there = entries.where(F.col("dict_id").isin(*s.corpus_ids))
    if "is_deleted" in entries.columns:
        there = there.where("not coalesce(is_deleted, false)")
    first = stored(compare.first_per_key(compare.with_key(there, s.key_field)), "firsts")
    ids = sorted(set(s.corpus_ids))
    has = compare.coverage(first, ids)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("corpus_id"), F.col(f"`in_{c}`").alias("present")) for c in ids))).alias("c")
    coverage = has.select("headword_key", each).select("headword_key", "c.*")
    a, b = (first.where(F.col("dict_id") == c).drop("dict_id") for c in (s.corpus_a, s.corpus_b))
    aligned = compare.align(a, b, s.algorithm, s.fuzzy_threshold, s.mode != "exact")
    alignment = stored(with_corpora(compare.aligned_rows(aligned, a, b), s), "alignment")
    return Comparison(s, coverage, alignment, with_corpora(difference(there, alignment=alignment), s))


def difference(entries: DataFrame, run: str | None = None, path: str | None = None, alignment: DataFrame | None = None, settings: Settings | None = None, bucket: str | None = None) -> DataFrame:
    """Differences of pairs that have an entry on both sides: those of a stored run (``run`` in ``path``), of an
    ``alignment``, or of one made anew by ``settings``; with ``bucket``, of keys of that letter. Pairs whose entries are no
    longer there have none."""
    if run is not None:
        alignment = load_table(entries.sparkSession, run, "alignment", path)
    elif alignment is None:
        alignment = run_comparison(entries, settings).alignment
    pairs = alignment.where("entry_id_a is not null and entry_id_b is not null")
    if bucket and bucket.strip():
        pairs = pairs.where(T.alpha_bucket(F.col("headword_key")) == bucket.strip().upper())
    return compare.diff_rows(pairs.select("headword_key", "entry_id_a", "entry_id_b"), entries)


def counts(run: Comparison) -> dict[str, dict[str, int]]:
    """The counts of each table: a row each."""
    s = run.settings
    wide = run.coverage.groupBy("headword_key").agg(*(F.max(F.when(F.col("corpus_id") == c, F.col("present"))).alias(f"in_{c}") for c in s.corpus_ids))
    aligned = run.alignment.withColumns({
        "key_b": F.when(F.col("entry_id_b").isNotNull(), F.col("headword_key")), "headword_key": F.when(F.col("entry_id_a").isNotNull(), F.col("headword_key")),
    })
    found = {"coverage": compare.coverage_counts(wide, list(s.corpus_ids)), "alignment": compare.alignment_counts(aligned), "diff": compare.diff_counts(run.diff)}
    return {name: df.first().asDict() for name, df in found.items()}


def _home(path: str, run_id: str, name: str) -> str:
    return f"{path}/{name}/run_id={run_id}"


def save_comparison(run: Comparison, path: str, run_id: str | None = None) -> str:
    """Store a run's tables, then its manifest; returns the run's id.

    The manifest, one row with settings, their digest, counts and time, is written last and makes the run: what a crash
    leaves behind before it is no run, is not listed and cannot be loaded, and saving under the same id again replaces it.
    """
    run_id = run_id or uuid.uuid4().hex
    spark = run.alignment.sparkSession
    if _exists(spark, _home(path, run_id, "runs")):
        raise ValueError(f"there is a run {run_id}")
    for name, df in run.tables().items():
        df.write.mode("overwrite").parquet(_home(path, run_id, name))
    kept = Comparison(run.settings, *(spark.read.parquet(_home(path, run_id, name)) for name in TABLES))
    row = (run.settings.sha256(), json.dumps(run.settings.payload(), sort_keys=True), json.dumps(counts(kept), sort_keys=True), datetime.now(UTC).isoformat(timespec="microseconds"))
    spark.createDataFrame([row], "settings_sha256 string, settings string, stats string, created_at string").coalesce(1).write.parquet(_home(path, run_id, "runs"))
    return run_id


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def list_comparisons(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """The latest runs (run_id, settings_sha256, settings, stats, created_at), the last first."""
    kinds = "settings_sha256 string, settings string, stats string, created_at string, run_id string"
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(f"{path}/runs").orderBy(F.desc("created_at"), "run_id").limit(limit)


def load_table(spark: SparkSession, run_id: str, name: str, path: str) -> DataFrame:
    """A table of a stored run; only that run's files are read."""
    if not _exists(spark, _home(path, run_id, "runs")):
        raise ValueError(f"there is no run {run_id}")
    return spark.read.parquet(_home(path, run_id, name))


def load_comparison(spark: SparkSession, run_id: str, path: str) -> Comparison:
    got = json.loads(load_table(spark, run_id, "runs", path).first()["settings"])
    settings = Settings(**(got | {"corpus_ids": tuple(got["corpus_ids"])}))
    return Comparison(settings, *(load_table(spark, run_id, name, path) for name in TABLES))


def letters(run: Comparison) -> dict[str, DataFrame]:
    """Each table's keys by their letter; coverage counts a key once."""
    once = {"coverage": run.coverage.select("headword_key").distinct(), "alignment": run.alignment, "diff": run.diff}
    return {name: compare.letter_counts(df) for name, df in once.items()}
