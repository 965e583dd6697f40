"""Issues of entries under a profile, their counts, and replacing those of an earlier run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions import text as T

# The codes that profiles and conventions give, which a new run replaces.
PROFILE_CODES = ("DETACHED_COMBINING_MARK", "UNKNOWN_SYMBOL", "MULTIPLE_PRIMARY_STRESS", "INCONSISTENT_STRESS", "PROFILE_RULE_RUNTIME_ERROR")
CONVENTION_CODES = (*PROFILE_CODES, "MISSING_PRON", "BAD_SYLL_COUNT")
ISSUE_COLUMNS = ("dict_id", "source_path", "line_no", "kind", "code", "raw", "details")


def raw_line(syllables: Column, headword: Column, pos: Column, record: Column | None = None) -> Column:
    """The record that an entry comes from, if there is one, else the line that it would have been read from: 0 syllables and
    part of speech v where they are missing."""
    some = lambda c: T.nonblank(T.strip(F.coalesce(c, F.lit(""))))
    made = F.concat(F.coalesce(syllables.cast("int"), F.lit(0)).cast("string"), F.lit(" "), F.coalesce(headword, F.lit("")), F.lit(", "), F.coalesce(some(pos), F.lit("v")))
    return F.coalesce(some(record), T.strip(made)) if record is not None else T.strip(made)


def _issue(when: Column, code: str, **details: Column) -> Column:
    values = F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string"))))
    return F.when(when, F.struct(F.lit(code).alias("code"), values.alias("details")))


def found_issues(applied: DataFrame, p: profiles.Profile, convention: bool = False) -> Column:
    """An array of issues (code, details) of rows that apply_profile has given their forms; with ``convention`` those on
    pron_effective and syllables too."""
    f = F.col("features")
    who = {"entry_id": F.col("entry_id"), "profile_id": F.lit(p.profile_id)}
    out = [
        _issue(f["combining_detached_count"] > 0, "DETACHED_COMBINING_MARK", **who, count=f["combining_detached_count"]),
        _issue(F.size("unknown_symbols") > 0, "UNKNOWN_SYMBOL", **who, symbols=F.array_join("unknown_symbols", " ")),
        _issue(f["primary_stress_count"] > 1, "MULTIPLE_PRIMARY_STRESS", **who, primary_stress_count=f["primary_stress_count"]),
        _issue(profiles.stress_inconsistent(f, p), "INCONSISTENT_STRESS", **who, prime_count=f["prime_count"], accented_vowel_count=f["accented_vowel_count"]),
    ]
    if convention:
        n = F.coalesce("syllables", F.lit(0))
        if p.require_pronunciation:
            out.append(_issue(F.coalesce("pron_effective", F.lit("")) == "", "MISSING_PRON", **who))
        out.append(_issue(~n.between(1, 10), "BAD_SYLL_COUNT", **who, syllables=n))
    return F.array_compact(F.array(*out))


def profile_issues(applied: DataFrame, p: profiles.Profile, convention: bool = False) -> DataFrame:
    """A row for each issue of entries (dict_id, source_path, line_no, entry_id, raw_line) with their forms."""
    rows = applied.select("dict_id", "source_path", "line_no", F.col("raw_line").alias("raw"), F.explode(found_issues(applied, p, convention)).alias("i"))
    return rows.select("dict_id", "source_path", "line_no", F.lit("warning").alias("kind"), "i.code", "raw", "i.details")


def invalid_profile(spark, dict_id: str, path: str, errors: list[str]) -> DataFrame:
    """The one issue of a profile that can't be read."""
    row = (dict_id, path, 0, "error", "PROFILE_INVALID", "", {"errors": "; ".join(errors)})
    return spark.createDataFrame([row], "dict_id string, source_path string, line_no int, kind string, code string, raw string, details map<string,string>")


def replace_issues(old: DataFrame, new: DataFrame, dict_id: str, codes: tuple[str, ...] = CONVENTION_CODES) -> DataFrame:
    """Issues of a store after a new run over a corpus: that corpus' issues of the codes are the new ones alone."""
    kept = old.where(~((F.col("dict_id") == dict_id) & F.col("code").isin(*codes)))
    return kept.unionByName(new, allowMissingColumns=True)


def by_code(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def template_issues(drafts: DataFrame, dict_id: Column) -> DataFrame:
    """Issues of template rows (source_path, line_no, raw, reason) that gave no entry, or were told to give none."""
    bad = drafts.where("reason is not null")
    return bad.select(dict_id.alias("dict_id"), "source_path", "line_no", F.lit("warning").alias("kind"), F.col("reason").alias("code"), "raw")


def convention(entries: DataFrame, p: profiles.Profile) -> DataFrame:
    """Entries under a convention: headword_norm of the effective headword; forms, features and alerts of the effective
    pronunciation, or of the headword where there is none; modified where a form differs from its text, changed where a
    listing of changes shows the row."""
    strip = lambda f: F.coalesce(T.nonblank(T.strip(F.coalesce(f"{f}_edit", F.lit("")))), T.strip(F.coalesce(f"{f}_raw", F.lit(""))))
    out = entries.drop("headword_norm", "pron_norm", "pron_render", "form_display", "form_norm", "form_render", "features")
    out = out.withColumns({"headword_effective": strip("headword"), "pron_effective": strip("pron")})
    out = out.withColumn("qa_text", F.when(F.col("pron_effective") != "", F.col("pron_effective")).otherwise(F.col("headword_effective")))
    out = out.withColumn("raw_line", raw_line(F.col("syllables"), F.col("headword_effective"), F.col("pos_raw"), F.col("source_record") if "source_record" in out.columns else None))
    out = profiles.apply_profile(out.withColumn("headword_norm", profiles.norm(F.col("headword_effective"), p)), "qa_text", p)
    out = out.withColumns({"pron_norm": F.col("form_norm"), "pron_render": F.col("form_render"), "profile_id": F.lit(p.profile_id), "profile_version": F.lit(p.version), "profile_sha256": F.lit(p.sha256())})
    out = out.withColumn("alerts", F.array_sort(F.transform(found_issues(out, p, True), lambda i: i["code"])))
    differs = (F.col("headword_norm") != F.col("headword_effective")) | (F.col("pron_norm") != F.col("qa_text")) | (F.col("pron_render") != F.col("qa_text"))
    return out.withColumns({"modified": differs, "unknown_symbols_count": F.size("unknown_symbols")}).withColumn("changed", convention_changed())


def convention_changed() -> Column:
    """Rows that a listing of changes shows: a form that differs from what it was made of, or alerts."""
    pair = lambda a, b: F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    return pair("headword_effective", "headword_norm") | pair("pron_effective", "pron_norm") | pair("pron_norm", "pron_render") | (F.size("alerts") > 0)


def convention_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("entries_analyzed"),
        F.count_if("modified").alias("modified_count"),
        F.coalesce(F.sum(F.size("alerts")), F.lit(0)).alias("alerts_count"),
        F.coalesce(F.sum("unknown_symbols_count"), F.lit(0)).alias("unknown_symbols_count"),
    )
