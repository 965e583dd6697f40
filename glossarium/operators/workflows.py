"""Whole runs: dictionary lines or template records to entries and issues, and conventions over a store.

A run returns its tables, and a row of counts; nothing is collected, so writing them is what computes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions import text as T
from . import filters, parsing, quality, templates


@dataclass(frozen=True)
class Run:
    entries: DataFrame
    issues: DataFrame
    report: DataFrame

    def summary(self) -> DataFrame:
        """One row: entries and issues."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return n(self.entries, "entries").crossJoin(n(self.issues, "issues"))  # one row each


def run_pipeline(lines: DataFrame, dict_id: str, profile: profiles.Profile, preset: parsing.Preset | None = None, rule: filters.SourceFilter | filters.Rules | None = None, lexicon: DataFrame | None = None) -> Run:
    """Entries and issues of a corpus' lines (source_path, line_no, raw); the rule is one for all sources or each source's own.

    Dropped lines are read as blank ones, so that line numbers hold; then lines are parsed and linted, headwords held
    against the lexicon of long s, and the profile laid over the pronunciation, or the headword where there is none.
    """
    one = rule is None or isinstance(rule, filters.SourceFilter)
    filtered = filters.filter_source(lines, rule or filters.SourceFilter()) if one else filters.filter_sources(lines, rule)
    blanked = filtered.withColumn("raw", F.when(F.col("drop_stage").isNull(), F.col("raw")).otherwise(""))
    classified = parsing.classify(blanked, preset)
    entries = parsing.parsed_entries(classified)
    pron = F.coalesce(T.nonblank(F.col("pron_raw")), F.col("headword_raw")) if preset else F.col("headword_raw")
    id_ = parsing.entry_id(F.lit(dict_id), F.col("source_path"), F.col("line_no"), F.col("headword_raw"), F.col("pos_raw"))
    entries = entries.withColumns({"dict_id": F.lit(dict_id), "entry_id": id_, "raw_line": F.col("raw"), "form": pron})
    entries = profiles.apply_profile(entries, "form", profile).drop("form")
    none = F.create_map().cast("map<string,string>")
    issues = parsing.line_issues(classified).withColumns({"dict_id": F.lit(dict_id), "details": none}).select(*quality.ISSUE_COLUMNS)
    issues = issues.unionByName(quality.profile_issues(entries, profile))
    if lexicon is not None:
        s = parsing.long_s_suspects(entries, lexicon).select("dict_id", "source_path", "line_no", F.lit("warning").alias("kind"), F.lit("S_VS_F_CHECK").alias("code"), F.col("raw_line").alias("raw"), none.alias("details"))
        issues = issues.unionByName(s)
    return Run(entries, issues, filters.filter_report(filtered))


def apply_template(records: DataFrame, dict_id: str, kind: str, overrides: DataFrame | None = None, **params) -> Run:
    """Entries and issues of records (source_path, line_no, raw, and csv_row for mappings) by a template: one syllable, no
    section, part of speech p for word lists and v otherwise unless the record has its own. Overrides (record_key,
    override_id, op, entries) replace what their records gave."""
    keyed = records.withColumn("record_key", templates.record_key(F.col("source_path"), F.col("line_no"), F.col("raw")))
    drafts = getattr(templates, kind)(keyed, **params)
    if overrides is not None:
        place = keyed.select("record_key", "source_path", "line_no", "raw")
        drafts = templates.apply_overrides(drafts, overrides).join(place, "record_key")
    ok = drafts.where("status = 'OK'")
    pos = F.coalesce(T.nonblank(F.col("pos")), F.lit("p" if kind == "wordlist" else "v"))
    entries = ok.select(
        F.lit(dict_id).alias("dict_id"), F.lit("").alias("section"), F.lit(1).alias("syllables"), F.col("headword").alias("headword_raw"), pos.alias("pos_raw"),
        F.col("pron").alias("pron_raw"), F.col("definition").alias("definition_raw"), "source_path", "line_no", F.col("raw").alias("source_record"), "record_key", "draft_no",
    )
    id_ = parsing.entry_id(F.col("dict_id"), F.col("source_path"), F.col("line_no"), F.col("headword_raw"), F.col("pos_raw"))
    return Run(entries.withColumn("entry_id", id_), quality.template_issues(drafts, F.lit(dict_id)), templates.summarize(drafts))


def apply_profile_to_entries(entries: DataFrame, p: profiles.Profile) -> tuple[DataFrame, DataFrame]:
    """Entries with a profile's forms of their raw pronunciation or headword, and the issues of them."""
    form = F.coalesce(F.nullif("pron_raw", F.lit("")), F.col("headword_raw"))
    raw = quality.raw_line(F.col("syllables"), F.col("headword_raw"), F.col("pos_raw"), F.col("source_record") if "source_record" in entries.columns else None)
    out = profiles.apply_profile(entries.withColumns({"form": form, "raw_line": raw}), "form", p)
    return out, quality.profile_issues(out, p)


def preview_profile(entries: DataFrame, p: profiles.Profile, limit: int = 50) -> DataFrame:
    """The first entries in reading order with what a profile would make of them."""
    first = entries.orderBy("section", "line_no", "entry_id").limit(limit)
    out, _ = apply_profile_to_entries(first, p)
    codes = F.transform(quality.found_issues(out, p), lambda i: i["code"])
    return out.select("entry_id", F.col("form").alias("raw"), F.col("form_display").alias("display"), F.col("form_norm").alias("norm"), "unknown_symbols", codes.alias("issue_codes"))


def preview_convention(entries: DataFrame, p: profiles.Profile, limit: int = 200, entry_ids: list[str] | None = None) -> DataFrame:
    """The first entries in reading order, or those named, under a convention."""
    some = entries.where(F.col("entry_id").isin([e for e in entry_ids if e])) if entry_ids else entries.orderBy("section", "line_no", "entry_id").limit(limit)
    return quality.convention(some, p)


def apply_convention(entries: DataFrame, issues: DataFrame, dict_id: str, p: profiles.Profile) -> Run:
    """A store's entries of a corpus under a convention, and all issues after it: the corpus' earlier alerts are gone."""
    out = quality.convention(entries.where((F.col("dict_id") == dict_id) & filters.not_deleted()), p)
    new = quality.profile_issues(out, p, True)
    return Run(out, quality.replace_issues(issues, new, dict_id), quality.convention_counts(out))


def write_back(store: DataFrame, updated: DataFrame, fields: list[str]) -> DataFrame:
    """The store's entries with the fields of the updated ones, by entry_id; others as they are."""
    new = updated.select("entry_id", F.struct(*fields).alias("_new"))
    both = store.join(new, "entry_id", "left")
    out = {f: F.when(F.col("_new").isNotNull(), F.col("_new")[f]).otherwise(F.col(f) if f in store.columns else F.lit(None)) for f in fields}
    return both.withColumns(out).drop("_new")


def split_dialog(text: Column) -> Column:
    """Entries (headword_raw, pron_raw) that a text of the split dialog names: a line each; a single line is cut at
    semicolons, else commas, else white space. A tab sets off the pronunciation, where it hasn't served as a cut."""
    some = lambda parts: F.filter(F.transform(parts, T.strip), lambda s: s != "")
    lines = some(T.split_lines(T.strip(F.coalesce(text, F.lit("")))))
    one = lines[0]
    cut = F.when(F.contains(one, F.lit(";")), some(F.split(one, ";"))).when(F.contains(one, F.lit(",")), some(F.split(one, ",")))
    cut = cut.when(F.contains(one, F.lit(" ")), some(F.split(one, f"[{T.WS}]+"))).otherwise(lines)
    rows = F.when(F.size(lines) == 1, cut).otherwise(lines)

    def entry(row: Column) -> Column:
        parts = F.split(row, "\t", 2)
        return F.struct(T.strip(parts[0]).alias("headword_raw"), F.when(F.size(parts) == 2, T.strip(F.get(parts, F.lit(1)))).alias("pron_raw"))

    return F.filter(F.transform(rows, entry), lambda e: e["headword_raw"] != "")
