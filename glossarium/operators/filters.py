"""Row filters over lines and entries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class SourceFilter:
    """What to drop of a source's lines."""

    drop_before: tuple[str, ...] = ()
    drop_after: tuple[str, ...] = ()
    line_ranges: tuple[tuple[int, int], ...] = ()
    drop_lines: tuple[str, ...] = ()
    ignore_case: bool = False


#: The parts of a rule, each of which may come from another candidate.
PARTS = ("drop_before", "drop_after", "line_ranges", "drop_lines", "ignore_case")


class Rules(Protocol):
    """The rules of many sources."""

    def candidates(self, part: str) -> list:
        """The values that a part has in some rule: that of all sources first, then those of patterns."""

    def tagged(self, sources: DataFrame) -> DataFrame:
        """Sources (``_source``) with the place of each part's candidate (``_<part>``) and ``rule_patterns``."""


def _any(raw: Column, patterns: tuple[str, ...], ignore_case: bool) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(raw, F.lit(T.regex(p, ignore_case)))
    return out


def _marked(lines: DataFrame, before: Column, after: Column, ranges: Column, regex: Column, key: str) -> DataFrame:
    """Lines with the first stage that drops each. The source's first matches are two aggregates joined back, so a long
    source needs no single task."""
    first = lambda when, name: F.min(F.when(when, F.col("line_no"))).alias(name)
    marks = lines.groupBy(F.col(key).alias("_of")).agg(first(before, "first_before"), first(after, "first_after"))
    stage = F.when(F.col("line_no") < F.col("first_before"), "before").when(F.col("line_no") >= F.col("first_after"), "after")
    stage = stage.when(ranges, "ranges").when(regex, "regex")
    return lines.join(marks, F.col(key).eqNullSafe(F.col("_of"))).withColumn("drop_stage", stage).drop("first_before", "first_after", "_of")


def _in_ranges(ranges: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | F.col("line_no").between(lo, hi)
    return out


def filter_source(lines: DataFrame, rule: SourceFilter, key: str = "source_path") -> DataFrame:
    """Lines (key, line_no, raw) with drop_stage: before, after, ranges, regex or null for kept.

    The first match of a before or after pattern is looked for in all lines of the source; a before match is kept, an
    after match dropped. Each dropped line has the first stage that drops it.
    """
    raw = F.coalesce("raw", F.lit(""))
    tried = (_any(raw, patterns, rule.ignore_case) for patterns in (rule.drop_before, rule.drop_after, rule.drop_lines))
    before, after, regex = tried
    return _marked(lines, before, after, _in_ranges(rule.line_ranges), regex, key)


def filter_sources(lines: DataFrame, rules: Rules, key: str = "source_path") -> DataFrame:
    """``filter_source`` with every source by its own rule, in one pass over all lines.

    ``rules`` says of each distinct source which of its candidates every part of the rule comes from (``Rules.parts``);
    the candidates are compiled into the plan once, and a line is tried against that of its source alone. Sources are
    tagged once each and joined to their lines; a source of any size stays spread over tasks. A null path is a source of
    no pattern. Adds ``rule_patterns``, the patterns that fit, in order.
    """
    tags = rules.tagged(lines.select(F.col(key).alias("_source")).distinct())
    tagged = lines.join(tags, F.col(key).eqNullSafe(F.col("_source"))).withColumn("_source", F.coalesce(F.col(key), F.lit("")))
    raw = F.coalesce("raw", F.lit(""))

    def chosen(part: str, test) -> Column:
        out = F.lit(False)
        for place, value in enumerate(rules.candidates(part)):
            if value:
                out = out | ((F.col(f"_{part}") == place) & test(value))
        return out

    def matches(patterns) -> Column:
        return (F.col("_any_case") & _any(raw, patterns, True)) | (~F.col("_any_case") & _any(raw, patterns, False))

    any_case = F.lit(False)
    for place, value in enumerate(rules.candidates("ignore_case")):
        any_case = any_case | ((F.col("_ignore_case") == place) & F.lit(bool(value)))
    tagged = tagged.withColumn("_any_case", any_case)
    parts = [chosen(p, matches) for p in ("drop_before", "drop_after")] + [chosen("line_ranges", _in_ranges), chosen("drop_lines", matches)]
    out = _marked(tagged, *parts, key="_source")
    return out.drop("_source", "_any_case", *(f"_{p}" for p in PARTS))


def filter_report(filtered: DataFrame, key: str = "source_path") -> DataFrame:
    count = lambda s: F.count_if(F.col("drop_stage") == s)
    return filtered.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("drop_stage").isNull()).alias("kept_lines"),
        *(count(s).alias(f"dropped_{s}") for s in ("before", "after", "ranges", "regex")),
    )


def form_or_headword() -> Column:
    return F.coalesce(F.nullif(F.col("form_display"), F.lit("")), F.col("headword_raw"))


def with_accent(c: Column) -> Column:
    return F.rlike(c, F.lit(f"[{T.ACCENTED}]"))


def syllables_equal(c: Column, n: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0)) == n


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def search(needle: str, columns: list[str]) -> Column:
    """Whether any column holds the needle, A-Z and a-z alike and other letters as they are; % and _ in the needle are
    wild."""
    pattern = "%" + needle.translate(str.maketrans(_UP, _LOW)) + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.translate(F.col(c), _UP, _LOW).like(pattern), F.lit(False))
    return out


def status_in(statuses: list[str]) -> Column:
    """Only the known statuses count; none chosen gives no rows."""
    known = [s for s in statuses if s in ("auto", "reviewed", "validated")]
    return F.col("status").isin(known) if known else F.lit(False)


def touched_by_hand() -> Column:
    out = F.coalesce(F.col("manual_created"), F.lit(False)) | (F.coalesce("status", F.lit("auto")) != "auto")
    for c in ("headword_edit", "pron_edit", "definition_edit"):
        out = out | T.nonblank(F.col(c)).isNotNull()
    return out


def flagged(entries: DataFrame, issues: DataFrame) -> DataFrame:
    return entries.join(issues.select("dict_id", "source_path", "line_no").distinct(), ["dict_id", "source_path", "line_no"], "left_semi")


def page_between(lo: int, hi: int) -> Column:
    return F.coalesce(F.col("page"), F.lit(0)).between(lo, hi)


def not_deleted() -> Column:
    return ~F.coalesce(F.col("is_deleted"), F.lit(False))
