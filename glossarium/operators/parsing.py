"""Dictionary lines: sections, page marks, entries by a fixed form or a preset, and lint."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .carry import carried

# The line forms, the Greek capitals of section heads, and the known parts of speech.
SECTION = r"(?d)^[A-ZΑ-ΩΪΫ]{1,4}$"
PAGE = r"(?d)^\p{Nd}+$"
ENTRY = rf"(?d)^([1-9]|10)[{T.WS}]+(.+?),[{T.WS}]*([avpſs])$"
LOOSE = rf"(?d)^(\p{{Nd}}+)[{T.WS}]+(.+?),[{T.WS}]*([^,{T.WS}])$"
NO_COMMA = rf"(?d)^([1-9]|10)[{T.WS}]+(.+)[{T.WS}]+([avpſs])$"
GREEK = "ΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩΪΫ"
LATIN = "ABGDEZHIKLMNXOPRSTYOIY"
GREEK_PAIRS = {"Θ": "TH", "Φ": "PH", "Χ": "CH", "Ψ": "PS"}
KNOWN_POS = ("a", "v", "p", "ſ", "s")


def section_name(c: Column) -> Column:
    out = F.translate(F.upper(c), GREEK, LATIN)
    for k, v in GREEK_PAIRS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


@dataclass(frozen=True)
class Preset:
    """A line form of one's own: a pattern (held at the start), the group of each field, and maps of two of them."""

    parser_id: str
    pattern: str
    groups: dict[str, int]
    pos_map: dict[str, str] = field(default_factory=dict)
    origin_map: dict[str, str] = field(default_factory=dict)
    version: int = 1
    #: try lines again without trailing marks and spaces
    allow_extra_trailing: bool = False

    def __post_init__(self):
        if "headword" not in self.groups:
            raise ValueError("a preset needs a headword")
        import re

        most = re.compile(self.pattern).groups
        if any(not 0 < g <= most for g in self.groups.values()):
            raise ValueError("a preset names a group that its pattern lacks")


def _mapped(c: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """By the map as it is, then without regard to case, else ``otherwise`` (null)."""
    otherwise = F.lit(None).cast("string") if otherwise is None else otherwise
    if not table:
        return otherwise
    exact = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    low: dict[str, str] = {}
    for k, v in table.items():
        low.setdefault(k.lower(), v)
    loose = F.create_map(*(F.lit(x) for kv in low.items() for x in kv))
    return F.coalesce(F.try_element_at(exact, c), F.try_element_at(loose, F.lower(c)), otherwise)


def classify(lines: DataFrame, preset: Preset | None = None, key: str = "source_path") -> DataFrame:
    """Lines (key, line_no, raw) with kind (blank, section, page, preset, entry, other), section and the entry's fields.

    A section line sets the section of the lines after it in its source: the last value is carried along blocks of lines, so
    a source of any length is spread over tasks.
    """
    s = T.strip(F.coalesce("raw", F.lit("")))
    out = lines.withColumn("line", s)
    line = F.col("line")
    kind = F.when((line == "") | line.startswith("#"), "blank").when(F.rlike(line, F.lit(SECTION)), "section").when(F.rlike(line, F.lit(PAGE)), "page")
    if preset:
        form = T.regex(preset.pattern, start=True)
        bare = F.regexp_replace(line, f"[{T.WS}]+$", "")
        bare = F.rtrim(bare, F.lit(" .;:,")) if preset.allow_extra_trailing else line
        fit = F.when(F.rlike(line, F.lit(form)), line).when(F.rlike(bare, F.lit(form)), bare)
        if "syllables" in preset.groups:  # a number that is none is no match
            number = T.strip(F.regexp_extract(fit, form, preset.groups["syllables"])).try_cast("int")
            fit = F.when(number.isNotNull(), fit)
        out = out.withColumn("fit", fit)
        kind = kind.when(F.col("fit").isNotNull(), "preset")
    out = out.withColumn("kind", kind.when(F.rlike(line, F.lit(ENTRY)), "entry").otherwise("other"))
    out = carried(out, [key], "line_no", F.when(F.col("kind") == "section", section_name(line)), "section").na.fill("", ["section"])
    is_preset = F.col("kind") == "preset"

    def part(name: str, group: int) -> Column:
        fixed = F.when(F.col("kind") == "entry", T.strip(F.regexp_extract(line, ENTRY, group)))
        if not preset or name not in preset.groups:
            return fixed
        return F.when(is_preset, T.strip(F.regexp_extract("fit", form, preset.groups[name]))).otherwise(fixed)

    head, pos = part("headword", 2), part("pos", 3)
    fields = {"syllables": part("syllables", 1).try_cast("int"), "headword_raw": head, "pos_raw": pos}
    if preset:
        none = F.lit(None).cast("string")
        given = lambda name: F.when(is_preset, F.nullif(part(name, 0), F.lit(""))) if name in preset.groups else none
        fields |= {"pos_norm": F.when(is_preset, _mapped(pos, preset.pos_map)), "origin_raw": given("origin")}
        fields["origin_norm"] = _mapped(fields["origin_raw"], preset.origin_map)
        fields["pron_raw"] = F.when(is_preset, F.coalesce(given("pron"), head))
        fields["parser_id"] = F.when(is_preset, preset.parser_id)
        return out.withColumns(fields).drop("fit")
    return out.withColumns(fields | {"pos_norm": pos})


def parsed_entries(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind").isin("entry", "preset"))


def entry_id(dict_id: Column, source_path: Column, line_no: Column, headword: Column, pos: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (dict_id, source_path, line_no, headword, pos)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _issue(when: Column, kind: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("issue_kind"), F.lit(code).alias("code")))


def line_issues(classified: DataFrame) -> DataFrame:
    """Issues of lines, several to a line: those of parsing, and of lint on lines of a looser form."""
    line, kind = F.col("line"), F.col("kind")
    has = F.col("kind").isin("entry", "preset")
    no_comma = (kind != "blank") & ~F.contains(line, F.lit(",")) & F.rlike(line, F.lit(NO_COMMA))
    loose = (kind != "blank") & ~no_comma & F.rlike(line, F.lit(LOOSE))
    n = F.regexp_extract(line, LOOSE, 1).try_cast("int")
    pos = F.regexp_extract(line, LOOSE, 3)
    found = F.array_compact(
        F.array(
            _issue(kind == "page", "warning", "PAGE_MARKER"),
            _issue(has & (F.col("section") == ""), "warning", "MISSING_SECTION"),
            _issue(kind == "other", "error", "UNPARSED_LINE"),
            _issue(no_comma, "warning", "MISSING_COMMA"),
            _issue(loose & ~F.coalesce(n.between(1, 10), F.lit(False)), "error", "SYLLABLES_OUT_OF_RANGE"),
            _issue(loose & ~pos.isin(*KNOWN_POS), "error", "INVALID_POS"),
        )
    )
    return classified.select("source_path", "line_no", "raw", F.explode(found).alias("i")).select("source_path", "line_no", F.col("i.issue_kind").alias("kind"), "i.code", "raw")


def entry_issues(entries: DataFrame) -> DataFrame:
    """Issues of entries (source_path, line_no, syllables, headword_raw, pos_raw, pos_norm)."""
    pos = F.lower(F.coalesce(T.nonblank(F.col("pos_norm")), F.col("pos_raw"), F.lit("")))
    pos = F.regexp_replace(T.strip(pos), r"\.$", "")
    pos = F.when(pos == "f", "ſ").otherwise(pos)
    found = F.array_compact(
        F.array(
            _issue(~F.coalesce(F.col("syllables").between(1, 10), F.lit(False)), "error", "SYLLABLES_OUT_OF_RANGE"),
            _issue(~pos.isin(*KNOWN_POS), "error", "INVALID_POS"),
            _issue(~F.rlike(F.coalesce("headword_raw", F.lit("")), F.lit(r"\p{L}")), "warning", "NON_ALPHA_HEADWORD"),
        )
    )
    return entries.select("source_path", "line_no", "headword_raw", F.explode(found).alias("i")).select("source_path", "line_no", F.col("i.issue_kind").alias("kind"), "i.code", "headword_raw")


def long_s_suspects(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries whose headword is in the lexicon (token) of words where an f may be a long s."""
    words = lexicon.select(F.lower(T.strip(F.col("token"))).alias("word")).where("word <> '' and not startswith(word, '#')").distinct()
    low = F.lower("headword_raw")
    return entries.where(F.contains(low, F.lit("f"))).join(words, low == F.col("word"), "left_semi")
