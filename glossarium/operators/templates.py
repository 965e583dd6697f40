"""Templates: a record gives entries, or a status that says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The trailing punctuation of tokens and the form of parts of speech at a column's end.
TRAILING = r".,;:!?/\|"
POS_TAIL = rf"(?diu)^(.+?)[{T.WS}]+((?:[a-zà-ÿ]+\.[{T.WS}]*){{1,4}})$"
SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t"}
DRAFT = "array<struct<headword:string,pron:string,definition:string,pos:string,status:string,reason:string>>"


def _row(headword=None, pron=None, definition=None, pos=None, status="OK", reason=None) -> Column:
    as_text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    names = ("headword", "pron", "definition", "pos", "status", "reason")
    return F.struct(*(as_text(v).alias(n) for n, v in zip(names, (headword, pron, definition, pos, status, reason))))


def _bad(code: str, **more) -> Column:
    return _row(status="UNRECOGNIZED" if code == "UNRECOGNIZED_RECORD" else "IGNORED", reason=code, **more)


#: Columns that templates make; a record's own of these names go.
MADE = ("draft_no", "headword", "pron", "definition", "pos", "status", "reason")


def _own(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c.lower() not in MADE]


def emit(records: DataFrame, rows: Column) -> DataFrame:
    """One row for each struct of ``rows`` beside the record's columns, with its place. Columns of the record that have a
    draft's names (MADE) may be read by ``rows`` but go."""
    own = _own(records)
    return records.select(*own, F.posexplode(rows).alias("draft_no", "d")).select(*own, "draft_no", "d.*")


def _stripped(t: Column, trim: bool) -> Column:
    return F.rtrim(t, F.lit(TRAILING)) if trim else t


def wordlist(records: DataFrame, text: str = "raw", strip_trailing: bool = True, pron_from_headword: bool = False) -> DataFrame:
    """A row for each token: a headword, or ignored as punctuation or as nothing left; an empty text has one such row."""
    tokens = F.split(T.squeeze(F.coalesce(text, F.lit(""))), " ")

    def row(t: Column) -> Column:
        word = _stripped(t, strip_trailing)
        pron = word if pron_from_headword else None
        return (
            F.when(t == "", _bad("EMPTY_HEADWORD"))
            .when(~F.rlike(t, F.lit(r"[\p{L}\p{N}]")), _bad("PUNCT_ONLY_TOKEN", headword=t))
            .when(word == "", _bad("EMPTY_HEADWORD"))
            .otherwise(_row(word, pron))
        )

    # tokens become rows first: what is asked of each is then compiled, inside a transform it would be interpreted
    own = _own(records)
    rows = records.select(*own, F.posexplode(tokens).alias("draft_no", "_token")).withColumn("d", row(F.col("_token")))
    return rows.select(*own, "draft_no", "d.*")


def headwords(records: DataFrame, text: str = "raw", strip_trailing: bool = True) -> DataFrame:
    """The headwords of ``wordlist`` alone: ``headword`` beside the record's columns, without the text. A token is one if it has
    a letter or a number, as something is left of it then."""
    own = [c for c in _own(records) if c != text]
    tokens = records.select(*own, F.explode(F.split(text, f"[{T.WS}]+")).alias("_token"))
    return tokens.where(F.rlike("_token", F.lit(r"[\p{L}\p{N}]"))).select(*own, _stripped(F.col("_token"), strip_trailing).alias("headword"))


def _cut(records: DataFrame, text: str, separator: str, custom: str) -> DataFrame:
    """Records with ``_head`` and ``_rest``: the parts of the stripped line before and after the first separator, stripped, or
    null without one. Lines are columns first, so that each is stripped and searched once."""
    runs = separator in ("double_space", "multi_spaces")
    out = records.withColumn("_line", T.strip(F.coalesce(text, F.lit(""))))
    line, sign = F.col("_line"), SEPARATORS.get(separator) or custom
    if runs or not sign:
        out = out.withColumn("_parts", F.split(line, f"[{T.WS}]{{2,}}" if runs else "", 2))
        both = (F.when(F.size("_parts") == 2, F.get("_parts", F.lit(k))) for k in (0, 1))
    else:
        out = out.withColumn("_at", F.instr(line, sign))
        both = (F.when(F.col("_at") > 0, part) for part in (F.substr(line, F.lit(1), F.col("_at") - 1), F.substr(line, F.col("_at") + len(sign))))
    head, rest = map(T.strip, both)
    return out.withColumns({"_head": head, "_rest": rest})


def _two(records: DataFrame, text: str, separator: str, custom: str, trim: bool, name: str) -> DataFrame:
    own = _own(records)
    cut = _cut(records.select(*own), text, separator, custom).withColumn("_head", _stripped(F.col("_head"), trim))
    head, rest = F.col("_head"), F.col("_rest")
    row = F.when(head.isNull(), _bad("UNRECOGNIZED_RECORD")).when(head == "", _bad("EMPTY_HEADWORD")).otherwise(_row(head, **{name: rest}))
    return cut.withColumn("d", row).select(*own, F.lit(0).alias("draft_no"), "d.*")


def entry_definition(records: DataFrame, text: str = "raw", separator: str = "comma", custom: str = "") -> DataFrame:
    """A row for each record: headword and definition, before and after the first separator."""
    return _two(records, text, separator, custom, False, "definition")


def headword_pron(records: DataFrame, text: str = "raw", separator: str = "tab", custom: str = "", trim: bool = False) -> DataFrame:
    """A row for each record: headword and pronunciation, before and after the first separator."""
    return _two(records, text, separator, custom, trim, "pron")


def three_columns(records: DataFrame, text: str = "raw", separator: str = "auto", custom: str = "") -> DataFrame:
    """Headword with part of speech, gloss and pronunciation, by the first way of cutting that gives three parts."""
    line = T.strip(F.coalesce(text, F.lit("")))
    patterns = {"tab": "\t", "triple_spaces": f"[{T.WS}]{{3,}}", "double_spaces": f"[{T.WS}]{{2,}}"}
    if custom:
        patterns["custom"] = "\\Q" + custom + "\\E"
    modes = list(patterns) if separator == "auto" else [separator]

    def cut(mode: str) -> Column:
        parts = F.filter(F.transform(F.split(line, patterns[mode]), T.strip), lambda p: p != "")
        return F.when(F.size(parts) >= 3, parts)

    out = records.withColumn("_parts", F.coalesce(*(cut(m) for m in modes)))
    parts, n = F.col("_parts"), F.size("_parts")
    first = F.regexp_replace(F.get(parts, F.lit(0)), r"^[^\p{L}\p{N}]+", "")
    comma = F.split(first, ",", 2)
    tail = F.regexp_extract(first, POS_TAIL, 1)
    head = F.when(F.size(comma) == 2, T.strip(comma[0])).when(tail != "", T.strip(tail)).otherwise(T.strip(first))
    pos = F.when(F.size(comma) == 2, T.strip(F.get(comma, F.lit(1)))).otherwise(T.strip(F.regexp_extract(first, POS_TAIL, 2)))
    gloss = F.array_join(F.slice(parts, F.lit(2), n - 2), " ")
    row = F.when(parts.isNull(), _bad("UNRECOGNIZED_RECORD")).when(head == "", _bad("EMPTY_HEADWORD"))
    return emit(out, F.array(row.otherwise(_row(head, F.element_at(parts, -1), gloss, pos)))).drop("_parts")


def csv_mapping(records: DataFrame, headword: str, pron: str | None = None, definition: str | None = None, split: str = "none", row: str = "csv_row") -> DataFrame:
    """Rows of a map column by the names of its keys; a headword may be several."""
    get = lambda k: T.strip(F.coalesce(F.try_element_at(F.col(row), F.lit(k)), F.lit(""))) if k else None
    patterns = {"whitespace": f"[{T.WS}]+", "semicolon": ";", "comma": ","}
    head = get(headword)
    heads = F.split(head, patterns[split]) if split in patterns else F.array(head)
    heads = F.filter(F.transform(heads, T.strip), lambda h: h != "")
    blank = lambda c: F.nullif(c, F.lit("")) if c is not None else None
    rows = F.transform(heads, lambda h: _row(h, blank(get(pron)), blank(get(definition))))
    return emit(records, F.when(F.size(heads) > 0, rows).otherwise(F.array(_bad("EMPTY_HEADWORD"))))


def csv_columns(records: DataFrame, row: str = "csv_row") -> DataFrame:
    """The names that any record's row has, sorted."""
    return records.select(F.explode(F.map_keys(row)).alias("column")).distinct().orderBy("column")


def summarize(drafts: DataFrame, *keys: str) -> DataFrame:
    return drafts.groupBy(*keys).agg(
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "UNRECOGNIZED").alias("unrecognized"),
        F.count_if(F.col("status") == "IGNORED").alias("ignored"),
    )


# The ways of reading records that are tried, with their priorities.
CANDIDATES = (
    ("three_columns", "auto", 90), ("three_columns", "triple_spaces", 80), ("three_columns", "tab", 70), ("headword_pron", "multi_spaces", 50),
    ("headword_pron", "tab", 40), ("entry_definition", "comma", 30), ("entry_definition", "double_space", 20),
)


def recommend(records: DataFrame, text: str = "raw", key: str = "record_key") -> DataFrame:
    """A score for each way of reading the records, the best first: 20 for a record read, 1 for an entry, less for records
    not read or ignored and for more than three entries a record; then the priority. The first of equals is the best."""
    runs = {"three_columns": three_columns, "headword_pron": headword_pron, "entry_definition": entry_definition}
    all_ = None
    for place, (name, separator, priority) in enumerate(CANDIDATES):
        more = {"trim": True} if name == "headword_pron" else {}
        run = runs[name](records, text, separator, **more).select(F.col(key).alias("k"), "status")
        run = run.select(F.lit(place).alias("place"), F.lit(name).alias("template"), F.lit(separator).alias("separator"), F.lit(priority).alias("priority"), "k", "status")
        all_ = run if all_ is None else all_.unionByName(run)
    per = all_.groupBy("place", "template", "separator", "priority", "k").agg(
        F.count_if(F.col("status") == "OK").alias("entries"), F.count_if(F.col("status") == "UNRECOGNIZED").alias("u"), F.count_if(F.col("status") == "IGNORED").alias("i")
    )
    count = lambda c: F.count_if(F.col(c) > 0)
    score = count("entries") * 20 + F.sum("entries") - count("u") * 10 - count("i") * 4 - F.greatest(F.lit(0), F.sum("entries") - 3 * F.count(F.lit(1)))
    out = per.groupBy("place", "template", "separator", "priority").agg((score + F.first("priority")).alias("score"), count("entries").alias("ok_records"), F.sum("entries").alias("entries"), count("u").alias("unrecognized"))
    return out.orderBy(F.desc("score"), "place").drop("priority")


def record_key(source_id: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_id, index.cast("string"), T.squeeze(F.coalesce(text, F.lit("")))), 256)


#: Columns of an override beside its key: the entries in place of a record's, and what an edit of one entry says of it.
ENTRY = ("headword", "pron", "definition", "pos")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The last override of each record key: the greatest override_id, an aggregate that combines before the shuffle."""
    given = [c for c in ("op", "entries", *ENTRY) if c in overrides.columns]
    last = F.max_by(F.struct(*given), "override_id").alias("o")
    return overrides.where("record_key is not null").groupBy("record_key").agg(last).select("record_key", "o.*")


def delete_overrides(overrides: DataFrame, gone: DataFrame) -> DataFrame:
    """Overrides without those that ``gone`` names: by override_id, or all of a record_key."""
    for key in ("override_id", "record_key"):
        if key in gone.columns:
            overrides = overrides.join(gone.select(key).distinct(), key, "left_anti")
    return overrides


def apply_overrides(drafts: DataFrame, overrides: DataFrame, preview: bool = False) -> DataFrame:
    """Drafts (record_key, draft_no, headword, pron, definition, pos, status, reason) with each record's last override (op,
    entries, or headword, pron, definition and pos of an edit) applied; override_op says which.

    SKIP_RECORD leaves one ignored row. SPLIT_RECORD (or SPLIT) and EDIT_RECORD with entries replace the record's rows by
    one for each entry that has a headword; a pronunciation that is not given follows the headword where the first row's
    did so, or else is the first row's, as are definition and part of speech (``preview``: only what the entry itself
    has as definition). EDIT_RECORD without any such entry edits the first row alone. A split without any, and an unknown
    op, leave the rows as they are, so no record is lost. Overrides without a key, or of records that are not there, do
    nothing; rows without a key are left.
    """
    some = lambda c: T.nonblank(T.strip(F.coalesce(c, F.lit(""))))
    out = ["record_key", "draft_no", *ENTRY, "status", "reason"]
    first = drafts.groupBy("record_key").agg(F.min_by(F.struct(*ENTRY), "draft_no").alias("f"))
    last = latest_overrides(overrides)
    has = {c: F.col(c) if c in last.columns else F.lit(None).cast("string") for c in ENTRY}
    kind = last.schema["entries"].dataType if "entries" in last.columns else None
    fields = kind.elementType.names if kind is not None else []
    of = lambda e, c: e[c] if c in fields else F.lit(None).cast("string")
    given = F.transform("entries", lambda e: F.struct(*(some(of(e, c)).alias(c) for c in ENTRY))) if fields else F.array().cast("array<struct<headword:string,pron:string,definition:string,pos:string>>")
    given = F.coalesce(F.filter(given, lambda e: e["headword"].isNotNull()), F.array())
    split, edit = F.col("op").isin("SPLIT_RECORD", "SPLIT", "EDIT_RECORD"), F.col("op") == "EDIT_RECORD"
    last = last.select("record_key", "op", given.alias("given"), F.struct(*(some(has[c]).alias(c) for c in ENTRY)).alias("scalar"))
    way = F.when(F.col("op") == "SKIP_RECORD", "skip").when(split & (F.size("given") > 0), "entries").when(edit, "edit").otherwise("keep")
    last = last.withColumn("way", F.coalesce(way, F.lit("keep")))

    marked = drafts.join(last.select("record_key", "op", "way"), "record_key", "left")
    kept = marked.where("way is null or way = 'keep'").select(*out, F.col("op").alias("override_op"))
    changed = last.where("way <> 'keep'").join(first, "record_key")
    follows = some(F.col("f.headword")).isNotNull() & (some(F.col("f.pron")) == some(F.col("f.headword")))
    none = F.struct(*(F.lit(None).cast("string").alias(c) for c in ENTRY))
    head = F.coalesce(F.col("scalar.headword"), T.strip(F.col("f.headword")))
    one = F.struct(head.alias("headword"), F.col("scalar.pron").alias("pron"), F.coalesce("scalar.definition", "f.definition").alias("definition"), F.coalesce("scalar.pos", "f.pos").alias("pos"))
    rows = F.when(F.col("way") == "skip", F.array(none)).when(F.col("way") == "edit", F.array(one)).otherwise(F.col("given"))
    skipped = F.col("way") == "skip"
    changed = changed.withColumn("follows", F.coalesce(follows, F.lit(False))).select("*", F.posexplode(rows).alias("draft_no", "e"))
    pron = F.coalesce("e.pron", F.when(F.col("follows"), F.col("e.headword")), "f.pron")
    definition = F.col("e.definition") if preview else F.coalesce("e.definition", "f.definition")
    changed = changed.select(
        "record_key", "draft_no", F.col("e.headword").alias("headword"), F.when(~skipped, pron).alias("pron"),
        F.when(skipped & F.lit(preview), None).otherwise(F.when(skipped, F.col("f.definition")).otherwise(definition)).alias("definition"), F.coalesce("e.pos", "f.pos").alias("pos"),
        F.when(skipped, "IGNORED").otherwise("OK").alias("status"), F.when(skipped, "SKIP_RECORD").alias("reason"), F.col("op").alias("override_op"),
    )
    return kept.unionByName(changed)
