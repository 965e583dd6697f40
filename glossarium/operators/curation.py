"""Curation as an ordered log of changes over entries: the last writer of each field wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .carry import carried
from .parsing import entry_id

EDITABLE = ("headword_edit", "pron_edit", "definition_edit", "status")


def upsert(rows: DataFrame, key: str = "entry_id", order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``: the greatest is kept, an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def derived(entries: DataFrame) -> DataFrame:
    """What a store derives when it writes entries: pron_norm and pron_render from the forms, and the letter bucket of the
    norm, else the edited, else the raw headword."""
    seed = F.coalesce(T.nonblank(F.col("headword_norm")), T.nonblank(F.col("headword_edit")), F.col("headword_raw"))
    return entries.withColumns({"pron_norm": F.col("form_norm"), "pron_render": F.col("form_render"), "alpha_bucket": T.alpha_bucket(seed)})


def replay(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Entries after the events (event_id, entry_id, op, field, value) of a log, in the order of event_id.

    EDIT sets a field (a blank value makes it null), VALIDATE and REVIEW set the status, DELETE and RESTORE the mark.
    Each field is the value of its last event: one aggregate over the log, however many events an entry has. UNDO events
    are settled first.
    """
    log = settled(log)
    op, value = F.col("op"), F.nullif(T.strip(F.coalesce("value", F.lit(""))), F.lit(""))
    status = F.when(op == "VALIDATE", "validated").when(op == "REVIEW", "reviewed").when((op == "EDIT") & (F.col("field") == "status"), value)

    def last(when: Column, v: Column, name: str) -> Column:
        return F.max(F.when(when, F.struct("event_id", F.struct(v.alias("v")).alias("s")))).alias(name)

    fields = [last((op == "EDIT") & (F.col("field") == f), value, f"new_{f}") for f in EDITABLE if f != "status"]
    per = log.groupBy("entry_id").agg(*fields, last(status.isNotNull(), status, "new_status"), last(op.isin("DELETE", "RESTORE"), (op == "DELETE").cast("string"), "new_deleted"))
    out = entries.join(per, "entry_id", "left")
    columns = {f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.s.v")).otherwise(F.col(f)) for f in EDITABLE}
    columns["is_deleted"] = F.when(F.col("new_deleted").isNotNull(), F.col("new_deleted.s.v") == "true").otherwise(F.col("is_deleted"))
    return out.withColumns(columns).drop(*(f"new_{f}" for f in EDITABLE), "new_deleted")


def fill_counts(filled: DataFrame) -> DataFrame:
    """How many entries fill_pron saw, filled, and left as they had a pronunciation or no headword to take."""
    head = F.coalesce(T.nonblank(F.col("headword_edit")), T.nonblank(F.col("headword_raw")))
    return filled.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("filled") & head.isNotNull()).alias("updated"),
        F.count_if(~F.col("filled")).alias("skipped_has_pron"), F.count_if(F.col("filled") & head.isNull()).alias("skipped_no_headword"),
    )


def settled(log: DataFrame) -> DataFrame:
    """The events of a log that hold, with what UNDO events make of it; ``replay`` of them gives the store.

    An UNDO puts back what the entry's latest event found and becomes an event itself, which the next UNDO takes back: of
    UNDOs in a row the odd ones undo and the even ones do again. So an EDIT, VALIDATE or REVIEW holds unless an odd number of
    UNDOs follows it before the entry's next event. A deletion, a restoration and a creation (CREATE_ENTRY) have nothing that
    UNDO could put back and hold always; UNDO before any event does nothing. Each UNDO finds its event by carrying the
    last one along blocks of the log, so an entry with most of the events is spread over tasks. Rows without event_id come
    first and hold.
    """
    undo = F.coalesce(F.col("op") == "UNDO", F.lit(False))
    found = carried(log, ["entry_id"], "event_id", F.when(~undo, F.col("event_id")), "undone")
    odd = found.where((F.col("op") == "UNDO") & F.col("undone").isNotNull()).groupBy("entry_id", "undone").count().where("count % 2 = 1")
    odd = odd.select(F.col("entry_id").alias("_entry"), F.col("undone").alias("_event"))
    same = F.col("entry_id").eqNullSafe(F.col("_entry")) & (F.col("event_id") == F.col("_event")) & F.col("op").isin("EDIT", "VALIDATE", "REVIEW")
    return log.where(~undo).join(odd, same, "left_anti")


def undo_last(log: DataFrame) -> DataFrame:
    """The log without each entry's last event, deletions too; UNDO events (``settled``) are what a store keeps."""
    last = log.groupBy("entry_id").agg(F.max("event_id").alias("event_id"))
    return log.join(last, ["entry_id", "event_id"], "left_anti")


def fill_pron(entries: DataFrame) -> DataFrame:
    """pron_edit from the headword where there is no pronunciation; filled says so."""
    none = T.nonblank(F.coalesce("pron_edit", F.lit(""))).isNull() & T.nonblank(F.coalesce("pron_raw", F.lit(""))).isNull()
    return entries.withColumn("filled", none).withColumn("pron_edit", F.when(none, F.coalesce(T.nonblank(F.col("headword_edit")), F.col("headword_raw"))).otherwise(F.col("pron_edit")))


def split_entries(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries of ``parts`` (entry_id, headwords) replaced by one for each headword that is not blank, where there are two
    or more. A part has the effective pronunciation and definition as its raw ones, no edits, the status auto, and its id by
    the source path, which is marked with the old id and the part's place; the rest is the entry's own."""
    cols = entries.columns
    heads = F.filter(F.transform("headwords", lambda h: T.strip(F.coalesce(h, F.lit("")))), lambda h: h != "")
    ok = parts.select("entry_id", heads.alias("_heads")).where(F.size("_heads") >= 2)
    kept = entries.join(ok, "entry_id", "left_anti")
    new = entries.join(ok, "entry_id").select(*cols, F.posexplode("_heads").alias("_k", "_h"))
    path = F.concat("source_path", F.lit("#split:"), "entry_id", F.lit(":"), (F.col("_k") + 1).cast("string"))
    made = {"source_path": path, "headword_raw": F.col("_h")}
    for f in ("pron", "definition"):
        if f"{f}_raw" in cols:
            edited = T.nonblank(F.col(f"{f}_edit")) if f"{f}_edit" in cols else F.lit(None).cast("string")
            made[f"{f}_raw"] = F.coalesce(T.strip(edited), T.strip(T.nonblank(F.col(f"{f}_raw"))))
    made |= {f"{f}_edit": F.lit(None).cast("string") for f in ("headword", "pron", "definition") if f"{f}_edit" in cols}
    if "status" in cols:
        made["status"] = F.lit("auto")
    new = new.withColumns(made)
    pos = F.col("pos_raw") if "pos_raw" in cols else F.lit("p")
    new = new.withColumn("entry_id", entry_id(*(F.col(c) for c in ("dict_id", "source_path", "line_no", "headword_raw")), pos))
    return kept.select(*cols).unionByName(new.select(*cols))


def create_entries(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with entries made by hand (dict_id, headword_raw, ..), and the log of them. A new entry is reviewed, has the
    corpus' next line in the order of headwords, one syllable, part of speech p, the path of the corpus' curation and its
    id by place and headword; blank headwords make none. Lines come from sizes of ranges of headwords, so a corpus with
    most of the new entries is numbered by many tasks."""
    from ..sources.readers import numbered

    last = entries.groupBy("dict_id").agg(F.max("line_no").alias("_last"))
    rows = new.withColumn("headword_raw", T.strip(F.coalesce("headword_raw", F.lit("")))).where("headword_raw <> ''")
    spread = numbered(rows.withColumn("_at", F.struct("dict_id", "headword_raw", F.monotonically_increasing_id().alias("_i"))), "_at")
    first = spread.groupBy("dict_id").agg(F.min("n").alias("_first"))
    rows = spread.drop("_at").join(first, "dict_id").join(last, "dict_id", "left")
    given = lambda c, value: F.coalesce(F.col(c), value) if c in new.columns else value
    line = F.coalesce("_last", F.lit(0)) + F.col("n") - F.col("_first") + 1
    path = F.concat(F.lit("manual://"), "dict_id", F.lit("/curation"))
    rows = rows.withColumns({"line_no": line.cast("int"), "source_path": given("source_path", path), "syllables": given("syllables", F.lit(1)), "pos_raw": given("pos_raw", F.lit("p")), "status": given("status", F.lit("reviewed"))})
    rows = rows.withColumns({"entry_id": entry_id(*(F.col(c) for c in ("dict_id", "source_path", "line_no", "headword_raw", "pos_raw"))), "manual_created": F.lit(True)}).drop("_last", "_first", "n")
    log = rows.select("dict_id", "entry_id", F.lit("CREATE_ENTRY").alias("op"), F.col("headword_raw").alias("value"))
    columns = [c for c in rows.columns if c in entries.columns]
    return entries.unionByName(rows.select(*columns), allowMissingColumns=True), log


def merge_entries(entries: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with pairs (id_a, id_b) of a corpus as one entry each, and the log that says which two each was: effective
    headwords and pronunciations are joined by a space, definitions by a slash; line and page are the lesser, the rest is
    the first one's. An entry may stand in one pair only."""
    cols = entries.columns
    a = entries.select(*(F.col(c).alias(f"a_{c}") for c in cols))
    b = entries.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    both = pairs.join(a, F.col("id_a") == F.col("a_entry_id")).join(b, F.col("id_b") == F.col("b_entry_id")).where("a_dict_id = b_dict_id")

    def field(s: str, f: str) -> Column:
        options = [T.nonblank(F.col(f"{s}_{f}_{k}")) for k in ("edit", "raw") if f"{f}_{k}" in cols]
        return T.strip(F.coalesce(*options, F.lit("")))

    def joined(f: str, by: str) -> Column:
        return T.strip(F.concat_ws(by, field("a", f), field("b", f)))

    made = {c: F.col(f"a_{c}") for c in cols} | {f"{f}_edit": F.lit(None).cast("string") for f in ("headword", "pron", "definition") if f"{f}_edit" in cols}
    made |= {"headword_raw": joined("headword", " "), "line_no": F.least("a_line_no", "b_line_no")}
    if "pron_raw" in cols:
        made["pron_raw"] = F.nullif(joined("pron", " "), F.lit(""))
    if "definition_raw" in cols:
        made["definition_raw"] = F.nullif(joined("definition", " / "), F.lit(""))
    if "page" in cols:
        made["page"] = F.least("a_page", "b_page")
    made["source_path"] = F.concat("a_source_path", F.lit("+"), "b_source_path", F.lit("#merge"))
    new = both.select("id_a", "id_b", *(made[c].alias(c) for c in cols))
    pos = F.col("pos_raw") if "pos_raw" in cols else F.lit("p")
    new = new.withColumn("entry_id", entry_id(F.col("dict_id"), F.col("source_path"), F.col("line_no"), F.col("headword_raw"), pos))
    gone = both.select(F.explode(F.array("id_a", "id_b")).alias("entry_id"))
    log = new.select("entry_id", F.lit("MERGE_ENTRY").alias("op"), F.array("id_a", "id_b").alias("before"))
    return entries.join(gone, "entry_id", "left_anti").unionByName(new.select(*cols)), log


def undo_structural(entries: DataFrame, before: DataFrame, log: DataFrame) -> DataFrame:
    """The store without what splits and merges of a log (made: ids made, taken: ids taken away) made, and with the entries
    that they took, as ``before`` had them."""
    made = log.select(F.explode("made").alias("entry_id")).distinct()
    taken = log.select(F.explode("taken").alias("entry_id")).distinct()
    back = before.join(taken, "entry_id", "left_semi")
    return entries.join(made, "entry_id", "left_anti").unionByName(back.select(*entries.columns))


def patch_extra(current: Column, patch: Column) -> Column:
    """A map with another laid over it; an empty value takes its key away."""
    old = F.map_filter(current, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_filter(F.map_concat(old, patch), lambda k, v: v != "")
