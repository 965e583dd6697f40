"""Queries on rules by source, overrides, curation and whole comparisons, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, comparison, curation, filters, paging, quality, templates
from ..session import shared_dir, table
from ..sources import config, sinks
from . import testbed as tb
from .queries import _LINES
from .registry import query
from .store_queries import _ALIGNED, _KEY, STORE

_S = f"WITH {STORE}"
_TEXT = lambda: F.lit(None).cast("string")

# ---- filters: three patterns beside the rule of all sources

_RULES = {
    "default": {"drop_line_regexes": ["^de"], "exclude_line_ranges": ["2"], "case_insensitive": True},
    "sources": {
        "1*": {"exclude_line_ranges": ["3-4"], "drop_before_regex": "[,]"},
        "doc/*7": {"drop_line_regexes": ["s$"], "case_insensitive": False},
        "*[05]": {"drop_after_regex": "^The .*$", "exclude_line_ranges": []},
    },
}
_F1B = rf"""WITH {_LINES}, tagged AS (SELECT source_path, line_no, raw, starts_with(source_path, 'doc/1') AS p1, source_path LIKE 'doc/%7' AS p2, regexp_matches(source_path, '[05]$') AS p3 FROM lines),
marks AS (SELECT source_path, min(line_no) FILTER (p1 AND contains(raw, ',')) AS b, min(line_no) FILTER (p3 AND regexp_matches(raw, '^The .*$', 'i')) AS a FROM tagged GROUP BY 1),
staged AS (SELECT source_path, line_no::INT AS line_no, array_to_string(list_filter([CASE WHEN p1 THEN '1*' END, CASE WHEN p2 THEN 'doc/*7' END, CASE WHEN p3 THEN '*[05]' END], lambda x: x IS NOT NULL), ' ') AS patterns,
  CASE WHEN line_no < b THEN 'before' WHEN line_no >= a THEN 'after' WHEN NOT p3 AND (CASE WHEN p1 THEN line_no IN (3, 4) ELSE line_no = 2 END) THEN 'ranges'
  WHEN CASE WHEN p2 THEN regexp_matches(raw, 's$') ELSE regexp_matches(raw, '^de', 'i') END THEN 'regex' END AS drop_stage FROM tagged JOIN marks USING (source_path))"""


@query("f1b_rules_by_source", f"{_F1B} SELECT source_path, line_no, patterns, drop_stage FROM staged")
def _f1b(spark, d):
    out = filters.filter_sources(tb.raw_lines(spark, d), config.filters_of(_RULES))
    return out.select("source_path", "line_no", F.array_join("rule_patterns", " ").alias("patterns"), "drop_stage")


# ---- overrides in all their forms

_ODD = """WITH d AS (SELECT p_partkey AS k, p_name AS h, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS p, p_brand AS b, p_type AS t FROM part),
r AS (SELECT k, unnest(CASE WHEN k % 8 = 3 THEN [{'h': b, 'p': p, 'd': DEF, 's': 'OK'}, {'h': 'b', 'p': 'q', 'd': 'e', 's': 'OK'}]
  WHEN k % 8 = 4 THEN [{'h': upper(h), 'p': upper(h), 'd': t, 's': 'OK'}] WHEN k % 8 = 7 THEN [{'h': NULL, 'p': NULL, 'd': SKIPPED, 's': 'IGNORED'}] ELSE [{'h': h, 'p': p, 'd': t, 's': 'OK'}] END) AS x FROM d)
SELECT k, x.h AS headword, x.p AS pron, x.d AS definition, x.s AS status FROM r"""


def _overridden(spark, d, preview: bool):
    """Overrides with null, empty, blank and missing entries, edits of one entry, an unknown op and a skip."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    drafts = templates.emit(
        p.select(k.alias("record_key"), "p_name", "p_type"),
        F.array(templates._row(F.col("p_name"), F.when(F.col("record_key") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), F.col("p_type"))),
    )
    entry = lambda h, pr=None, de=None: F.struct(h.alias("headword"), F.lit(pr).cast("string").alias("pron"), F.lit(de).cast("string").alias("definition"))
    two = F.array(F.lit(None), entry(F.concat(F.lit(" "), "p_brand", F.lit(" "))), entry(F.lit("b"), "q", "e"))
    m = k % 8
    entries = F.when(m == 1, F.slice(two, 1, 0)).when(m == 2, F.array(entry(F.lit(" ")))).when(m.isin(3, 5), two)
    op = F.when(m.isin(1, 4), "EDIT_RECORD").when(m == 5, "NOTE").when(m == 7, "SKIP_RECORD").otherwise("SPLIT_RECORD")
    none = F.lit(None).cast("string")
    over = p.where(m != 6).select(k.alias("record_key"), F.lit(2).alias("override_id"), op.alias("op"), entries.alias("entries"), F.when(m == 4, F.upper("p_name")).alias("headword"), *(none.alias(c) for c in ("pron", "definition", "pos")))
    first = over.withColumns({"override_id": F.lit(1), "op": F.lit("SKIP_RECORD")})  # an earlier one, which the last replaces
    out = templates.apply_overrides(drafts, over.unionByName(first), preview)
    return out.select(F.col("record_key").alias("k"), "headword", "pron", "definition", "status")


@query("x13_odd_overrides", _ODD.replace("DEF", "NULL").replace("SKIPPED", "NULL"))
def _x13(spark, d):
    return _overridden(spark, d, True)


@query("x14_odd_overrides", _ODD.replace("DEF", "t").replace("SKIPPED", "t"))
def _x14(spark, d):
    return _overridden(spark, d, False)


# ---- curation


@query("m5_split_fields", f"""{_S}, parts AS (SELECT *, unnest([1, 2]) AS n FROM store WHERE line_no % 3 = 0)
  SELECT entry_id, headword_raw, headword_edit, pron_raw, pron_edit, status, source_path FROM store WHERE line_no % 3 <> 0
  UNION ALL SELECT sha256(dict_id || '|' || source_path || '#split:' || entry_id || ':' || n || '|' || line_no || '|' || (headword_raw || n) || '|' || pos_raw), headword_raw || n, NULL, coalesce(pron_edit, pron_raw), NULL, 'auto', source_path || '#split:' || entry_id || ':' || n FROM parts""")
def _m5(spark, d):
    s = tb.store(spark, d)
    heads = F.array(F.lit(" "), F.concat(F.lit(" "), "headword_raw", F.lit("1 ")), _TEXT(), F.concat("headword_raw", F.lit("2")))
    parts = s.select("entry_id", F.when(F.col("line_no") % 3 == 0, heads).when(F.col("line_no") % 3 == 1, F.slice(heads, 1, 2)).alias("headwords"))
    return curation.split_entries(s, parts).select("entry_id", "headword_raw", "headword_edit", "pron_raw", "pron_edit", "status", "source_path")


@query("m8_undo_events", """WITH log AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'EDIT' WHEN 'view' THEN 'UNDO' WHEN 'purchase' THEN 'VALIDATE' ELSE 'DELETE' END AS op FROM events),
  g AS (SELECT *, count(*) FILTER (op <> 'UNDO') OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM log), u AS (SELECT user_id, grp, count(*) FILTER (op = 'UNDO') AS undos FROM g GROUP BY ALL),
  kept AS (SELECT event_id, user_id, op FROM g JOIN u USING (user_id, grp) WHERE op <> 'UNDO' AND NOT (op IN ('EDIT', 'VALIDATE') AND undos % 2 = 1)),
  last AS (SELECT user_id, max(event_id) FILTER (op = 'EDIT') AS e, bool_or(op = 'VALIDATE') AS v, bool_or(op = 'DELETE') AS x FROM kept GROUP BY 1)
  SELECT c_custkey AS entry_id, e::VARCHAR AS headword_edit, CASE WHEN v THEN 'validated' ELSE 'auto' END AS status, coalesce(x, false) AS is_deleted FROM customer LEFT JOIN last ON c_custkey = user_id""")
def _m8(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), *(_TEXT().alias(c) for c in ("headword_edit", "pron_edit", "definition_edit")), F.lit("auto").alias("status"), F.lit(False).alias("is_deleted"))
    t = F.col("event_type")
    op = F.when(t == "click", "EDIT").when(t == "view", "UNDO").when(t == "purchase", "VALIDATE").otherwise("DELETE")
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("entry_id"), op.alias("op"), F.lit("headword_edit").alias("field"), F.col("event_id").cast("string").alias("value"))
    return curation.replay(e, log).select("entry_id", "headword_edit", "status", "is_deleted")


@query("m9_delete_overrides", """WITH last AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type <> 'click' AND user_id % 7 <> 0 GROUP BY 1)
  SELECT c_custkey AS k, coalesce('x' || e, c_name) AS headword FROM customer LEFT JOIN last ON c_custkey = user_id""")
def _m9(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record_key"), F.col("c_name").alias("raw"))
    drafts = templates.emit(c, F.array(templates._row(F.col("raw"), F.col("raw")))).drop("raw")
    events = table(spark, d, "events")
    over = events.select(F.col("user_id").alias("record_key"), F.col("event_id").alias("override_id"), F.lit("EDIT_RECORD").alias("op"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("headword"))
    left = templates.delete_overrides(over, events.where("event_type = 'click'").select(F.col("event_id").alias("override_id")))
    left = templates.delete_overrides(left, events.where("user_id % 7 = 0").select(F.col("user_id").alias("record_key")))
    return templates.apply_overrides(drafts, left).select(F.col("record_key").alias("k"), "headword")


@query("u33_raw_line_odd", f"""{_S} SELECT entry_id, CASE WHEN line_no % 6 = 0 THEN headword_raw ELSE (CASE WHEN line_no % 4 = 0 THEN 0 ELSE syllables END) || ' ' || headword_raw || ', ' || CASE WHEN line_no % 5 < 2 THEN 'v' ELSE pos_raw END END AS raw_line FROM store""")
def _u33(spark, d):
    n = F.col("line_no")
    pos = F.when(n % 5 == 0, " ").when(n % 5 > 1, F.col("pos_raw"))
    record = F.when(n % 6 == 0, F.concat(F.lit(" "), "headword_raw")).when(n % 6 == 1, " ")
    return tb.store(spark, d).select("entry_id", quality.raw_line(F.when(n % 4 != 0, F.col("syllables")), F.col("headword_raw"), pos, record).alias("raw_line"))


# ---- a whole comparison

_RUN = comparison.Settings(("d0", "d1", "d2"), "d0", "d1", mode="exact")


@query("p8_comparison_letters", f"""{_ALIGNED}, keys AS (SELECT DISTINCT {_KEY} AS headword_key FROM shown WHERE NOT is_deleted),
  rows AS (SELECT 'coverage' AS tab, headword_key FROM keys UNION ALL SELECT 'alignment', headword_key FROM aligned UNION ALL SELECT 'diff', headword_key FROM aligned WHERE method = 'exact')
  SELECT tab, upper(headword_key[1]) AS bucket, count(*) AS n FROM rows GROUP BY ALL""")
def _p8(spark, d):
    out = None
    for name, df in comparison.letters(comparison.run_comparison(tb.store(spark, d), _RUN)).items():
        one = df.select(F.lit(name).alias("tab"), "bucket", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("p7_diff_by_settings", f"{_ALIGNED} SELECT headword_key, entry_id_a, entry_id_b FROM aligned WHERE method = 'exact' AND upper(headword_key[1]) = 'B'")
def _p7(spark, d):
    return comparison.difference(tb.store(spark, d).where(filters.not_deleted()), settings=_RUN, bucket="b").select("headword_key", "entry_id_a", "entry_id_b")


# ---- stores and pages: what is written lies in a new folder, so these have no SQL; tests hold them against a brute-force version


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("l1_page_by_rank")
def _l1(spark, d):
    """The last full hundred of all entries, by the index."""
    path = _folder(spark, "pages")
    paging.build_pages(tb.entries(spark, d), ["dict_id", "line_no", "entry_id"], path)
    return paging.read_page(spark, path, 100, max(1, paging.count_rows(spark, path) // 100)).select("rank", "dict_id", "line_no", "entry_id")


@query("k1_store_upsert")
def _k1(spark, d):
    """A store after two upserts: of all entries, then of a third of them with new headwords."""
    path, s = _folder(spark, "store"), tb.store(spark, d)
    sinks.upsert_entries(s, path)
    sinks.upsert_entries(s.where("line_no % 3 = 0").withColumn("headword_raw", F.upper("headword_raw")), path)
    return sinks.read_entries(spark, path).select("entry_id", "headword_raw", "headword_edit", "status", "is_deleted")


@query("a19_second_run", """WITH a AS (SELECT lower(p_name) AS label, p_partkey::VARCHAR AS entry_id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)),
  b AS (SELECT p_brand AS label, p_partkey::VARCHAR AS entry_id FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1))
  SELECT sha256(label) AS group_id, label, entry_id FROM (FROM a UNION FROM b)""")
def _a19(spark, d):
    """Clusters by name, then those by brand committed over them."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.lower("p_name").alias("name"), F.col("p_brand").alias("brand"))

    def run(by: str):
        first = p.groupBy(by).agg(F.min("entry_id").alias("entry_id_a"))
        links = p.join(first, by).select("entry_id_a", F.col("entry_id").alias("entry_id_b"), F.lit(100.0).alias("score"))
        return compare.cluster(links, p.select("entry_id", F.col(by).alias("label")))

    return compare.commit_clusters(run("name"), run("brand")).select("group_id", "label", "entry_id")
