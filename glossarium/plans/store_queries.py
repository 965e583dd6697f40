"""Queries over a store of entries: listing, counts, comparison and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, filters, listing, parsing, quality, templates
from ..session import table
from ..sources import readers, sinks
from . import testbed as tb
from .queries import _ISSUE_CASES, _LINES, _PART, _TOKENS
from .registry import query

_K = "p_partkey"
STORE = f"""store AS (SELECT {_K}::VARCHAR AS entry_id, 'd' || {_K} % 3 AS dict_id, p_brand AS section, 'part/' || p_brand AS source_path, {_K}::INT AS line_no, (p_size % 12)::INT AS syllables,
  p_name AS headword_raw, CASE WHEN {_K} % 5 = 0 THEN upper(p_name) WHEN {_K} % 5 = 1 THEN ' ' END AS headword_edit, ['a', 'v', 'p', 's', 'x'][{_K} % 5 + 1] AS pos_raw,
  CASE WHEN {_K} % 4 <> 0 THEN p_type END AS pron_raw, CASE WHEN {_K} % 7 = 0 THEN lower(p_type) END AS pron_edit, p_brand AS definition_raw, NULL::VARCHAR AS definition_edit,
  CASE WHEN {_K} % 3 = 0 THEN p_name END AS form_display, CASE WHEN {_K} % 2 = 0 THEN lower(p_name) ELSE '' END AS form_norm, CASE WHEN {_K} % 8 = 0 THEN lower(p_name) END AS headword_norm,
  CASE WHEN {_K} % 6 = 0 THEN lower(p_type) END AS pron_norm, CASE WHEN {_K} % 9 = 0 THEN p_type END AS pron_render,
  CASE WHEN {_K} % 13 = 0 THEN '{{bad' WHEN {_K} % 13 = 1 THEN '[1]' ELSE '{{"prime_count":' || {_K} % 3 || ',"accented_vowel_count":' || {_K} % 4 || ',"stress":"' || CASE WHEN {_K} % 2 = 0 THEN 'primary' ELSE 'none' END || '"}}' END AS features_json,
  CASE {_K} % 4 WHEN 1 THEN 'reviewed' WHEN 2 THEN 'validated' ELSE 'auto' END AS status, {_K} % 11 = 0 AS is_deleted, {_K} % 10 = 0 AS manual_created,
  CASE WHEN {_K} % 3 <> 0 THEN ({_K} % 50)::INT END AS page, CASE WHEN {_K} % 17 = 0 THEN ' ' ELSE upper(p_name[1]) END AS alpha_bucket FROM part),
shown AS (SELECT *, coalesce(nullif(trim(headword_edit), ''), headword_raw) AS head, coalesce(nullif(trim(pron_edit), ''), pron_raw, '') AS pron FROM store)"""
_S = f"WITH {STORE}"
_I = f"WITH {_PART}, {_ISSUE_CASES}, tagged AS (SELECT *, 'd' || line_no % 3 AS dict_id FROM issues)"


# ---- listing and counts


@query("s12_entries_of", f"{_S} SELECT entry_id, line_no FROM store WHERE dict_id = 'd1' AND NOT is_deleted")
def _s12(spark, d):
    return listing.entries_of(tb.store(spark, d), "d1").select("entry_id", "line_no")


@query("s13_by_id", f"{_S} SELECT entry_id, head AS headword FROM shown WHERE entry_id IN ('5', '17', 'none')")
def _s13(spark, d):
    e = listing.by_id(tb.store(spark, d), "5", "17", "none")
    return e.select("entry_id", compare.effective("headword", e.columns).alias("headword"))


@query("f7_touched", f"{_S} SELECT entry_id FROM store WHERE manual_created OR status <> 'auto' OR trim(coalesce(headword_edit, '')) <> '' OR trim(coalesce(pron_edit, '')) <> ''")
def _f7(spark, d):
    return tb.store(spark, d).where(filters.touched_by_hand()).select("entry_id")


@query("f10_bucket", f"{_S} SELECT entry_id FROM store WHERE alpha_bucket = 'R'")
def _f10(spark, d):
    return tb.store(spark, d).where(listing.in_bucket(" r")).select("entry_id")


@query("f11_not_deleted", f"{_S} SELECT entry_id FROM store WHERE NOT is_deleted")
def _f11(spark, d):
    return tb.store(spark, d).where(filters.not_deleted()).select("entry_id")


@query("a1_count_entries", f"{_S} SELECT dict_id, count(*) AS n FROM store WHERE NOT is_deleted AND alpha_bucket = 'S' GROUP BY 1")
def _a1(spark, d):
    return listing.count_entries(tb.store(spark, d).where(listing.in_bucket("S")))


@query("a2_bucket_counts", f"{_S} SELECT coalesce(nullif(trim(alpha_bucket), ''), '#') AS bucket, count(*) AS n FROM store GROUP BY 1")
def _a2(spark, d):
    return listing.bucket_counts(tb.store(spark, d))


@query("a3_count_issues", f"{_I} SELECT dict_id, count(*) AS n FROM tagged GROUP BY 1")
def _a3(spark, d):
    return listing.count_issues(tb.all_issues(spark, d))


@query("a16_next_line", f"{_S} SELECT dict_id, max(line_no) + 1 AS line_no FROM store GROUP BY 1")
def _a16(spark, d):
    return listing.next_line_no(tb.store(spark, d))


@query("a18_diagnostics", f"{_I}, {STORE} SELECT dict_id, e.n AS entries, i.n AS issues, i.u AS unknown FROM (SELECT dict_id, count(*) AS n FROM store WHERE NOT is_deleted GROUP BY 1) e JOIN (SELECT dict_id, count(*) AS n, count(*) FILTER (code = 'UNKNOWN_SYMBOL') AS u FROM tagged GROUP BY 1) i USING (dict_id)")
def _a18(spark, d):
    return listing.diagnostics(tb.store(spark, d), tb.all_issues(spark, d))


@query("l5_newest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def _l5(spark, d):
    return listing.newest(table(spark, d, "events"), 30, "ts", "event_id").select("event_id", "event_type")


@query("l8_capped", f"{_S}, c AS (SELECT * FROM store WHERE syllables = 7), f AS (SELECT entry_id FROM c ORDER BY line_no LIMIT 10) SELECT entry_id, (SELECT count(*) FROM c) AS count FROM f")
def _l8(spark, d):
    first, count = listing.capped(tb.store(spark, d).where(filters.syllables_equal(F.col("syllables").cast("string"), 7)), ["line_no"], 10)
    return first.select("entry_id").crossJoin(count)  # one row


@query("w4_active_template", "SELECT user_id AS corpus_id, arg_max(value, event_id) AS params FROM events WHERE event_type = 'click' GROUP BY 1")
def _w4(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("corpus_id"), F.col("event_id").alias("id"), F.col("value").alias("params"), (F.col("event_type") == "click").alias("is_active"))
    return listing.latest_active(e).select("corpus_id", "params")


_GROUPS = "members AS (SELECT p_brand AS label, sha256(p_brand) AS group_id, 'd' || p_partkey % 3 AS dict_id, p_partkey::VARCHAR AS entry_id FROM part WHERE p_partkey % 2 = 0)"
_VALUE = "coalesce(nullif(pron_render, ''), nullif(form_display, ''), nullif(form_norm, ''), '')"


def _members(spark, d):
    m = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("label"), F.sha2("p_brand", 256).alias("group_id"), F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string")).alias("dict_id"), F.col("p_partkey").cast("string").alias("entry_id"))
    return m.select("group_id", "label").distinct(), m.select("group_id", "dict_id", "entry_id")


@query("j8_comparison_rows", f"{_S}, {_GROUPS} SELECT label, m.dict_id, {_VALUE} AS value, m.entry_id FROM members m JOIN store USING (entry_id) WHERE m.dict_id IN ('d0', 'd1')")
def _j8(spark, d):
    groups, members = _members(spark, d)
    return listing.comparison_rows(groups, members, tb.store(spark, d), ["d0", "d1"]).select("label", "dict_id", "value", "entry_id")


@query("l6_comparison_order", f"{_S}, {_GROUPS} SELECT label, m.dict_id FROM members m JOIN store USING (entry_id) ORDER BY 1, 2 LIMIT 50")
def _l6(spark, d):
    groups, members = _members(spark, d)
    return listing.comparison_rows(groups, members, tb.store(spark, d), ["d0", "d1", "d2"]).limit(50).select("label", "dict_id")


# ---- comparison

_KEY = "lower(trim(regexp_replace(coalesce(nullif(trim(headword_norm), ''), nullif(trim(form_norm), ''), head), '\\s+', ' ', 'g')))"
_FIRSTS = f"{_S}, firsts AS (SELECT *, {_KEY} AS headword_key FROM shown WHERE NOT is_deleted AND dict_id IN ('d0', 'd1') QUALIFY row_number() OVER (PARTITION BY dict_id, headword_key ORDER BY line_no, entry_id) = 1), a AS (SELECT * FROM firsts WHERE dict_id = 'd0'), b AS (SELECT * FROM firsts WHERE dict_id = 'd1')"
_ALIGNED = f"""{_FIRSTS}, aligned AS (
  SELECT headword_key, a.entry_id AS entry_id_a, b.entry_id AS entry_id_b, a.head AS headword_a, b.head AS headword_b, a.status AS status_a, b.status AS status_b, 100.0::DOUBLE AS score, 'exact' AS method, '' AS reason FROM a JOIN b USING (headword_key)
  UNION ALL SELECT headword_key, entry_id, NULL, head, NULL, status, NULL, 0, 'none', 'no_match' FROM a ANTI JOIN b USING (headword_key)
  UNION ALL SELECT headword_key, NULL, entry_id, NULL, head, NULL, status, 0, 'none', 'no_match' FROM b ANTI JOIN a USING (headword_key))"""


def _sides(spark, d):
    e = compare.with_key(tb.store(spark, d).where(filters.not_deleted()))
    return tuple(compare.first_per_key(e.where(F.col("dict_id") == c)) for c in ("d0", "d1"))


def _aligned(spark, d):
    a, b = _sides(spark, d)
    return compare.aligned_rows(compare.align(a, b, fuzzy=False), a, b)


@query("p6_alignment", f"{_ALIGNED} SELECT * FROM aligned")
def _p6(spark, d):
    return _aligned(spark, d).select("headword_key", "entry_id_a", "entry_id_b", "headword_a", "headword_b", "status_a", "status_b", "score", "method", "reason")


@query("l2_alignment_order", f"{_ALIGNED} SELECT headword_key, method FROM aligned ORDER BY method <> 'exact', score DESC, headword_key LIMIT 25")
def _l2(spark, d):
    return _aligned(spark, d).orderBy(*compare.alignment_order()).limit(25).select("headword_key", "method")


@query("a9_alignment_counts", f"{_ALIGNED} SELECT (SELECT count(*) FROM a) AS total_a, (SELECT count(*) FROM b) AS total_b, count(*) FILTER (method = 'exact') AS matched_exact, 0::BIGINT AS matched_fuzzy, count(*) FILTER (method = 'none') AS unmatched FROM aligned")
def _a9(spark, d):
    return compare.alignment_counts(compare.align(*_sides(spark, d), fuzzy=False))


@query("a6_letter_counts", f"{_ALIGNED} SELECT upper(headword_key[1]) AS bucket, count(*) AS n FROM aligned WHERE method = 'exact' GROUP BY 1")
def _a6(spark, d):
    return compare.letter_counts(_aligned(spark, d).where("method = 'exact'"))


@query("a8_stored_letters", f"{_ALIGNED} SELECT upper(headword_key[1]) AS bucket, count(*) AS n FROM aligned GROUP BY 1")
def _a8(spark, d):
    return listing.bucket_counts(_aligned(spark, d).withColumn("alpha_bucket", T.stored_bucket(F.col("headword_key"))))


@query("l4_coverage_page", f"{_S}, c AS (SELECT {_KEY} AS headword_key, bool_or(dict_id = 'd0') AS in_d0, bool_or(dict_id = 'd2') AS in_d2 FROM shown WHERE dict_id IN ('d0', 'd2') GROUP BY 1) SELECT * FROM c ORDER BY 1 LIMIT 20")
def _l4(spark, d):
    return compare.coverage(compare.with_key(tb.store(spark, d)), ["d0", "d2"]).orderBy("headword_key").limit(20)


_OBJ = "json_valid(features_json) AND json_type(CASE WHEN json_valid(features_json) THEN features_json ELSE '{}' END) = 'OBJECT'"
_DIFF = f"""{_S}, one AS (SELECT *, CASE WHEN {_OBJ} THEN features_json ELSE '{{}}' END AS f,
    coalesce(nullif(trim(pron_norm), ''), nullif(trim(form_norm), ''), lower(pron), '') AS pn, coalesce(nullif(trim(pron_render), ''), nullif(trim(form_display), ''), '') AS pr FROM shown),
  num AS (SELECT *, coalesce((f->>'$.prime_count')::INT, 0) AS pc, coalesce((f->>'$.accented_vowel_count')::INT, 0) AS ac, f->>'$.stress' AS st FROM one),
  diff AS (SELECT a.entry_id AS entry_id_a, b.entry_id AS entry_id_b, a.headword_raw AS headword_key, a.pn AS pron_norm_a, b.pn AS pron_norm_b, a.pr AS pron_render_a, b.pr AS pron_render_b, a.f AS features_a, b.f AS features_b,
    a.syllables - b.syllables AS syll_count_diff, a.st IS DISTINCT FROM b.st AS stress_schema_diff, a.pc - b.pc AS prime_count_diff, a.ac - b.ac AS accented_vowel_count_diff
    FROM num a JOIN num b ON b.line_no = a.line_no + 3 WHERE a.line_no % 2 = 0 OR a.line_no % 7 = 0)"""


def _diff(spark, d):
    s = tb.store(spark, d)
    pairs = s.where("line_no % 2 = 0 or line_no % 7 = 0").select(F.col("entry_id").alias("entry_id_a"), (F.col("line_no") + 3).cast("string").alias("entry_id_b"), F.col("headword_raw").alias("headword_key"))
    return compare.diff_rows(pairs, s)


@query("p7_diff", f"{_DIFF} SELECT * FROM diff")
def _p7(spark, d):
    return _diff(spark, d)


@query("f13_diff_filter", f"{_DIFF} SELECT entry_id_a, entry_id_b FROM diff WHERE pron_render_a <> pron_render_b")
def _f13(spark, d):
    return _diff(spark, d).where(compare.difference_filter("pron_render_diff")).select("entry_id_a", "entry_id_b")


@query("a10_diff_counts", f"{_DIFF} SELECT count(*) AS total_pairs, count(*) FILTER (pron_render_a <> pron_render_b) AS pron_render_diff, count(*) FILTER (syll_count_diff <> 0) AS syll_count_diff, count(*) FILTER (stress_schema_diff) AS stress_diff FROM diff")
def _a10(spark, d):
    return compare.diff_counts(_diff(spark, d))


@query("l3_match_order", "WITH m AS (SELECT a.p_partkey::VARCHAR AS entry_id_a, b.p_partkey::VARCHAR AS entry_id_b, a.p_name AS label_a FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_partkey < 60 AND b.p_partkey >= 60) SELECT entry_id_a, entry_id_b FROM m ORDER BY label_a, entry_id_a, entry_id_b LIMIT 40")
def _l3(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("form_norm"))
    m = compare.match_entries(p.where("line_no < 60"), p.where("line_no >= 60"), 100.0)
    m = m.join(p.select(F.col("entry_id").alias("entry_id_a"), F.col("form_norm").alias("label_a")), "entry_id_a")
    return m.orderBy(*compare.match_order()).limit(40).select("entry_id_a", "entry_id_b")


@query("a19_cluster", """SELECT sha256(lower(p_name)) AS group_id, lower(p_name) AS label, p_partkey::VARCHAR AS entry_id, 100.0::DOUBLE AS score, 'auto' AS status FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)""")
def _a19(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.lower("p_name").alias("label"))
    first = p.groupBy("label").agg(F.min("entry_id").alias("entry_id_a"))
    links = p.join(first, "label").select("entry_id_a", F.col("entry_id").alias("entry_id_b"), F.lit(95.0).alias("score"))
    return compare.cluster(links, p)


@query("g2_validated", "SELECT least(lower(a.p_name), lower(b.p_name)) AS label, sha256(least(lower(a.p_name), lower(b.p_name))) AS group_id, unnest([a.p_partkey::VARCHAR, b.p_partkey::VARCHAR]) AS entry_id, 87.5::DOUBLE AS score, 'validated' AS status FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 10 = 0")
def _g2(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("label_a"))
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("label_b"))
    return compare.validated_pairs(a.join(b, "k").select(F.col("k").cast("string").alias("entry_id_a"), (F.col("k") + 1).cast("string").alias("entry_id_b"), "label_a", "label_b", F.lit(87.5).alias("score")))


# ---- exports

_EFFECTIVE = """e AS (SELECT *, coalesce(nullif(headword_edit, ' '), headword_raw) AS headword_effective, coalesce(pron_edit, pron_raw, '') AS pron_effective FROM store),
  x AS (SELECT *, CASE WHEN headword_effective <> headword_raw OR pron_effective <> coalesce(pron_raw, '') THEN coalesce(nullif(pron_effective, ''), headword_effective) ELSE coalesce(nullif(form_display, ''), nullif(pron_effective, ''), headword_effective) END AS shown_form FROM e)"""
_FIELD = {
    "definition_effective": "definition_raw", "form_display_effective": "shown_form", "form_norm_effective": "coalesce(nullif(form_norm, ''), lower(shown_form))",
} | {c: "NULL" for c in ("origin_raw", "origin_norm", "pos_norm", "parser_id", "parser_version", "parser_sha256", "source_record", "source_id", "record_key", "template_id", "template_version", "template_sha256", "profile_id", "profile_version", "profile_sha256", "created_at")}


@query("k3_entry_fields", f"{_S}, {_EFFECTIVE} SELECT " + ", ".join(f"coalesce({_FIELD.get(c, c)}::VARCHAR, '') AS {c}" for c in sinks.ENTRY_FIELDS) + " FROM x")
def _k3(spark, d):
    return sinks.export_fields(tb.store(spark, d))


@query("k4_jsonl", f"{_S}, {_EFFECTIVE} SELECT entry_id, headword_effective, pron_effective, status, features_json FROM x")
def _k4(spark, d):
    lines = sinks.export_fields(tb.store(spark, d)).select(F.to_json(F.struct("*")).alias("value"))
    get = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return lines.select(*map(get, ("entry_id", "headword_effective", "pron_effective", "status", "features_json")))


@query("k5_issue_fields", f"{_I} SELECT dict_id, source_path, line_no, kind, code, raw, '{{\"line\":\"' || line_no || '\",\"n\":\"' || length(raw) || '\"}}' AS details_json, '' AS created_at FROM tagged")
def _k5(spark, d):
    i = tb.all_issues(spark, d)
    details = F.create_map(F.lit("n"), F.length("raw").cast("string"), F.lit("line"), F.col("line_no").cast("string"))
    return sinks.export_issues(i.withColumn("details", details))


@query("k7_alignment_fields", f"{_ALIGNED} SELECT headword_key, '' AS headword_a, '' AS headword_b, CASE WHEN entry_id_a IS NULL THEN '' ELSE headword_key END AS headword_norm_a, CASE WHEN entry_id_b IS NULL THEN '' ELSE headword_key END AS headword_norm_b, coalesce(entry_id_a, '') AS entry_id_a, coalesce(entry_id_b, '') AS entry_id_b, coalesce(status_a, '') AS status_a, coalesce(status_b, '') AS status_b, score, method, reason FROM aligned")
def _k7(spark, d):
    return sinks.export_alignment(_aligned(spark, d))


@query("k8_diff_fields", f"{_DIFF} SELECT headword_key, entry_id_a, entry_id_b, pron_render_a, pron_render_b, pron_norm_a, pron_norm_b, features_a AS features_a_json, features_b AS features_b_json, '{{\"accented_vowel_count_diff\":' || accented_vowel_count_diff || ',\"prime_count_diff\":' || prime_count_diff || ',\"stress_schema_diff\":' || stress_schema_diff || ',\"syll_count_diff\":' || syll_count_diff || '}}' AS delta_json FROM diff")
def _k8(spark, d):
    return sinks.export_diff(_diff(spark, d))


_MATRIX = """m AS (SELECT p_brand AS label, sha256(p_brand) AS group_id, coalesce(arg_max(p_name, p_partkey) FILTER (p_partkey % 3 = 0), 'ABSENT') AS d0, coalesce(arg_max(p_name, p_partkey) FILTER (p_partkey % 3 = 1), 'ABSENT') AS d1 FROM part GROUP BY 1)"""


def _matrix(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("label"), F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string")).alias("dict_id"), F.col("p_name").alias("value"), F.col("p_partkey").alias("ord"))
    return compare.matrix(p, ["d0", "d1"]).withColumn("group_id", F.sha2("label", 256))


@query("k9_matrix_flags", f"{_I}, {_MATRIX} SELECT 'lemma_groups' AS metric, count(*)::VARCHAR AS value FROM m UNION ALL SELECT 'dictionaries', 'd0, d1' UNION ALL (SELECT 'issue:' || code || ':' || kind, count(*)::VARCHAR FROM tagged GROUP BY code, kind)")
def _k9(spark, d):
    return sinks.matrix_flags(_matrix(spark, d), tb.all_issues(spark, d), ["d0", "d1"])


@query("k10_matrix_list", f"WITH {_MATRIX} SELECT label, 0 AS k, label || ' (' || group_id[:8] || ')' AS line FROM m UNION ALL SELECT label, 1, 'd0: ' || d0 FROM m UNION ALL SELECT label, 2, 'd1: ' || d1 FROM m")
def _k10(spark, d):
    return sinks.matrix_lines(_matrix(spark, d), ["d0", "d1"], True)


@query("k11_matrix_table", f"WITH {_MATRIX} SELECT label, 0 AS k, group_id || chr(9) || label || chr(9) || d0 || chr(9) || d1 AS line FROM m")
def _k11(spark, d):
    return sinks.matrix_lines(_matrix(spark, d), ["d0", "d1"])


@query("k13_selection", f"{_I}, {STORE}, {_EFFECTIVE} SELECT entry_id, headword_effective, pron_effective, definition_raw AS definition_effective, status, (SELECT count(*) FROM tagged t WHERE t.source_path = x.source_path AND t.line_no = x.line_no)::VARCHAR AS flags FROM x WHERE entry_id IN ('7', '14', '97')")
def _k13(spark, d):
    return sinks.export_selection(tb.store(spark, d), tb.all_issues(spark, d), ["7", "14", "97"])


@query("m14_rehydrate", f"{_ALIGNED} SELECT headword_key, entry_id_a, entry_id_b, headword_a, headword_b, status_a, status_b FROM aligned")
def _m14(spark, d):
    s = tb.store(spark, d).withColumn("headword_edit", F.nullif(F.trim("headword_edit"), F.lit("")))
    return sinks.rehydrate(_aligned(spark, d), s).select("headword_key", "entry_id_a", "entry_id_b", "headword_a", "headword_b", "status_a", "status_b")


# ---- sources


@query("s9_line_pages", """WITH l AS (SELECT 'c/' || conv_id AS source_path, (turn + 1)::INT AS line_no, conv_id, turn FROM conversations), g AS (SELECT source_path, count(*) = count(*) FILTER (NOT (conv_id % 3 = 0 AND turn = 0)) AND count(*) FILTER (conv_id % 5 = 0 AND turn = 1) = 0 AS ok FROM l GROUP BY 1)
  SELECT source_path, line_no, CASE WHEN ok THEN turn * 2 END AS page FROM l JOIN g USING (source_path)""")
def _s9(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("c/"), "conv_id").alias("source_path"), (F.col("turn") + 1).cast("int").alias("line_no"), "conv_id", "turn")
    pages = c.where("not (conv_id % 3 = 0 and turn = 0)").select("source_path", "line_no", F.expr("case when not (conv_id % 5 = 0 and turn = 1) then turn * 2 end").alias("page"))
    return readers.with_pages(c.select("source_path", "line_no"), pages)


@query("s14_lexicon", rf"WITH {_LINES} SELECT DISTINCT lower(trim(raw)) AS token FROM lines WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')")
def _s14(spark, d):
    return readers.lexicon(tb.raw_lines(spark, d))


@query("s17_csv_columns", "SELECT DISTINCT unnest(CASE WHEN p_partkey % 2 = 0 THEN ['name', p_type] ELSE ['name'] END) AS column FROM part")
def _s17(spark, d):
    p = table(spark, d, "part")
    row = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("name"), F.col("p_name"), F.col("p_type"), F.lit(""))).otherwise(F.create_map(F.lit("name"), F.col("p_name")))
    return templates.csv_columns(p.select(row.alias("csv_row")))


_SUFFIX = "['.txt', '.CSV', '.zip', '.pdf', '.Tif', '.md', '', '.tar.jpeg']"


@query("s18_dropped_paths", f"SELECT DISTINCT '/in/' || p_name || {_SUFFIX}[p_partkey % 8 + 1] AS path, ['text', 'csv', 'zip', 'pdf', 'image', 'other', 'other', 'image'][p_partkey % 8 + 1] AS kind FROM part")
def _s18(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".CSV", ".zip", ".pdf", ".Tif", ".md", "", ".tar.jpeg"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return readers.dropped_paths(table(spark, d, "part").select(F.concat(F.lit("/in/"), "p_name", suffix).alias("path")))


@query("a20_page_stats", r"WITH p AS (SELECT conv_id, sum(length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')))::BIGINT AS n FROM conversations GROUP BY 1) SELECT count(*) AS pages_total, count(*) FILTER (n >= 100) AS pages_with_text, sum(n)::BIGINT AS chars, NULL::VARCHAR AS code FROM p")
def _a20(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return readers.page_stats(c, 100)


@query("s8_page_text", "SELECT 'book' AS source_path, row_number() OVER (ORDER BY conv_id, turn)::INT AS line_no, coalesce(text, '') AS raw, conv_id AS page FROM conversations")
def _s8(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.lit(0).alias("col"), F.col("turn").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    return readers.page_text(c, "book")


@query("x12_summary", f"WITH {_LINES}, {_TOKENS} SELECT dict_id, count(*) FILTER (reason IS NULL) AS ok, 0::BIGINT AS unrecognized, count(*) FILTER (reason IS NOT NULL) AS ignored FROM drafts GROUP BY 1")
def _x12(spark, d):
    return templates.summarize(templates.wordlist(tb.raw_lines(spark, d)), "dict_id")


@query("a13_issues_by_code", f"WITH {_LINES}, {_TOKENS} SELECT reason AS code, count(*) AS n FROM drafts WHERE reason IS NOT NULL GROUP BY 1")
def _a13(spark, d):
    return quality.by_code(quality.template_issues(templates.wordlist(tb.raw_lines(spark, d)), F.col("dict_id")))


@query("x2_sections", "SELECT p_partkey, replace(replace(replace(replace(upper(p_name), 'U', 'Y'), 'W', 'TH'), 'F', 'PH'), 'Q', 'PS') AS section FROM part")
def _x2(spark, d):
    greek = F.translate("p_name", "abgdezhiklmnxoprstuwfq", "αβγδεζηικλμνξοπρστυθφψ")
    return table(spark, d, "part").select("p_partkey", parsing.section_name(greek).alias("section"))
