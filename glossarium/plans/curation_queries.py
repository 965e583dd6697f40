"""Queries on profiles, quality, curation and whole runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles
from ..functions import text as T
from ..operators import curation, filters, listing, quality, templates, workflows
from ..session import table
from . import testbed as tb
from .queries import _ISSUE_CASES, _PART
from .registry import query
from .store_queries import STORE

_S = f"WITH {STORE}"


def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name")


# ---- functions


@query("u3_map_chars", "SELECT p_partkey, replace(replace(replace(p_name, 'e', 'i'), 'a', 'ae'), 'r', '') AS mapped FROM part")
def _u3(spark, d):
    return _names(spark, d).select("p_partkey", T.map_chars(F.col("p_name"), {"a": "ae", "e": "i", "r": ""}).alias("mapped"))


@query("u4_primes", "SELECT p_partkey, replace(p_name, ' ', 'ʹ') AS primed FROM part")
def _u4(spark, d):
    mark = F.element_at(F.array(*map(F.lit, T.APOSTROPHES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _names(spark, d).select("p_partkey", T.primes(F.replace("p_name", F.lit(" "), mark)).alias("primed"))


_PRIMED = "CASE p_partkey % 3 WHEN 0 THEN 'ʹ' || p_name || 'ʹ' WHEN 1 THEN replace(p_name, ' ', 'ʹ') ELSE p_name END"


def _primed(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    return _names(spark, d).withColumn("t", F.when(k % 3 == 0, F.concat(F.lit("ʹ"), name, F.lit("ʹ"))).when(k % 3 == 1, F.replace(name, F.lit(" "), F.lit("ʹ"))).otherwise(name))


@query("u9_prime_parens", rf"SELECT p_partkey, replace(regexp_replace(regexp_replace({_PRIMED}, 'ʹ(.+?)ʹ', '(\1)', 'g'), '(\S)ʹ', '(\1)', 'g'), 'ʹ', '') AS rendered FROM part")
def _u9(spark, d):
    t = _primed(spark, d)
    return t.select("p_partkey", profiles.render(F.col("t"), F.col("t"), profiles.Profile(paren_primes=True)).alias("rendered"))


@query("u10_render", r"SELECT p_partkey, regexp_replace(p_name, '([ae])', '[\1]', 'g') AS rendered, lower(p_name) AS plain FROM part")
def _u10(spark, d):
    p = profiles.Profile(render_source="display", paren_accents=True, acute_vowels="ae", open_paren="[", close_paren="]")
    off = profiles.Profile(render_enabled=False, paren_accents=True, acute_vowels="ae")
    name = F.col("p_name")
    return _names(spark, d).select("p_partkey", profiles.render(name, F.lit("no"), p).alias("rendered"), profiles.render(name, F.lower(name), off).alias("plain"))


@query("u11_detached", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS n FROM part")
def _u11(spark, d):
    k, name, mark = F.col("p_partkey"), F.col("p_name"), F.lit("́")
    t = F.when(k % 4 == 0, F.concat(mark, name)).when(k % 4 == 1, F.concat(name, F.lit(" "), mark)).when(k % 4 == 2, F.concat(name, mark)).otherwise(F.concat(mark, mark, name))
    return _names(spark, d).select("p_partkey", F.coalesce(profiles.detached_marks(t), F.lit(0)).alias("n"))


@query("u12_symbols_used", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '!%?' ELSE '-' END AS symbols FROM part")
def _u12(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("?!%!"))).otherwise(F.concat(F.lit("-"), "p_name", F.lit("- 1")))
    return _names(spark, d).select("p_partkey", F.array_join(profiles.symbols_used(t), "").alias("symbols"))


@query("u14_unknown_symbols", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '!?' ELSE '' END AS symbols FROM part")
def _u14(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("?!%☃*"))).otherwise(F.concat("p_name", F.lit("-ʹ*")))
    p = profiles.Profile(allowed_symbols="%", inventory=("☃",), char_map={"*": "x"})
    return _names(spark, d).select("p_partkey", F.array_join(profiles.unknown_symbols(t, p), "").alias("symbols"))


@query("u15_primary_stress", "SELECT p_partkey, (length(p_name) - length(replace(p_name, 'e', '')) + CASE WHEN p_name[-1] = 'e' THEN 0 ELSE 1 END)::INT AS n FROM part")
def _u15(spark, d):
    t = F.concat(F.replace("p_name", F.lit("e"), F.lit("é")), F.lit("ʹ"))
    return _names(spark, d).select("p_partkey", profiles.primary_stress(t, profiles.Profile()).alias("n"))


@query("u26_derived", f"{_S} SELECT entry_id, upper(p[1]) AS alpha_bucket, form_norm AS pron_norm, form_display AS pron_render FROM (SELECT *, coalesce(nullif(trim(headword_norm), ''), nullif(trim(headword_edit), ''), headword_raw) AS p FROM store)")
def _u26(spark, d):
    return curation.derived(tb.store(spark, d).withColumn("form_render", F.col("form_display"))).select("entry_id", "alpha_bucket", "pron_norm", "pron_render")


@query("u33_raw_line", f"{_S} SELECT entry_id, syllables || ' ' || headword_raw || ', ' || pos_raw AS raw_line FROM store")
def _u33(spark, d):
    return tb.store(spark, d).select("entry_id", quality.raw_line(F.col("syllables"), F.col("headword_raw"), F.col("pos_raw")).alias("raw_line"))


# ---- quality; what profiles make of the marked store

_P = profiles.Profile("strict", 2, allowed_symbols="%", enforce_stress_consistency=True, require_prime=True, require_acute=True, require_pronunciation=True, acute_vowels="é")
_TEXT = "CASE line_no % 5 WHEN 0 THEN replace(headword_raw, 'e', 'é') WHEN 1 THEN headword_raw || '''' WHEN 2 THEN '́' || headword_raw WHEN 3 THEN headword_raw || '☃%' ELSE headword_raw END"
_MARKED = f"""marked AS (SELECT * REPLACE ({_TEXT} AS headword_raw, NULL AS headword_edit, NULL AS pron_edit, CASE WHEN line_no % 4 = 0 THEN headword_raw END AS pron_raw) FROM store),
  seen AS (SELECT *, coalesce(pron_raw, '') AS pe, coalesce(pron_raw, headword_raw) AS t FROM marked),
  counts AS (SELECT *, length(t) - length(replace(t, 'é', '')) AS acc, (contains(t, ''''))::INT AS pr, starts_with(t, '́') AS det, contains(t, '☃') AS odd FROM seen),
  alerts AS (SELECT *, list_filter([CASE WHEN conv AND NOT syllables BETWEEN 1 AND 10 THEN 'BAD_SYLL_COUNT' END, CASE WHEN det THEN 'DETACHED_COMBINING_MARK' END, CASE WHEN (acc > 0 AND pr = 0) OR (pr > 0 AND acc = 0) THEN 'INCONSISTENT_STRESS' END,
    CASE WHEN conv AND pe = '' THEN 'MISSING_PRON' END, CASE WHEN acc + pr > 1 THEN 'MULTIPLE_PRIMARY_STRESS' END, CASE WHEN det OR odd THEN 'UNKNOWN_SYMBOL' END], lambda c: c IS NOT NULL) AS codes FROM counts, (SELECT unnest([true, false]) AS conv))"""


@query("q6_profile_issues", f"{_S}, {_MARKED} SELECT dict_id, line_no, unnest(codes) AS code, 'warning' AS kind, syllables || ' ' || headword_raw || ', ' || pos_raw AS raw FROM alerts WHERE NOT conv")
def _q6(spark, d):
    return workflows.apply_profile_to_entries(tb.marked(spark, d), _P)[1].select("dict_id", "line_no", "code", "kind", "raw")


@query("u19_warnings", f"{_S}, {_MARKED} SELECT entry_id, array_to_string(codes, ' ') AS warnings FROM alerts WHERE NOT conv")
def _u19(spark, d):
    return workflows.apply_profile_to_entries(tb.marked(spark, d), _P)[0].select("entry_id", F.array_join("warnings", " ").alias("warnings"))


@query("u18_inconsistent", f"{_S}, {_MARKED} SELECT entry_id FROM alerts WHERE NOT conv AND list_contains(codes, 'INCONSISTENT_STRESS')")
def _u18(spark, d):
    out, _ = workflows.apply_profile_to_entries(tb.marked(spark, d), _P)
    return out.where(profiles.stress_inconsistent(F.col("features"), _P)).select("entry_id")


@query("p3_convention", f"{_S}, {_MARKED} SELECT entry_id, array_to_string(codes, ' ') AS alerts, (det OR odd)::INT AS unknown_symbols_count FROM alerts WHERE conv AND dict_id = 'd1' AND NOT is_deleted")
def _p3(spark, d):
    run = workflows.apply_convention(tb.marked(spark, d), _old(spark, d), "d1", _P)
    return run.entries.select("entry_id", F.array_join("alerts", " ").alias("alerts"), "unknown_symbols_count")


def _old(spark, d):
    """Issues of an earlier run: one unknown symbol for each entry, one of another kind for some."""
    s = tb.store(spark, d)
    code = F.when(F.col("line_no") % 2 == 0, "UNKNOWN_SYMBOL").otherwise("UNPARSED_LINE")
    return s.select("dict_id", "source_path", "line_no", F.lit("warning").alias("kind"), code.alias("code"), F.col("headword_raw").alias("raw"))


_AFTER = f"""{_S}, {_MARKED}, issues AS (SELECT dict_id, unnest(codes) AS code FROM alerts WHERE conv AND dict_id = 'd1' AND NOT is_deleted
  UNION ALL SELECT dict_id, CASE WHEN line_no % 2 = 0 THEN 'UNKNOWN_SYMBOL' ELSE 'UNPARSED_LINE' END FROM store WHERE NOT (dict_id = 'd1' AND line_no % 2 = 0))"""


@query("q7_convention_issues", f"{_S}, {_MARKED} SELECT entry_id, code FROM (SELECT entry_id, unnest(codes) AS code FROM alerts WHERE conv) WHERE code IN ('MISSING_PRON', 'BAD_SYLL_COUNT')")
def _q7(spark, d):
    i = quality.profile_issues(quality.convention(tb.marked(spark, d), _P), _P, True)
    return i.where(F.col("code").isin("MISSING_PRON", "BAD_SYLL_COUNT")).select(F.col("details.entry_id").alias("entry_id"), "code")


@query("q10_replaced_issues", f"{_AFTER} SELECT dict_id, code, count(*) AS n FROM issues GROUP BY 1, 2")
def _q10(spark, d):
    run = workflows.apply_convention(tb.marked(spark, d), _old(spark, d), "d1", _P)
    return run.issues.groupBy("dict_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("a14_alerts_by_code", f"{_S}, {_MARKED} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM alerts WHERE conv) GROUP BY 1")
def _a14(spark, d):
    return quality.by_code(quality.profile_issues(quality.convention(tb.marked(spark, d), _P), _P, True))


@query("f14_changed", f"{_S}, {_MARKED} SELECT entry_id FROM alerts WHERE conv AND (len(codes) > 0 OR t <> pe OR regexp_matches(headword_raw, '[é''̀-ͯ]'))")
def _f14(spark, d):
    return quality.convention(tb.marked(spark, d), _P).where("changed").select("entry_id")


@query("l7_preview", f"{_S} SELECT entry_id, coalesce(pron_raw, headword_raw) AS raw, lower(coalesce(pron_raw, headword_raw)) AS norm FROM store ORDER BY section, line_no, entry_id LIMIT 50")
def _l7(spark, d):
    return workflows.preview_profile(tb.store(spark, d), profiles.Profile()).select("entry_id", "raw", "norm")


@query("k12_preview", f"{_S} SELECT entry_id, headword, norm, modified FROM (SELECT *, trim(coalesce(nullif(trim(headword_edit), ''), headword_raw)) AS headword, lower(headword) AS norm, coalesce(pron_edit, pron_raw, '') AS pe, headword <> lower(headword) OR coalesce(nullif(pe, ''), headword) <> lower(coalesce(nullif(pe, ''), headword)) AS modified FROM store ORDER BY section, line_no, entry_id LIMIT 200)")
def _k12(spark, d):
    out = workflows.preview_convention(tb.store(spark, d), profiles.Profile())
    return out.select("entry_id", F.col("headword_effective").alias("headword"), F.col("headword_norm").alias("norm"), "modified")


@query("j11_write_back", f"{_S} SELECT entry_id, CASE WHEN dict_id = 'd2' THEN lower(coalesce(pron_raw, headword_raw)) ELSE form_norm END AS form_norm FROM store")
def _j11(spark, d):
    s = tb.store(spark, d)
    out, _ = workflows.apply_profile_to_entries(s.where("dict_id = 'd2'"), profiles.Profile())
    return workflows.write_back(s, out, ["form_norm"]).select("entry_id", "form_norm")


# ---- curation


@query("m1_create", f"{_S}, n AS (SELECT dict_id, max(line_no) AS last FROM store GROUP BY 1), made AS (SELECT 'd' || c_custkey % 3 AS dict_id, c_name FROM customer) SELECT entry_id, dict_id, line_no, headword_raw, manual_created, status, source_path FROM store UNION ALL SELECT sha256(dict_id || '|manual://' || dict_id || '/curation|' || line || '|' || c_name || '|p'), dict_id, line, c_name, true, 'reviewed', 'manual://' || dict_id || '/curation' FROM (SELECT dict_id, c_name, (last + row_number() OVER (PARTITION BY dict_id ORDER BY c_name))::INT AS line FROM made JOIN n USING (dict_id))")
def _m1(spark, d):
    new = table(spark, d, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string")).alias("dict_id"), F.col("c_name").alias("headword_raw"))
    return curation.create_entries(tb.store(spark, d), new)[0].select("entry_id", "dict_id", "line_no", "headword_raw", "manual_created", "status", "source_path")


@query("m3_delete_restore", "WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT c_custkey AS entry_id, coalesce(t = 'click', false) AS is_deleted FROM customer LEFT JOIN last ON c_custkey = user_id")
def _m3(spark, d):
    none = F.lit(None).cast("string")
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), none.alias("headword_edit"), none.alias("pron_edit"), none.alias("definition_edit"), F.lit("auto").alias("status"), F.lit(False).alias("is_deleted"))
    t = F.col("event_type")
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("entry_id"), F.when(t == "click", "DELETE").when(t == "view", "RESTORE").otherwise("REVIEW").alias("op"), none.alias("field"), none.alias("value"))
    return curation.replay(e, log).select("entry_id", "is_deleted")


@query("m4_fill_pron", f"{_S} SELECT entry_id, CASE WHEN pron_edit IS NULL AND pron_raw IS NULL THEN coalesce(nullif(trim(headword_edit), ''), headword_raw) ELSE pron_edit END AS pron_edit FROM store")
def _m4(spark, d):
    return curation.fill_pron(tb.store(spark, d)).select("entry_id", "pron_edit")


@query("a17_fill_counts", f"{_S} SELECT count(*) AS requested, count(*) FILTER (pron_edit IS NULL AND pron_raw IS NULL) AS updated, count(*) FILTER (NOT (pron_edit IS NULL AND pron_raw IS NULL)) AS skipped_has_pron, 0::BIGINT AS skipped_no_headword FROM store")
def _a17(spark, d):
    return curation.fill_counts(curation.fill_pron(tb.store(spark, d)))


@query("m8_undo", f"{_S} SELECT entry_id, headword_raw FROM store")
def _m8(spark, d):
    s = tb.store(spark, d)
    pairs = s.where("line_no % 6 = 0").select(F.col("entry_id").alias("id_a"), (F.col("line_no") + 3).cast("string").alias("id_b"))
    merged, log = curation.merge_entries(s, pairs)
    return curation.undo_structural(merged, s, log.select(F.array("entry_id").alias("made"), F.col("before").alias("taken"))).select("entry_id", "headword_raw")


@query("m10_extra", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind, 'x' AS note, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand FROM part")
def _m10(spark, d):
    k = F.col("p_partkey")
    old = F.create_map(F.lit("kind"), F.col("p_type"), F.lit("note"), F.lit("old"))
    patch = F.create_map(F.lit("note"), F.lit("x"), F.lit("kind"), F.when(k % 2 == 0, F.col("p_type")).otherwise(""), F.lit("brand"), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""))
    out = table(spark, d, "part").select("p_partkey", curation.patch_extra(old, patch).alias("m"))
    return out.select("p_partkey", *(F.try_element_at("m", F.lit(c)).alias(c) for c in ("kind", "note", "brand")))


@query("m12_clear", f"{_S} SELECT entry_id, dict_id FROM store WHERE dict_id <> 'd1'")
def _m12(spark, d):
    from ..sources import sinks

    return sinks.clear_corpus({"entries": tb.store(spark, d)}, "d1")["entries"].select("entry_id", "dict_id")


# ---- whole runs

_RULED = _PART.replace("FROM part),", "FROM part),\nkept AS (SELECT * REPLACE (CASE WHEN line_no BETWEEN 5 AND 9 OR regexp_matches(raw, '^3 ', 'i') THEN '' ELSE raw END AS raw) FROM part_lines),", 1).replace("AS kind FROM part_lines)", "AS kind FROM kept)")


def _run(spark, d):
    rule = filters.SourceFilter(line_ranges=((5, 9),), drop_lines=("^3 ",), ignore_case=True)
    return workflows.run_pipeline(tb.part_lines(spark, d), "p", profiles.Profile(), rule=rule)


@query("p1_run_entries", rf"WITH {_RULED} SELECT line_no, section, headword_raw, lower(headword_raw) AS form_norm, sha256('p|' || source_path || '|' || line_no || '|' || headword_raw || '|' || raw[-1]) AS entry_id FROM (SELECT *, trim(regexp_extract(raw, '^([1-9]|10)\s+(.+?),\s*([avpſs])$', 2)) AS headword_raw FROM classified WHERE kind = 'entry')")
def _p1(spark, d):
    return _run(spark, d).entries.select("line_no", "section", "headword_raw", "form_norm", "entry_id")


@query("p1_run_issues", f"WITH {_RULED}, {_ISSUE_CASES} SELECT line_no, code, kind FROM issues WHERE raw <> ''")
def _p1i(spark, d):
    return _run(spark, d).issues.select("line_no", "code", "kind")


_TEMPLATE = "t AS (SELECT 'part' AS source_path, p_partkey::INT AS line_no, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_name || ', ' || p_type END AS raw, p_name, p_type, p_partkey FROM part)"


def _template(spark, d):
    line = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat_ws(", ", "p_name", "p_type"))
    records = table(spark, d, "part").select(F.lit("part").alias("source_path"), F.col("p_partkey").cast("int").alias("line_no"), line.alias("raw"))
    return workflows.apply_template(records, "p", "entry_definition")


@query("x17_template_entries", f"WITH {_TEMPLATE} SELECT line_no, p_name AS headword_raw, p_type AS definition_raw, 'v' AS pos_raw, 1 AS syllables, sha256('p|part|' || line_no || '|' || p_name || '|v') AS entry_id FROM t WHERE p_partkey % 4 <> 0")
def _x17(spark, d):
    return _template(spark, d).entries.select("line_no", "headword_raw", "definition_raw", "pos_raw", "syllables", "entry_id")


@query("q9_template_issues", f"WITH {_TEMPLATE} SELECT line_no, 'UNRECOGNIZED_RECORD' AS code, raw FROM t WHERE p_partkey % 4 = 0")
def _q9(spark, d):
    return _template(spark, d).issues.select("line_no", "code", "raw")


@query("p4_template_counts", f"WITH {_TEMPLATE} SELECT count(*) FILTER (p_partkey % 4 <> 0) AS ok, count(*) FILTER (p_partkey % 4 = 0) AS unrecognized, 0::BIGINT AS ignored FROM t")
def _p4(spark, d):
    return _template(spark, d).report


@query("x16_split_dialog", "WITH t AS (SELECT p_partkey, p_partkey % 4 AS m, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, headword_raw, CASE WHEN m = 3 AND headword_raw = w[1] THEN w[2] END AS pron_raw FROM (SELECT *, unnest(CASE m WHEN 0 THEN [w[1], 'x, y'] WHEN 1 THEN [w[1] || ' b', w[2]] WHEN 2 THEN w ELSE [w[1], 'last'] END) AS headword_raw FROM t)")
def _x16(spark, d):
    k = F.col("p_partkey")
    w = F.split("p_name", " ")
    text = F.when(k % 4 == 0, F.concat(w[0], F.lit("; x, y;"))).when(k % 4 == 1, F.concat(w[0], F.lit(" b, "), w[1])).when(k % 4 == 2, F.col("p_name")).otherwise(F.concat(w[0], F.lit("\t"), w[1], F.lit("\n\n last ")))
    return _names(spark, d).select("p_partkey", F.explode(workflows.split_dialog(text)).alias("e")).select("p_partkey", "e.*")


@query("p2_apply_profile", f"{_S} SELECT entry_id, coalesce(nullif(pron_raw, ''), headword_raw) AS form_display, lower(coalesce(nullif(pron_raw, ''), headword_raw)) AS form_norm FROM store")
def _p2(spark, d):
    return workflows.apply_profile_to_entries(tb.store(spark, d), profiles.Profile())[0].select("entry_id", "form_display", "form_norm")


@query("x14_overrides_on_drafts", "SELECT p_partkey::VARCHAR AS record_key, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name || '1', p_name || '2'] ELSE [p_name] END) AS headword, p_type AS definition FROM part WHERE p_partkey % 5 <> 0")
def _x14(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("record_key"), "p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("raw"), "p_name")
    drafts = templates.entry_definition(p)
    entries = F.array(*(F.struct(F.concat("p_name", F.lit(s)).alias("headword"), F.lit(None).cast("string").alias("pron")) for s in "12"))
    over = p.where("p_partkey % 3 = 0 or p_partkey % 5 = 0").select("record_key", F.lit(1).alias("override_id"), F.when(F.col("p_partkey") % 5 == 0, "SKIP_RECORD").otherwise("SPLIT").alias("op"), entries.alias("entries"))
    return templates.apply_overrides(drafts, over).where("status = 'OK'").select("record_key", "headword", "definition")


@query("l7_template_preview", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 200")
def _l7t(spark, d):
    return listing.capped(_names(spark, d), ["p_partkey"], 200)[0].select("p_partkey")
