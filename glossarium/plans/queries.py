"""Queries by the operators' numbers, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles
from ..functions import text as T
from ..operators import compare, curation, filters, graph, listing, parsing, templates
from ..session import table
from ..sources import readers, sinks
from . import testbed as tb
from .registry import query

# Pieces of SQL. DuckDB's patterns need their own spelling of the same white space.
_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = lambda c: rf"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_SQUEEZE = lambda c: rf"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'), ' ')"
_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_LINES = rf"""lines AS (
  SELECT lang AS dict_id, 'doc/' || doc_id AS source_path, unnest(p) AS raw, generate_subscripts(p, 1) AS line_no
  FROM (SELECT lang, doc_id, CASE WHEN q[-1] = '' THEN q[:len(q) - 1] ELSE q END AS p
        FROM (SELECT lang, doc_id, string_split_regex(coalesce(text, ''), '{_END}') AS q FROM documents)))"""
_TOKENS = rf"""tokens AS (
  SELECT dict_id, source_path, line_no, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS draft_no
  FROM (SELECT *, string_split({_SQUEEZE("raw")}, ' ') AS t FROM lines)),
drafts AS (
  SELECT *, rtrim(token, '.,;:!?/\|') AS word,
    CASE WHEN token = '' THEN 'EMPTY_HEADWORD' WHEN NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') THEN 'PUNCT_ONLY_TOKEN'
         WHEN rtrim(token, '.,;:!?/\|') = '' THEN 'EMPTY_HEADWORD' END AS reason
  FROM tokens)"""
_ENTRIES = r"""entries AS (
  SELECT dict_id, headword_raw, spot.source_path AS source_path, spot.line_no AS line_no,
         sha256(dict_id || '|' || spot.source_path || '|' || spot.line_no || '|' || headword_raw || '|p') AS entry_id
  FROM (SELECT dict_id, word AS headword_raw, min(struct_pack(source_path := source_path, line_no := line_no)) AS spot
        FROM drafts WHERE reason IS NULL GROUP BY ALL)),
keyed AS (SELECT *, lower(trim(nfc_normalize(headword_raw))) AS headword_key FROM entries)"""
_ALL = f"WITH {_LINES}, {_TOKENS}, {_ENTRIES}"
_BUCKET = lambda c: rf"(CASE WHEN regexp_extract({c}, '\p{{L}}') = 'ß' THEN 'SS' WHEN regexp_matches(upper(strip_accents(regexp_extract({c}, '\p{{L}}'))), '^[A-Z]') THEN upper(strip_accents(regexp_extract({c}, '\p{{L}}')))[1] ELSE '#' END)"
_PART = r"""part_lines AS (
  SELECT 'part/' || p_brand AS source_path, p_partkey::INT AS line_no,
    CASE WHEN p_partkey % 100 = 1 THEN upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')[:2])
         WHEN p_partkey % 97 = 0 THEN p_partkey::VARCHAR
         ELSE (p_partkey % 12) || ' ' || lower(p_name) || CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE ', ' END || ['a', 'v', 'p', 's', 'x'][p_partkey % 5 + 1] END AS raw
  FROM part),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(raw, '^[A-ZΑ-ΩΪΫ]{1,4}$') THEN 'section' WHEN regexp_matches(raw, '^[0-9]+$') THEN 'page'
    WHEN regexp_matches(raw, '^([1-9]|10)\s+(.+?),\s*([avpſs])$') THEN 'entry' ELSE 'other' END AS kind FROM part_lines),
classified AS (
  SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN raw END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM kinds)"""


# ---- sources and sinks


@query("s1_text_lines", f"WITH {_LINES} SELECT dict_id, source_path, line_no::INT AS line_no, raw FROM lines")
def _s1(spark, d):
    return tb.raw_lines(spark, d)


@query("s2_csv_records", "SELECT 'customer' AS source_path, row_number() OVER (ORDER BY c_custkey) + 1 AS record_no, 'c_name=' || c_name || ' | c_nationkey=' || c_nationkey || ' | c_mktsegment=' || c_mktsegment AS raw FROM customer")
def _s2(spark, d):
    return readers.csv_records(table(spark, d, "customer"), ["c_name", "c_nationkey", "c_mktsegment"], "customer", "c_custkey").drop("csv_row")


@query("s6_merge_lines", f"WITH {_LINES} SELECT source_path, line_no::INT AS line_no, raw FROM lines QUALIFY row_number() OVER (PARTITION BY raw ORDER BY source_path, line_no) = 1")
def _s6(spark, d):
    return readers.merge_lines(tb.raw_lines(spark, d))


@query("s7_page_lines", f"""WITH w AS (SELECT conv_id AS page, turn, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS k FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS p FROM conversations)),
  v AS (SELECT page, k % 8 * 40.0 + CASE WHEN k % 8 > 3 THEN 120 ELSE 0 END AS x0, turn * 100.0 + (k // 8) * 10.0 AS top, {_STRIP('text')} AS text FROM w WHERE {_STRIP('text')} <> ''),
  c AS (SELECT page, CASE WHEN count(DISTINCT x0) BETWEEN 2 AND 4 THEN 20.0 ELSE 200.0 END AS cut FROM v GROUP BY 1)
  SELECT page, (x0 >= cut)::INT AS col, dense_rank() OVER (PARTITION BY page, x0 >= cut ORDER BY top)::INT AS line_no, string_agg(text, ' ' ORDER BY x0, text) AS text FROM v JOIN c USING (page) GROUP BY page, x0 >= cut, top""")
def _s7(spark, d):
    c = table(spark, d, "conversations")
    words = c.select(F.col("conv_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("k", "text"), "turn")
    return readers.page_lines(words.select("page", (F.col("k") % 8 * 40.0 + F.when(F.col("k") % 8 > 3, 120.0).otherwise(0.0)).alias("x0"), (F.col("turn") * 100.0 + F.floor(F.col("k") / 8) * 10.0).alias("top"), "text"), 2, width=400.0)


@query("s11_entry_files", "SELECT trim(p_name) AS headword_raw, 'v' AS pos_raw, CASE WHEN p_size > 0 THEN p_size ELSE 1 END::INT AS syllables, coalesce(nullif(p_brand, ''), p_name) AS pron_raw FROM part WHERE trim(p_name) <> ''")
def _s11(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("headword"), F.col("p_size").alias("syllables"), F.col("p_brand").alias("pron"))
    return readers.entry_files(p).select("headword_raw", "pos_raw", "syllables", "pron_raw")


@query("k1_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _k1(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return curation.upsert(e, "user_id", "event_id").select("user_id", "event_type", "value")


_UP = "upper(replace(headword_raw, 'ß', 'SS'))"  # as Spark has it


@query("k3_export_payload", f"{_ALL} SELECT entry_id, CASE WHEN line_no % 3 = 0 THEN {_UP} ELSE headword_raw END AS headword_effective, CASE WHEN line_no % 3 = 0 AND {_UP} <> headword_raw THEN {_UP} ELSE lower(headword_raw) END AS form_display_effective, CASE WHEN line_no % 3 = 0 AND {_UP} <> headword_raw THEN lower({_UP}) ELSE lower(headword_raw) END AS form_norm_effective FROM entries")
def _k3(spark, d):
    none = F.lit(None).cast("string")
    e = tb.entries(spark, d).withColumns({
        "headword_edit": F.when(F.col("line_no") % 3 == 0, F.upper("headword_raw")).otherwise(F.lit(" ")), "pron_edit": none, "pron_raw": none,
        "definition_edit": none, "definition_raw": none, "form_display": F.lower("headword_raw"), "form_norm": F.lit(""),
    })
    return sinks.export_payload(e).select("entry_id", "headword_effective", "form_display_effective", "form_norm_effective")


@query("k6_coverage_export", f"{_ALL} SELECT headword_key, CASE WHEN bool_or(dict_id = 'en') THEN '1' ELSE '0' END AS in_en, CASE WHEN bool_or(dict_id = 'fr') THEN '1' ELSE '0' END AS in_fr FROM keyed WHERE dict_id IN ('en', 'fr') AND headword_key <> '' GROUP BY 1")
def _k6(spark, d):
    return sinks.coverage_export(compare.coverage(compare.with_key(tb.entries(spark, d)), ["en", "fr"]))


# ---- filters

_RULE = filters.SourceFilter(drop_before=("[,]",), drop_after=("^The .*$",), line_ranges=((3, 4), (9, 9)), drop_lines=("[%$&#]{3}", "^de"), ignore_case=True)
_F1 = rf"""WITH {_LINES}, marks AS (
  SELECT source_path, min(line_no) FILTER (regexp_matches(raw, ',')) AS b, min(line_no) FILTER (regexp_matches(raw, '^The .*$', 'i')) AS a FROM lines GROUP BY 1),
staged AS (SELECT source_path, line_no::INT AS line_no, CASE WHEN line_no < b THEN 'before' WHEN line_no >= a THEN 'after' WHEN line_no BETWEEN 3 AND 4 OR line_no = 9 THEN 'ranges'
  WHEN regexp_matches(raw, '[%$&#]{{3}}|^de', 'i') THEN 'regex' END AS drop_stage FROM lines JOIN marks USING (source_path))"""


@query("f1_source_filter", _F1 + " SELECT source_path, line_no, drop_stage FROM staged")
def _f1(spark, d):
    return filters.filter_source(tb.raw_lines(spark, d), _RULE).select("source_path", "line_no", "drop_stage")


@query("a15_filter_report", _F1 + " SELECT source_path, count(*) AS total_lines, count(*) FILTER (drop_stage IS NULL) AS kept_lines, count(*) FILTER (drop_stage = 'before') AS dropped_before, count(*) FILTER (drop_stage = 'after') AS dropped_after, count(*) FILTER (drop_stage = 'ranges') AS dropped_ranges, count(*) FILTER (drop_stage = 'regex') AS dropped_regex FROM staged GROUP BY 1")
def _a15(spark, d):
    return filters.filter_report(filters.filter_source(tb.raw_lines(spark, d), _RULE))


@query("f2_accent", f"{_ALL} SELECT entry_id, headword_raw FROM entries WHERE regexp_matches(headword_raw, '[áàâäéèêëíìîïóòôöúùûüýÿãõ]')")
def _f2(spark, d):
    return tb.entries(spark, d).where(filters.with_accent(F.col("headword_raw"))).select("entry_id", "headword_raw")


@query("f3_syllables", "SELECT p_partkey FROM part WHERE p_size = 7")
def _f3(spark, d):
    return table(spark, d, "part").where(filters.syllables_equal(F.col("p_size").cast("string"), 7)).select("p_partkey")


@query("f4_prefix", f"{_ALL} SELECT entry_id FROM entries WHERE starts_with(headword_raw, 'th') OR starts_with(headword_raw, 'É')")
def _f4(spark, d):
    return tb.entries(spark, d).where(filters.starts_with_any(F.col("headword_raw"), ["th", "É"])).select("entry_id")


@query("f5_search", "SELECT doc_id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_in%' OR translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_in%'")
def _f5(spark, d):
    return table(spark, d, "documents").where(filters.search("Th_IN", ["text", "source"])).select("doc_id")


@query("f6_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _f6(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "auto").otherwise("odd"))
    return o.where(filters.status_in(["reviewed", "odd"])).select("o_orderkey")


@query("f9_page_range", "SELECT conv_id, turn FROM conversations WHERE coalesce(turn, 0) BETWEEN 1 AND 2")
def _f9(spark, d):
    return table(spark, d, "conversations").withColumn("page", F.col("turn")).where(filters.page_between(1, 2)).select("conv_id", "turn")


_ISSUE_CASES = r"""found AS (
  SELECT source_path, line_no, raw, kind, section, regexp_matches(raw, '^([1-9]|10)\s+(.+)\s+([avpſs])$') AND NOT contains(raw, ',') AS no_comma,
    regexp_matches(raw, '^([0-9]+)\s+(.+?),\s*([^,\s])$') AS loose, try_cast(regexp_extract(raw, '^([0-9]+)\s', 1) AS INT) AS n, raw[-1] AS pos FROM classified),
issues AS (
  SELECT source_path, line_no, 'warning' AS kind, 'PAGE_MARKER' AS code, raw FROM found WHERE kind = 'page'
  UNION ALL SELECT source_path, line_no, 'warning', 'MISSING_SECTION', raw FROM found WHERE kind = 'entry' AND section = ''
  UNION ALL SELECT source_path, line_no, 'error', 'UNPARSED_LINE', raw FROM found WHERE kind = 'other'
  UNION ALL SELECT source_path, line_no, 'warning', 'MISSING_COMMA', raw FROM found WHERE no_comma
  UNION ALL SELECT source_path, line_no, 'error', 'SYLLABLES_OUT_OF_RANGE', raw FROM found WHERE loose AND NOT no_comma AND NOT coalesce(n BETWEEN 1 AND 10, false)
  UNION ALL SELECT source_path, line_no, 'error', 'INVALID_POS', raw FROM found WHERE loose AND NOT no_comma AND pos NOT IN ('a', 'v', 'p', 'ſ', 's'))"""


@query("f8_flagged", f"WITH {_PART}, {_ISSUE_CASES} SELECT DISTINCT c.source_path, c.line_no FROM classified c SEMI JOIN issues i ON c.source_path = i.source_path AND c.line_no = i.line_no WHERE c.kind = 'entry'")
def _f8(spark, d):
    c = parsing.classify(tb.part_lines(spark, d))
    tag = F.lit("part").alias("dict_id")
    return filters.flagged(parsing.parsed_entries(c).select("*", tag), parsing.line_issues(c).select("*", tag)).select("source_path", "line_no")


# ---- extraction


@query("x1_parse_lines", rf"WITH {_PART} SELECT source_path, line_no, kind, section, CASE WHEN kind = 'entry' THEN regexp_extract(raw, '^([0-9]+)', 1)::INT END AS syllables, CASE WHEN kind = 'entry' THEN trim(regexp_extract(raw, '^([1-9]|10)\s+(.+?),\s*([avpſs])$', 2)) END AS headword_raw, CASE WHEN kind = 'entry' THEN raw[-1] END AS pos_raw FROM classified")
def _x1(spark, d):
    return parsing.classify(tb.part_lines(spark, d)).select("source_path", "line_no", "kind", "section", "syllables", "headword_raw", "pos_raw")


@query("x3_preset", r"SELECT p_partkey::INT AS line_no, p_size AS syllables, p_name AS headword_raw, CASE WHEN p_brand = 'Brand#11' THEN 'first' WHEN lower(p_brand) = 'brand#12' THEN 'second' END AS pos_norm FROM part")
def _x3(spark, d):
    p = table(spark, d, "part")
    lines = p.select(F.lit("part").alias("source_path"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" : "), F.col("p_brand")).alias("raw"))
    preset = parsing.Preset("parts", r"(\d+)\s+(.+) : (\S+)", {"syllables": 1, "headword": 2, "pos": 3}, pos_map={"Brand#11": "first", "bRAND#12": "second"})
    return parsing.classify(lines, preset).select("line_no", "syllables", "headword_raw", "pos_norm")


@query("x6_wordlist", f"WITH {_LINES}, {_TOKENS} SELECT source_path, line_no::INT AS line_no, draft_no::INT AS draft_no, CASE WHEN reason = 'PUNCT_ONLY_TOKEN' THEN token WHEN reason IS NULL THEN word END AS headword, reason FROM drafts")
def _x6(spark, d):
    return templates.wordlist(tb.raw_lines(spark, d)).select("source_path", "line_no", "draft_no", "headword", "reason")


@query("x7_entry_definition", rf"WITH {_LINES} SELECT source_path, line_no::INT AS line_no, CASE WHEN contains(raw, ',') THEN nullif({_STRIP('string_split(' + _STRIP('raw') + ', chr(44))[1]')}, '') END AS headword, CASE WHEN contains({_STRIP('raw')}, ',') AND {_STRIP('string_split(' + _STRIP('raw') + ', chr(44))[1]')} <> '' THEN {_STRIP('substr(' + _STRIP('raw') + ', instr(' + _STRIP('raw') + ', chr(44)) + 1)')} END AS definition FROM lines")
def _x7(spark, d):
    return templates.entry_definition(tb.raw_lines(spark, d)).select("source_path", "line_no", "headword", "definition")


@query("x8_headword_pron", "SELECT p_partkey, p_name AS headword, p_type || chr(9) || p_brand AS pron FROM part")
def _x8(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("\t", "p_name", "p_type", "p_brand").alias("raw"))
    return templates.headword_pron(p).select("p_partkey", "headword", "pron")


@query("x9_three_columns", "SELECT p_partkey, p_name AS headword, 'v. a.' AS pos, p_type || ' ' || p_size AS definition, p_brand AS pron FROM part")
def _x9(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("   ", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " , v. a.").otherwise(" v. a.")), "p_type", F.col("p_size").cast("string"), "p_brand").alias("raw"))
    return templates.three_columns(p).select("p_partkey", "headword", "pos", "definition", "pron")


@query("x10_csv_mapping", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS headword, p_brand AS pron, p_type AS definition FROM part")
def _x10(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("h"), F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit("p"), F.col("p_brand"), F.lit("d"), F.col("p_type")).alias("csv_row"))
    return templates.csv_mapping(p, "h", "p", "d", "semicolon").select("p_partkey", "headword", "pron", "definition")


@query("x13_record_overrides", r"""WITH last AS (SELECT user_id, arg_max(event_id, event_id) AS e, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), skip AS (SELECT user_id, e, t = 'click' AS skip FROM last)
  SELECT c_custkey AS k, c_name AS headword, NULL AS reason FROM customer ANTI JOIN skip ON c_custkey = user_id
  UNION ALL SELECT c_custkey, NULL, 'SKIP_RECORD' FROM customer JOIN skip ON c_custkey = user_id WHERE skip
  UNION ALL SELECT c_custkey, unnest(['x' || e, 'y' || e]), NULL FROM customer JOIN skip ON c_custkey = user_id WHERE NOT skip""")
def _x13(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record_key"), F.col("c_name").alias("raw"))
    drafts = templates.emit(c, F.array(templates._row(F.col("raw"), F.col("raw")))).drop("raw")
    two = F.array(*(F.struct(F.concat(F.lit(p), F.col("event_id").cast("string")).alias("headword"), F.lit(None).cast("string").alias("pron")) for p in "xy"))
    over = table(spark, d, "events").select(F.col("user_id").alias("record_key"), F.col("event_id").alias("override_id"), F.when(F.col("event_type") == "click", "SKIP_RECORD").otherwise("SPLIT").alias("op"), two.alias("entries"))
    return templates.apply_overrides(drafts, over).select(F.col("record_key").alias("k"), "headword", "reason")


@query("x15_recommend", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 2 = 0) AS e, count(*) FILTER (p_partkey % 2 = 1) AS o FROM part),
  k(place, template, separator, ok, priority) AS (VALUES (0, 'three_columns', 'auto', 'e', 90), (1, 'three_columns', 'triple_spaces', '', 80), (2, 'three_columns', 'tab', 'e', 70),
    (3, 'headword_pron', 'multi_spaces', '', 50), (4, 'headword_pron', 'tab', 'e', 40), (5, 'entry_definition', 'comma', 'o', 30), (6, 'entry_definition', 'double_space', '', 20)),
  r AS (SELECT *, CASE ok WHEN 'e' THEN e WHEN 'o' THEN o ELSE 0 END AS ok_records FROM k, c)
  SELECT place, template, separator, 21 * ok_records - 10 * (n - ok_records) + priority AS score, ok_records, ok_records AS entries, n - ok_records AS unrecognized FROM r""")
def _x15(spark, d):
    even, odd = F.concat_ws("\t", "p_name", "p_type", "p_brand"), F.concat_ws(", ", "p_name", "p_type")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("record_key"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("raw"))
    return templates.recommend(p)


# ---- functions, profiles and QA

_PROFILE = profiles.Profile(remove_punctuation=True, paren_accents=True, acute_vowels="áéíóú", stress_marks=("é", "ó"), rules=(({"contains_any": "éó"}, {"stress_schema": "marked"}), ({"pattern": "^[a-z]+$"}, {"stress_schema": "plain"})))


@query("u8_norm", rf"{_ALL} SELECT entry_id, translate(nfc_normalize(headword_raw), '''’ʼ`´', 'ʹʹʹʹʹ') AS form_display, {_SQUEEZE(rf"regexp_replace(lower(strip_accents(translate(replace(headword_raw, 'ſ', 's'), '''’ʼ`´', 'ʹʹʹʹʹ'))), '[^{_WS}\p{{L}}\p{{N}}\p{{M}}-]', ' ', 'g')")} AS form_norm FROM entries")
def _u8(spark, d):
    e = tb.entries(spark, d)
    return profiles.apply_profile(e, "headword_raw", _PROFILE).select("entry_id", "form_display", "form_norm")


@query("u17_features", rf"{_ALL} SELECT entry_id, length(headword_raw) - length(translate(nfc_normalize(headword_raw), 'áéíóú', '')) AS accented_vowel_count, CASE WHEN regexp_matches(headword_raw, '[éó]') THEN 'primary' ELSE 'none' END AS stress, CASE WHEN regexp_matches(headword_raw, '^[a-z]+$') THEN 'plain' WHEN regexp_matches(headword_raw, '[éó]') THEN 'marked' END AS stress_schema FROM entries")
def _u17(spark, d):
    e = tb.entries(spark, d)
    f = profiles.apply_profile(e, "headword_raw", _PROFILE)
    return f.select("entry_id", F.col("features.accented_vowel_count").cast("long").alias("accented_vowel_count"), "features.stress", "features.stress_schema")


@query("u24_alpha_bucket", f"{_ALL} SELECT {_BUCKET('headword_raw')} AS bucket, count(*) AS n FROM entries GROUP BY 1")
def _u24(spark, d):
    return listing.bucket_counts(tb.entries(spark, d).withColumn("alpha_bucket", T.alpha_bucket(F.col("headword_raw"))))


@query("u27_slug", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type || '!'), '\s+', '_', 'g'), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM part")
def _u27(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", F.concat("p_type", F.lit("!")))).alias("slug"))


@query("q2_line_issues", f"WITH {_PART}, {_ISSUE_CASES} SELECT source_path, line_no, kind, code, raw FROM issues")
def _q2(spark, d):
    return parsing.line_issues(parsing.classify(tb.part_lines(spark, d)))


@query("q4_entry_issues", rf"WITH e AS (SELECT 'part' AS source_path, p_partkey::INT AS line_no, p_size AS n, p_name AS headword_raw, lower(p_brand[-1]) AS pos FROM part) SELECT source_path, line_no, 'error' AS kind, 'SYLLABLES_OUT_OF_RANGE' AS code, headword_raw FROM e WHERE NOT coalesce(n BETWEEN 1 AND 10, false) UNION ALL SELECT source_path, line_no, 'error', 'INVALID_POS', headword_raw FROM e WHERE pos NOT IN ('a', 'v', 'p', 'ſ', 's') UNION ALL SELECT source_path, line_no, 'warning', 'NON_ALPHA_HEADWORD', headword_raw FROM e WHERE NOT regexp_matches(headword_raw, '\p{{L}}')")
def _q4(spark, d):
    p = table(spark, d, "part").select(F.lit("part").alias("source_path"), F.col("p_partkey").cast("int").alias("line_no"), F.col("p_size").alias("syllables"), F.col("p_name").alias("headword_raw"), F.substring("p_brand", -1, 1).alias("pos_raw"), F.lit(None).cast("string").alias("pos_norm"))
    return parsing.entry_issues(p)


@query("q5_long_s", f"{_ALL} SELECT entry_id, headword_raw FROM entries e WHERE contains(lower(headword_raw), 'f') AND lower(headword_raw) IN (SELECT lower(unnest(string_split(text, ' '))) FROM benchmark)")
def _q5(spark, d):
    lexicon = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("token"))
    return parsing.long_s_suspects(tb.entries(spark, d), lexicon).select("entry_id", "headword_raw")


# ---- comparison

_CORPORA = ["en", "fr", "de"]
_COVER = f"{_ALL}, cover AS (SELECT headword_key, bool_or(dict_id = 'en') AS in_en, bool_or(dict_id = 'fr') AS in_fr, bool_or(dict_id = 'de') AS in_de FROM keyed WHERE dict_id IN ('en', 'fr', 'de') AND headword_key <> '' GROUP BY 1)"


@query("p5_coverage", f"{_COVER} SELECT * FROM cover")
def _p5(spark, d):
    return compare.coverage(compare.with_key(tb.entries(spark, d)), _CORPORA)


@query("f12_coverage_filter", f"{_COVER} SELECT headword_key FROM cover WHERE in_en AND NOT in_fr AND NOT in_de")
def _f12(spark, d):
    return compare.coverage(compare.with_key(tb.entries(spark, d)), _CORPORA).where(compare.coverage_filter("only_a", _CORPORA)).select("headword_key")


@query("a5_coverage_counts", f"{_COVER} SELECT count(*) AS union_count, count(*) FILTER (in_en AND in_fr AND in_de) AS common_all, count(*) FILTER (in_en AND NOT in_fr AND NOT in_de) AS unique_a, count(*) FILTER (in_fr AND NOT in_en AND NOT in_de) AS unique_b FROM cover")
def _a5(spark, d):
    return compare.coverage_counts(compare.coverage(compare.with_key(tb.entries(spark, d)), _CORPORA), _CORPORA)


_FIRST = f"{_ALL}, firsts AS (SELECT * FROM keyed WHERE headword_key <> '' QUALIFY row_number() OVER (PARTITION BY dict_id, headword_key ORDER BY line_no, entry_id) = 1)"


def _firsts(spark, d, corpus):
    return compare.first_per_key(compare.with_key(tb.entries(spark, d).where(F.col("dict_id") == corpus)))


@query("j1_align_exact", f"{_FIRST} SELECT headword_key, a.entry_id AS entry_id_a, b.entry_id AS entry_id_b FROM firsts a JOIN firsts b USING (headword_key) WHERE a.dict_id = 'en' AND b.dict_id = 'fr'")
def _j1(spark, d):
    return compare.align_exact(_firsts(spark, d, "en"), _firsts(spark, d, "fr"))


@query("j4_unmatched", f"{_FIRST} SELECT headword_key FROM firsts a WHERE dict_id = 'fr' AND headword_key NOT IN (SELECT headword_key FROM firsts WHERE dict_id = 'en')")
def _j4(spark, d):
    return _firsts(spark, d, "fr").join(_firsts(spark, d, "en"), "headword_key", "left_anti").select("headword_key")


_LCS = """RECURSIVE ka AS (SELECT DISTINCT lower(p_name) AS a FROM part), kb AS (SELECT DISTINCT lower(replace(p_name, 'e', 'i')) || ' x' AS b FROM part WHERE p_partkey > 0),
p AS (SELECT a, b FROM ka, kb WHERE a NOT IN (SELECT b FROM kb) AND b NOT IN (SELECT a FROM ka) AND 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 85),
d AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda i: 0::BIGINT) AS r FROM p
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda q, j: list_append(q, CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], q[j[1]]) END))
  FROM d WHERE i < length(a))"""


def _part_keys(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.lower("p_name").alias("headword_key"), F.col("p_partkey").cast("string").alias("entry_id"))
    b = p.select(F.concat(F.lower(F.replace("p_name", F.lit("e"), F.lit("i"))), F.lit(" x")).alias("headword_key"), F.col("p_partkey").cast("string").alias("entry_id"))
    first = lambda df: df.groupBy("headword_key").agg(F.min("entry_id").alias("entry_id"))
    return first(a), first(b)


_MUTUAL = f"""WITH {_LCS}, scored AS (SELECT a, b, (1.0 - (length(a) + length(b) - 2 * list_last(r)) / (length(a) + length(b))) * 100.0 AS score FROM d WHERE i = length(a)),
good AS (SELECT * FROM scored WHERE score >= 85), pairs AS (
  SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS x, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS y FROM good) WHERE x = 1 AND y = 1),
exact AS (SELECT a FROM ka SEMI JOIN kb ON a = b)
SELECT a AS headword_key, a AS key_b, 100.0::DOUBLE AS score, 'exact' AS method FROM exact
UNION ALL SELECT a, b, round(score, 6), 'fuzzy' FROM pairs
UNION ALL SELECT a, NULL, 0, 'none' FROM ka WHERE a NOT IN (SELECT a FROM exact) AND a NOT IN (SELECT a FROM pairs)
UNION ALL SELECT NULL, b, 0, 'none' FROM kb WHERE b NOT IN (SELECT a FROM exact) AND b NOT IN (SELECT b FROM pairs)"""


@query("j3_align_mutual", _MUTUAL)
def _j3(spark, d):
    a, b = _part_keys(spark, d)
    out = compare.align(a, b, "mutual_best", 85.0)
    return out.select("headword_key", "key_b", F.round("score", 6).alias("score"), "method")


_GREEDY = f"""WITH {_LCS}, scored AS (SELECT a, b, (1.0 - (length(a) + length(b) - 2 * list_last(r)) / (length(a) + length(b))) * 100.0 AS score FROM d WHERE i = length(a)),
good AS (SELECT * FROM scored WHERE score >= 85), turn AS (SELECT a, row_number() OVER (ORDER BY a) AS n, list(b ORDER BY score DESC, b) AS bs, list(score ORDER BY score DESC, b) AS ss FROM good GROUP BY a),
walk AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS score, []::VARCHAR[] AS taken
  UNION ALL SELECT n, a, list_filter(bs, lambda x: NOT list_contains(taken, x))[1], ss[list_position(bs, list_filter(bs, lambda x: NOT list_contains(taken, x))[1])],
    list_concat(taken, list_filter(bs, lambda x: NOT list_contains(taken, x))[:1]) FROM (SELECT t.*, w.taken FROM walk w JOIN turn t ON t.n = w.n + 1)),
pairs AS (SELECT a, b, score FROM walk WHERE b IS NOT NULL),
exact AS (SELECT a FROM ka SEMI JOIN kb ON a = b)
SELECT a AS headword_key, a AS key_b, 100.0::DOUBLE AS score, 'exact' AS method FROM exact
UNION ALL SELECT a, b, round(score, 6), 'fuzzy' FROM pairs
UNION ALL SELECT a, NULL, 0, 'none' FROM ka WHERE a NOT IN (SELECT a FROM exact) AND a NOT IN (SELECT a FROM pairs)
UNION ALL SELECT NULL, b, 0, 'none' FROM kb WHERE b NOT IN (SELECT a FROM exact) AND b NOT IN (SELECT b FROM pairs)"""


@query("j2_align_greedy", _GREEDY)
def _j2(spark, d):
    a, b = _part_keys(spark, d)
    out = compare.align(a, b, "greedy", 85.0)
    return out.select("headword_key", "key_b", F.round("score", 6).alias("score"), "method")


_MATCH = """WITH RECURSIVE eb AS (SELECT 'b' || p_partkey AS id, p_partkey AS line_no, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE lower(replace(p_name, 'a', 'o')) END AS f FROM part),
ka AS (SELECT DISTINCT lower(p_name) AS a FROM part WHERE lower(p_name) NOT IN (SELECT f FROM eb)), kb AS (SELECT f AS b, arg_min(id, (line_no, id)) AS first_id FROM eb GROUP BY f),
p AS (SELECT a, b FROM ka, kb WHERE 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 90),
d AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda i: 0::BIGINT) AS r FROM p
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda q, j: list_append(q, CASE WHEN substr(b, j[1], 1) = substr(a, i + 1, 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], q[j[1]]) END))
  FROM d WHERE i < length(a)),
scored AS (SELECT a, b, (1.0 - (length(a) + length(b) - 2 * list_last(r)) / (length(a) + length(b))) * 100.0 AS score FROM d WHERE i = length(a)),
best AS (SELECT a, b, score FROM scored WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT p_partkey::VARCHAR AS entry_id_a, eb.id AS entry_id_b, 100.0::DOUBLE AS score, 'exact' AS status FROM part JOIN eb ON f = lower(p_name)
UNION ALL SELECT p_partkey::VARCHAR, first_id, round(score, 6), 'fuzzy' FROM part JOIN best ON a = lower(p_name) JOIN kb USING (b)"""


def _match_sides(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").cast("string").alias("entry_id"), F.lower("p_name").alias("form_norm"))
    b = p.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("entry_id"), F.col("p_partkey").alias("line_no"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_name")).otherwise(F.lower(F.replace("p_name", F.lit("a"), F.lit("o")))).alias("form_norm"))
    return a, b


@query("j6_match", _MATCH)
def _j6(spark, d):
    return compare.match_entries(*_match_sides(spark, d), 90.0).select("entry_id_a", "entry_id_b", F.round("score", 6).alias("score"), "status")


_MATCH_LINKS = _MATCH.split("SELECT p_partkey::VARCHAR AS entry_id_a")[0] + """SELECT p_partkey::VARCHAR AS entry_id_a, first_id AS entry_id_b, n_links, 100.0::DOUBLE AS score, 'exact' AS status FROM part JOIN kb ON b = lower(p_name) JOIN (SELECT f, count(*) AS n_links FROM eb GROUP BY f) ON f = b
UNION ALL SELECT p_partkey::VARCHAR, first_id, 1, round(score, 6), 'fuzzy' FROM part JOIN best ON a = lower(p_name) JOIN kb USING (b)"""


@query("j6_match_links", _MATCH_LINKS)
def _j6_links(spark, d):
    """The matches of j6_match, a row for each entry with the number of its links."""
    return compare.match_links(*_match_sides(spark, d), 90.0).select("entry_id_a", "entry_id_b", "n_links", F.round("score", 6).alias("score"), "status")


@query("g1_cluster", """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, 100 + n_regionkey::BIGINT AS b FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey::BIGINT FROM supplier WHERE s_acctbal > 0),
  ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS c FROM ends UNION SELECT r.node, x.b FROM reach r JOIN ends x ON r.c = x.a)
  SELECT node, min(c) AS component FROM reach GROUP BY 1""")
def _g1(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1000).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return graph.components(n.unionByName(s))


@query("a12_matrix", """SELECT c_mktsegment AS label, coalesce(arg_max(c_name, c_custkey) FILTER (c_nationkey = 1), 'ABSENT') AS "1", coalesce(arg_max(c_name, c_custkey) FILTER (c_nationkey = 2), 'ABSENT') AS "2" FROM customer GROUP BY 1""")
def _a12(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("string").alias("dict_id"), F.col("c_name").alias("value"), F.col("c_custkey").alias("ord"))
    return compare.matrix(c, ["1", "2"])


# ---- listing, counts and curation


@query("a4_top_issues", f"WITH {_PART}, {_ISSUE_CASES} SELECT code, kind, count(*) AS n FROM issues GROUP BY 1, 2 ORDER BY n DESC, code, kind LIMIT 3")
def _a4(spark, d):
    return listing.top_issues(parsing.line_issues(parsing.classify(tb.part_lines(spark, d))), 3)


@query("a7_distinct_letters", f"{_ALL} SELECT CASE WHEN regexp_matches(ltrim(headword_key), '^[a-zA-Z]') THEN upper(ltrim(headword_key)[1]) ELSE '#' END AS bucket, count(DISTINCT headword_key) AS n FROM keyed GROUP BY 1")
def _a7(spark, d):
    k = compare.with_key(tb.entries(spark, d))
    return listing.bucket_counts(k.withColumn("alpha_bucket", T.stored_bucket(F.col("headword_key"))), distinct="headword_key")


@query("j9_issue_counts", f"WITH {_PART}, {_ISSUE_CASES} SELECT source_path, line_no, (SELECT count(*) FROM issues i WHERE i.source_path = c.source_path AND i.line_no = c.line_no) AS n_issues FROM classified c")
def _j9(spark, d):
    c = parsing.classify(tb.part_lines(spark, d))
    return listing.issue_counts(c.select("source_path", "line_no"), parsing.line_issues(c))


@query("l1_page", f"{_ALL} SELECT dict_id, line_no::INT AS line_no, entry_id FROM entries WHERE regexp_matches(headword_raw, '^[A-Z]') ORDER BY dict_id, line_no, entry_id LIMIT 100 OFFSET 100")
def _l1(spark, d):
    e = tb.entries(spark, d).where(F.rlike("headword_raw", F.lit("^[A-Z]"))).withColumn("section", F.col("dict_id"))
    return listing.page(e, 100, 2).select("dict_id", "line_no", "entry_id")


@query("e3_except", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def _e3(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().join(table(spark, d, "events").select(F.col("user_id").alias("k")), "k", "left_anti")


@query("m2_replay", """WITH log AS (SELECT event_id, user_id AS k, event_type AS t, value FROM events),
  s AS (SELECT k, arg_max(CASE WHEN t = 'click' THEN 'validated' ELSE 'reviewed' END, event_id) FILTER (t IN ('click', 'view')) AS st, arg_max('v' || floor(value)::BIGINT, event_id) FILTER (t NOT IN ('click', 'view')) AS hw FROM log GROUP BY 1)
  SELECT c_custkey AS entry_id, hw AS headword_edit, coalesce(st, 'auto') AS status FROM customer LEFT JOIN s ON c_custkey = k""")
def _m2(spark, d):
    none = F.lit(None).cast("string")
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), none.alias("headword_edit"), none.alias("pron_edit"), none.alias("definition_edit"), F.lit("auto").alias("status"), F.lit(False).alias("is_deleted"))
    t = F.col("event_type")
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("entry_id"), F.when(t == "click", "VALIDATE").when(t == "view", "REVIEW").otherwise("EDIT").alias("op"), F.lit("headword_edit").alias("field"), F.concat(F.lit("v"), F.floor("value").cast("string")).alias("value"))
    return curation.replay(e, log).select("entry_id", "headword_edit", "status")


@query("m5_split", "SELECT c_custkey AS line_no, unnest(string_split(c_name, '#')) AS headword_raw FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 5")
def _m5(spark, d):
    c = table(spark, d, "customer")
    e = c.select(F.lit("c").alias("dict_id"), F.lit("f").alias("source_path"), F.col("c_custkey").alias("line_no"), F.col("c_name").alias("headword_raw"), F.col("c_custkey").cast("string").alias("entry_id"))
    parts = c.where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("entry_id"), F.split("c_name", "#").alias("headwords"))
    return curation.split_entries(e, parts).select("line_no", "headword_raw")


@query("m6_merge", """WITH e AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 40)::INT END AS page, c_custkey + 1 - 2 * (c_custkey % 2) AS other FROM customer)
  SELECT least(a.c_custkey, b.c_custkey) AS line_no, a.c_name || ' ' || b.c_name AS headword_raw, trim(a.c_mktsegment || ' / ' || b.c_mktsegment) AS definition_raw, least(a.page, b.page) AS page, 'f' || a.c_nationkey || '+f' || b.c_nationkey || '#merge' AS source_path
  FROM e a JOIN e b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, page, 'f' || c_nationkey FROM e WHERE NOT (c_custkey % 2 = 1 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)) AND NOT (c_custkey % 2 = 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer))""")
def _m6(spark, d):
    c = table(spark, d, "customer")
    page = F.when(F.col("c_custkey") % 3 == 0, None).otherwise((F.col("c_custkey") % 40).cast("int")).alias("page")
    e = c.select(F.lit("c").alias("dict_id"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("source_path"), F.col("c_custkey").alias("line_no"), F.col("c_name").alias("headword_raw"), F.col("c_mktsegment").alias("definition_raw"), page, F.col("c_custkey").cast("string").alias("entry_id"))
    pairs = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").cast("string").alias("id_a"), (F.col("c_custkey") + 1).cast("string").alias("id_b"))
    return curation.merge_entries(e, pairs)[0].select("line_no", "headword_raw", "definition_raw", "page", "source_path")
