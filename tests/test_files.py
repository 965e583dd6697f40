import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glossarium.functions.profiles import Profile
from glossarium.operators import parsing, quality
from glossarium.sources import config, readers, sinks


def test_csv_records_and_imports(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text('word,sense\n"two\nlines",x\nplain,\n', encoding="utf-8")
    (tmp_path / "in/sub/b.csv").write_text("other\n1\n", encoding="utf-8")
    got = sorted((r.source_path.rsplit("/", 1)[-1], r.record_no, r.raw, r.csv_row) for r in readers.csv_files(spark, str(tmp_path / "in")).collect())
    assert got == [("a.csv", 2, "word=two\nlines | sense=x", {"word": "two\nlines", "sense": "x"}), ("a.csv", 3, "word=plain | sense=", {"word": "plain", "sense": ""}), ("b.csv", 2, "other=1", {"other": "1"})]
    first = readers.copy_import(spark, str(tmp_path / "in"), str(tmp_path / "out"), "*.csv")
    assert first == readers.copy_import(spark, str(tmp_path / "in"), str(tmp_path / "out"), "*.csv") and len(first) == 2
    assert len(list((tmp_path / "out").glob("*.csv"))) == 2


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.bin", "w") as z:
        z.writestr("x.txt", "one")
        z.writestr("../evil.txt", "two")
    (tmp_path / "plain.zip").write_text("no archive")
    got = {(r.path.rsplit("/", 1)[-1], r.member, bytes(r.content)) for r in readers.zip_members(spark, str(tmp_path)).collect()}
    assert got == {("a.bin", "x.txt", b"one"), ("plain.zip", None, b"no archive")}


def test_page_statistics_without_text(spark):
    df = spark.createDataFrame([(1, " "), (2, "ab")], "page long, text string")
    r = readers.page_stats(df).first()
    assert (r.pages_total, r.pages_with_text, r.chars, r.code) == (2, 0, 2, "PDF_NO_TEXT_LAYER")
    words = spark.createDataFrame([(1, 10.0, 0.0, "a"), (1, 90.0, 0.0, "b"), (2, 10.0, 0.0, " ")], "page long, x0 double, top double, text string")
    got = [(r.col, r.text) for r in readers.page_lines(words, 3, width=120.0).orderBy("col").collect()]
    assert got == [(0, "a"), (2, "b")]


def test_profile_files(tmp_path):
    text = "profile_id: mine\nversion: '3'\nnorm: {lowercase: true, strip_diacritics: true, char_map: {æ: ae}}\nfeatures:\n  marks: {prime: 'ʹ', acute_vowels: áé}\n  rules:\n    - {when: {contains: x}, set: {kind: odd}}\nqa: {enforce_stress_consistency: true, require_prime_for_primary_stress: true}\n"
    (tmp_path / "p.yml").write_text(text, encoding="utf-8")
    p = config.load_profile(tmp_path / "p.yml")
    assert (p.profile_id, p.version, p.require_prime, p.rules) == ("mine", 3, True, (({"contains": "x"}, {"kind": "odd"}),))
    (tmp_path / "q.yml").write_text(config.profile_yaml(p), encoding="utf-8")
    assert config.load_profile(tmp_path / "q.yml") == p
    with pytest.raises(config.ConfigError) as e:
        config.profile_of({"version": True, "qa": {"require_pronunciation": "yes"}, "features": {"rules": [{"when": {"pattern": "("}}]}})
    assert len(e.value.errors) == 4
    assert config.profile_of({"profile_id": "a", "version": 1, "more": 1})[1] == ["unknown key profile.more"]
    with pytest.raises(config.ConfigError):
        config.profile_of({"profile_id": "a", "version": 1, "more": 1}, strict=True)
    o = config.override_profile(p, {"render_mode": "prime", "stress_mode": "acute", "lowercase": "no"})
    assert (o.render_source, o.paren_primes, o.require_acute, o.require_prime, o.norm_lower) == ("display", True, True, False, True)


def test_invalid_profile_is_an_issue(spark):
    r = quality.invalid_profile(spark, "d", "p.yml", ["a", "b"]).first()
    assert (r.code, r.kind, r.details) == ("PROFILE_INVALID", "error", {"errors": "a; b"})


def test_preset_files(spark, tmp_path):
    (tmp_path / "en").mkdir()
    good = {"parser_id": "mine", "version": 1, "entry_regex": r"(\d+)\s+(\S+),\s*(\S+)$", "fields": {"syllables": 1, "headword_raw": 2, "pos_raw": 3}, "pos_map": {"N.": "p"}, "allow_extra_trailing": True}
    (tmp_path / "en/parser.yml").write_text(json.dumps(good), encoding="utf-8")
    (tmp_path / "en/a.yml").write_text(json.dumps(good | {"parser_id": "other"}), encoding="utf-8")
    (tmp_path / "bad.yml").write_text(json.dumps(good | {"fields": {"syllables": 9}}), encoding="utf-8")
    assert config.resolve_preset(tmp_path, "en").parser_id == "mine" and config.resolve_preset(tmp_path, "fr") is None
    assert config.resolve_preset(tmp_path, "en", "other").parser_id == "other"
    with pytest.raises(FileNotFoundError):
        config.resolve_preset(tmp_path, "en", "none")
    with pytest.raises(config.ConfigError):
        config.load_preset(tmp_path / "bad.yml")
    lines = spark.createDataFrame([("s", 1, "2 tower, n. ;"), ("s", 2, "2 tower, q")], "source_path string, line_no int, raw string")
    got = [(r.kind, r.headword_raw, r.pos_raw, r.pos_norm, r.pron_raw) for r in parsing.classify(lines, config.resolve_preset(tmp_path, "en")).orderBy("line_no").collect()]
    assert got == [("preset", "tower", "n", None, "tower"), ("preset", "tower", "q", None, "tower")]


def test_filter_files(tmp_path):
    data = {"default": {"exclude_line_ranges": [3, "5-7"], "drop_line_regexes": ["^x"]}, "sources": {"*Special.TXT": {"drop_line_regexes": []}, "sub/*": {"drop_before_regex": "^go$", "case_insensitive": False}}}
    (tmp_path / "rules/en").mkdir(parents=True)
    (tmp_path / "rules/source_filters.yml").write_text(json.dumps({"enabled": False}), encoding="utf-8")
    (tmp_path / "rules/en/source_filters.yml").write_text(json.dumps(data), encoding="utf-8")
    c = config.load_filters(tmp_path / "rules", "en")
    rule, fits = c.rule(f"{tmp_path}/data/raw/imports/sub/special.txt")
    assert fits == ["*Special.TXT", "sub/*"] and rule.line_ranges == ((3, 3), (5, 7)) and rule.drop_lines == () and rule.drop_before == ("^go$",) and not rule.ignore_case
    assert c.rule("/elsewhere/a.txt")[0].drop_lines == ("^x",)
    assert not config.load_filters(tmp_path / "rules", "fr").enabled and config.load_filters(tmp_path) is None
    for bad in ({"default": {"exclude_line_ranges": ["7-5"]}}, {"default": {"drop_before_regex": "("}}, {"odd": 1}, {"sources": {"a": {"odd": 1}}}):
        with pytest.raises(config.ConfigError):
            config.filters_of(bad)


def test_project(tmp_path):
    p = config.Project.create(tmp_path).with_corpus("Éa Book").with_corpus("Éa book").with_corpus("")
    assert [c for c, _ in p.corpora] == ["ea_book", "ea_book_2", "corpus_1"] and p.active == "ea_book"
    assert p.renamed("corpus_1", "New").corpora[2] == ("corpus_1", "New") and p.activated("corpus_1").active == "corpus_1"
    with pytest.raises(KeyError):
        p.activated("none")
    (tmp_path / "data/raw/imports/b.txt").write_text("x")
    (tmp_path / "data/raw/imports/a.CSV").write_text("x")
    assert p.source_for("wordlist").endswith("b.txt") and p.source_for("csv_mapping").endswith("a.CSV")
    (tmp_path / "rules/symbols.yml").write_text("symbols: {☃: snow, '%': percent}", encoding="utf-8")
    assert config.symbols(tmp_path / "rules", "en") == ("%", "☃") and config.symbols(tmp_path / "none") == ()
    assert Profile(inventory=config.symbols(tmp_path / "rules")).inventory == ("%", "☃")


def test_sinks(spark, tmp_path):
    issues = spark.createDataFrame([("en", "s", 1, "warning", "X", "r", {"b": "1", "a": "2"})], "dict_id string, source_path string, line_no int, kind string, code string, raw string, details map<string,string>")
    for _ in range(2):
        sinks.append_issues(issues, str(tmp_path / "issues"))
    assert spark.read.parquet(str(tmp_path / "issues")).count() == 2
    assert sinks.export_issues(issues).first().details_json == '{"a":"2","b":"1"}'
    sinks.append_log(spark, str(tmp_path / "log"), "run", entries=3)
    sinks.append_log(spark, str(tmp_path / "log"), "run", entries=4)
    assert sorted(json.loads(r.value)["summary"]["entries"] for r in spark.read.text(str(tmp_path / "log")).collect()) == [3, 4]
    assert sinks.session_key({"b": 1, "a": 2}) == sinks.session_key({"a": 2, "b": 1}) != sinks.session_key({})
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, created_at int")
    runs.write.parquet(str(tmp_path / "runs/runs"))
    assert [r.run_id for r in sinks.list_runs(spark, str(tmp_path / "runs"), 1).collect()] == ["r2"]
    sinks.write_sheets({"matrix": runs, "flags": runs.limit(1)}, str(tmp_path / "book"))
    assert spark.read.csv(str(tmp_path / "book/flags"), header=True).count() == 1
    sinks.write_jsonl(sinks.export_fields(spark.createDataFrame([("1", None, "b")], "entry_id string, headword_edit string, headword_raw string").withColumns({c: F.lit(None).cast("string") for c in ("pron_edit", "pron_raw", "definition_edit", "definition_raw", "form_display", "form_norm")})), str(tmp_path / "j"))
    row = json.loads(spark.read.text(str(tmp_path / "j")).first().value)
    assert list(row) == list(sinks.ENTRY_FIELDS) and row["headword_effective"] == "b" and row["status"] == "auto"
