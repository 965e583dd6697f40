"""Items that no query can show, as they are read or written by the driver: a test each, named by the item."""

import json
import os

import pytest

from glossarium.functions.profiles import Profile
from glossarium.operators import filters, quality, workflows
from glossarium.sources import config, readers, sinks

PRESET = {"parser_id": "mine", "version": 1, "entry_regex": r"(\d+)\s+(\S+),\s*(\S+)$", "fields": {"syllables": 1, "headword_raw": 2, "pos_raw": 3}}


def write(path, data):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")


@pytest.mark.parametrize(
    "change",
    [{"parser_id": " "}, {"version": "1"}, {"version": None}, {"entry_regex": "("}, {"entry_regex": None}, {"fields": {"syllables": 1, "headword_raw": 2}}, {"fields": {"syllables": 0, "headword_raw": 2, "pos_raw": 3}},
     {"fields": {"syllables": 1, "headword_raw": 2, "pos_raw": 4}}, {"pos_map": {"n": 1}}, {"origin_map": []}, {"allow_extra_trailing": "yes"}],
)
def test_x4_preset_validation(change):
    assert config.preset_of(PRESET).groups == {"syllables": 1, "headword": 2, "pos": 3}
    with pytest.raises(config.ConfigError):
        config.preset_of(PRESET | change)


def test_x5_preset_discovery(tmp_path):
    for name, id_ in (("en/b.yml", "own_b"), ("en/a.yaml", "own_a"), ("parsers/c.yml", "shared"), ("d.yml", "top")):
        write(tmp_path / name, PRESET | {"parser_id": id_})
    write(tmp_path / "en/broken.yml", "entry_regex: (")
    write(tmp_path / "en/list.yml", "- 1")
    write(tmp_path / "en/note.txt", "x")
    assert [p.parser_id for p in config.discover_presets(tmp_path, "en").values()] == ["own_a", "own_b", "shared", "top"]
    assert [p.parser_id for p in config.discover_presets(tmp_path).values()] == ["shared", "top"]
    assert config.resolve_preset(tmp_path, "en", "auto").parser_id == "own_a"
    assert config.resolve_preset(tmp_path, "en", "shared").parser_id == "shared" and config.resolve_preset(tmp_path, "en", "d").parser_id == "top"
    assert config.resolve_preset(tmp_path, "en", str(tmp_path / "parsers/c.yml")).parser_id == "shared"


def test_u28_unique_slug():
    assert config.unique_slug("The Spelling Dictionary (1737)", []) == "the_spelling_dictionary_1737"
    assert config.unique_slug("  Édition   spéciale  ", ["edition_speciale", "edition_speciale_3"]) == "edition_speciale_2"
    assert config.unique_slug("a", ["a", "a_2", "a_3"]) == "a_4" and config.unique_slug("!!", ["corpus_1"]) == "corpus_2" and config.unique_slug("", [], "book") == "book_1"


@pytest.mark.parametrize(
    "settings, want",
    [
        ({"render_mode": "none"}, {"render_enabled": False}), ({"render_mode": "accent"}, {"render_enabled": True, "render_source": "norm", "paren_accents": True, "paren_primes": False}),
        ({"render_mode": " PRIME "}, {"render_source": "display", "paren_primes": True}), ({"stress_mode": "prime"}, {"require_prime": True, "require_acute": False}),
        ({"stress_mode": "acute"}, {"require_prime": False, "require_acute": True}), ({"stress_mode": "both"}, {"require_prime": True, "require_acute": True}),
        ({"lowercase": False, "strip_diacritics": True}, {"norm_lower": False, "strip_diacritics": True}), ({"lowercase": 0, "version": "2"}, {"norm_lower": True, "version": 1}),
    ],
)
def test_u34_profile_overrides(settings, want):
    got = config.override_profile(Profile("p", 1), settings)
    assert {k: getattr(got, k) for k in want} == want and got.profile_id == "p"


def test_u35_profile_yaml_round_trip(tmp_path):
    p = Profile("p", 4, unicode="NFKD", display_lower=True, strip_diacritics=True, remove_punctuation=True, keep_hyphen=False, char_map={"æ": "ae", "þ": "th"}, open_paren="[", close_paren="]", allowed_symbols="%", quantity_marks={"¯": "long", "˘": "short"})
    write(tmp_path / "p.yml", config.profile_yaml(p))
    back = config.load_profile(tmp_path / "p.yml")
    assert back.sha256() == config.load_profile(tmp_path / "p.yml").sha256() and (back.char_map, back.quantity_marks, back.unicode) == (p.char_map, p.quantity_marks, "NFKD")
    for text in ("- 1", "a: [", "unicode: {normalization: NFX}\nprofile_id: a\nversion: 1"):
        write(tmp_path / "q.yml", text)
        with pytest.raises(config.ConfigError):
            config.load_profile(tmp_path / "q.yml")
    with pytest.raises(config.ConfigError):
        config.load_profile(tmp_path / "none.yml")


def test_q8_invalid_profile_is_an_error_at_its_path(spark, tmp_path):
    write(tmp_path / "p.yml", "version: x\nnorm: 3")
    with pytest.raises(config.ConfigError) as e:
        config.load_profile(tmp_path / "p.yml")
    r = quality.invalid_profile(spark, "d", str(tmp_path / "p.yml"), e.value.errors).first()
    assert (r.dict_id, r.source_path, r.line_no, r.kind, r.code) == ("d", str(tmp_path / "p.yml"), 0, "error", "PROFILE_INVALID") and "profile_id is required" in r.details["errors"]


def test_f1c_filter_configuration():
    c = config.filters_of({"default": {"exclude_line_ranges": [" 3 - 4 ", 7], "case_insensitive": False}, "sources": {"a*": {"exclude_line_ranges": []}}})
    assert c.rule("b")[0] == filters.SourceFilter(line_ranges=((3, 4), (7, 7)), ignore_case=False) and c.rule("a")[0].line_ranges == ()
    for bad in ({"default": {"exclude_line_ranges": [True]}}, {"default": {"exclude_line_ranges": [0]}}, {"default": {"drop_line_regexes": ["["]}}, {"sources": {" ": {}}}, {"sources": []}, {"enabled": "no"}):
        with pytest.raises(config.ConfigError):
            config.filters_of(bad)


def test_f1d_filter_discovery(tmp_path):
    assert config.find_filters(tmp_path, "en") is None
    for name in ("source_filters.yaml", "source_filters/source_filters.yml", "en/source_filters.yml"):
        write(tmp_path / name, {"enabled": False})
        assert config.find_filters(tmp_path, "en") == tmp_path / name
    assert config.find_filters(tmp_path, " ") == tmp_path / "source_filters/source_filters.yml"


def test_p1_run_with_rules_by_source(spark):
    lines = [("x/a.txt", 1, "preface"), ("x/a.txt", 2, "1 alpha, v"), ("x/a.txt", 3, "1 beta, v"), ("x/b.txt", 1, "1 gamma, v"), ("x/b.txt", 2, "1 delta, v")]
    df = spark.createDataFrame(lines, "source_path string, line_no int, raw string")
    c = config.filters_of({"default": {"exclude_line_ranges": ["2"]}, "sources": {"a.txt": {"drop_before_regex": "^1 beta", "exclude_line_ranges": []}}})
    run = workflows.run_pipeline(df, "d", Profile(), rule=c)
    assert sorted(r.headword_raw for r in run.entries.collect()) == ["beta", "gamma"]
    assert {r.source_path: (r.total_lines, r.kept_lines, r.dropped_before, r.dropped_ranges) for r in run.report.collect()} == {"x/a.txt": (3, 1, 2, 0), "x/b.txt": (2, 1, 0, 1)}


def test_k2_issues_are_appended_by_corpus(spark, tmp_path):
    ddl = "dict_id string, source_path string, line_no int, kind string, code string, raw string, details map<string,string>"
    for k, corpus in enumerate(("en", "fr", "en")):
        sinks.append_issues(spark.createDataFrame([(corpus, "s", k, "warning", "X", None, None)], ddl), str(tmp_path / "i"))
    got = spark.read.parquet(str(tmp_path / "i"))
    assert sorted((r.dict_id, r.line_no) for r in got.collect()) == [("en", 0), ("en", 2), ("fr", 1)]
    assert {p.name for p in (tmp_path / "i").iterdir() if p.is_dir()} == {"dict_id=en", "dict_id=fr"}


def test_k15_runs_of_one_folder_stay_apart(spark, tmp_path):
    for run, n in (("r1", 2), ("r2", 3), ("r1", 4)):
        sinks.save_run(run, {"rows": spark.range(n).toDF("k")}, str(tmp_path))
    assert sinks.load_run(spark, "r1", "rows", str(tmp_path)).count() == 4 and sinks.load_run(spark, "r2", "rows", str(tmp_path)).count() == 3


def test_k16_run_log_has_a_line_for_each_event(spark, tmp_path):
    for k in range(3):
        sinks.append_log(spark, str(tmp_path / "log"), "imported", files=k, name="é")
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted(g["summary"]["files"] for g in got) == [0, 1, 2] and {(g["event"], g["summary"]["name"]) for g in got} == {("imported", "é")}


def test_s3_text_files_are_found_below_a_folder(spark, tmp_path):
    for name, text in (("a.txt", "1\n2"), ("sub/deep/b.txt", "3"), ("c.csv", "x"), ("sub/d.TXT", "y")):
        write(tmp_path / name, text)
    assert sorted(r.raw for r in readers.text_files(spark, str(tmp_path)).collect()) == ["1", "2", "3"]


def test_s15_symbols_of_a_corpus_go_before_shared_ones(tmp_path):
    write(tmp_path / "symbols.yml", "symbols: [b, 1]")
    assert config.symbols(tmp_path, "en") == ("1", "b")
    write(tmp_path / "en/symbols.yaml", "symbols: {ȝ: yogh}")
    assert config.symbols(tmp_path, "en") == ("ȝ",) and config.symbols(tmp_path, "fr") == ("1", "b")
