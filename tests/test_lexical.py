import pytest
from pyspark.sql import functions as F

from glossarium.functions import profiles
from glossarium.functions import text as T
from glossarium.operators import compare, curation, filters, graph, listing, parsing, templates
from glossarium.sources import readers, sinks


def lines_df(spark, rows, path="s"):
    return spark.createDataFrame([(path, i, r) for i, r in enumerate(rows, 1)], "source_path string, line_no int, raw string")


SAMPLE = ["MO", "1 mot, v", "3 mólenar, ſ", "ΓΡ", "3 óʹbrinal, ſ", "1", "brumm", "11 wrongone, x", "2 commaless v"]


def test_sample_lines(spark):
    c = parsing.classify(lines_df(spark, SAMPLE))
    got = [(r.section, r.syllables, r.headword_raw, r.pos_raw) for r in parsing.parsed_entries(c).orderBy("line_no").collect()]
    assert got == [("MO", 1, "mot", "v"), ("MO", 3, "mólenar", "ſ"), ("GR", 3, "óʹbrinal", "ſ")]
    issues = sorted((r.line_no, r.code) for r in parsing.line_issues(c).collect())
    assert issues == [(6, "PAGE_MARKER"), (7, "UNPARSED_LINE"), (8, "INVALID_POS"), (8, "SYLLABLES_OUT_OF_RANGE"), (8, "UNPARSED_LINE"), (9, "MISSING_COMMA"), (9, "UNPARSED_LINE")]


def test_preset(spark):
    p = parsing.Preset("p", r"(\d+)\s+(\S+), (\S+) (\S+)", {"syllables": 1, "headword": 2, "pos": 3, "origin": 4}, {"f.": "ſ"}, {"l.": "Latin"})
    r = parsing.parsed_entries(parsing.classify(lines_df(spark, ["4 oʹlibander, f. L.", "brumm"]), p)).first()
    assert (r.syllables, r.headword_raw, r.pos_norm, r.origin_norm) == (4, "oʹlibander", "ſ", "Latin")
    with pytest.raises(ValueError):
        parsing.Preset("p", "(a)", {"headword": 2})


def test_source_filter(spark):
    df = lines_df(spark, ["PREFACE", "INTRO", "alpha", "beta", "BIBLIOGRAPHY", "gamma"])
    rule = filters.SourceFilter(drop_after=("^BIBLIOGRAPHY$",), line_ranges=((1, 2),), drop_lines=("^PREFACE$",))
    got = {r.line_no: r.drop_stage for r in filters.filter_source(df, rule).collect()}
    assert got == {1: "ranges", 2: "ranges", 3: None, 4: None, 5: "after", 6: "after"}
    r = filters.filter_report(filters.filter_source(df, rule)).first()
    assert (r.kept_lines, r.dropped_ranges, r.dropped_after, r.dropped_regex) == (2, 2, 2, 0)


def drafts(df):
    return [(r.headword, r.pron, r.definition, r.pos, r.reason) for r in df.collect()]


def test_templates(spark):
    one = lambda t: lines_df(spark, [t])
    got = drafts(templates.wordlist(one("alpha ... — beta *")))
    assert [g[0] for g in got if g[4] is None] == ["alpha", "beta"] and sum(g[4] == "PUNCT_ONLY_TOKEN" for g in got) == 3
    assert drafts(templates.wordlist(one("gárner/")))[0][0] == "gárner"
    assert drafts(templates.wordlist(one("")))[0][4] == "EMPTY_HEADWORD"
    assert drafts(templates.entry_definition(one("mot, sens court")))[0][:3] == ("mot", None, "sens court")
    assert drafts(templates.entry_definition(one("une ligne entière")))[0][4] == "UNRECOGNIZED_RECORD"
    assert drafts(templates.headword_pron(one("mot\tmo")))[0][:2] == ("mot", "mo")
    assert drafts(templates.headword_pron(one("tóp   tɔp"), separator="multi_spaces"))[0][:2] == ("tóp", "tɔp")
    got = drafts(templates.three_columns(one("Dénoser , v. a.   To unwrap.   Toû unnräpp.")))[0]
    assert got[:4] == ("Dénoser", "Toû unnräpp.", "To unwrap.", "v. a.")
    got = drafts(templates.three_columns(one("Frissoler v. a.   To shake out.   Toû cheïk' aut.")))[0]
    assert (got[0], got[3]) == ("Frissoler", "v. a.")
    got = drafts(templates.three_columns(one("Grimaner , v. a.\tTo climb.\tTotí klaïmm.")))[0]
    assert got[:3] == ("Grimaner", "Totí klaïmm.", "To climb.")
    rec = spark.createDataFrame([({"head": "mot; tom", "pron": "mo", "def": "sense"},)], "csv_row map<string,string>")
    assert [g[:3] for g in drafts(templates.csv_mapping(rec, "head", "pron", "def", "semicolon"))] == [("mot", "mo", "sense"), ("tom", "mo", "sense")]


def test_recommender(spark):
    two = lines_df(spark, ["Dénoser , v. a.   To unwrap.   Toû", "Frissoler v. a.   To shake out.   Toû"])
    best = lambda df: tuple(templates.recommend(df, key="line_no").first()[c] for c in ("template", "separator"))
    assert best(two) == ("three_columns", "auto")
    assert best(lines_df(spark, ["mot\tmo", "kat\tkæt"])) == ("headword_pron", "tab")


def test_profile_forms(spark):
    df = spark.createDataFrame([("Mólénaſ",), ("óʹbrinal",), ("a ̄",), ("abc☃",), (None,)], "w string")
    r = {x.w: x for x in profiles.apply_profile(df, "w", profiles.Profile(paren_primes=True, render_source="display")).collect()}
    assert r["Mólénaſ"].form_norm == "molenas"
    f = r["óʹbrinal"].features
    assert (f.stress, f.primary_stress_count, f.prime_count) == ("primary", 1, 1) and r["óʹbrinal"].form_render == "(ó)brinal"
    assert r["a ̄"].features.combining_detached_count == 1
    assert r["abc☃"].unknown_symbols == ["☃"] and r[None].form_norm == ""
    with pytest.raises(ValueError):
        profiles.Profile(unicode="NFX")


def test_text_functions(spark):
    df = spark.createDataFrame([("alpha",), (" Éclair",), ("3alpha",), ("123",)], "w string")
    assert [r[0] for r in df.select(T.alpha_bucket(F.col("w"))).collect()] == ["A", "E", "A", "#"]
    df = spark.createDataFrame([("A Word Book (1812)",), ("  Épreuve   générale  ",)], "w string")
    assert [r[0] for r in df.select(T.slug(F.col("w"))).collect()] == ["a_word_book_1812", "epreuve_generale"]
    space = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    df = spark.createDataFrame([(space + "a" + space + "b" + space,)], "w string")
    assert df.select(T.squeeze(F.col("w"))).first()[0] == "a b"
    text = "a\r\nb\rc\nd\x0be\x85f g\n"
    df = spark.createDataFrame([(text,)], "w string")
    assert df.select(T.split_lines(F.col("w"))).first()[0] == text.splitlines()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, d in enumerate(b, 1):
            row[j], last = (last + 1 if ch == d else max(row[j], row[j - 1])), row[j]
    return row[-1]


def ratio(a, b):
    return (1.0 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) * 100.0


def test_similar_pairs_lose_nothing(spark):
    import random

    rng = random.Random(3)
    words = lambda n: sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(n)})
    a, b = words(80), words(80)
    x, y = (spark.createDataFrame([(w,) for w in ws], "headword_key string") for ws in (a, b))
    for t in (60, 80):
        got = {(r.ka, r.kb): r.score for r in compare.similar_pairs(x, y, t).collect()}
        want = {(p, q): ratio(p, q) for p in a for q in b if ratio(p, q) >= t}
        assert got == pytest.approx(want)


def entries_of(spark, keys):
    return spark.createDataFrame([(k, f"id-{k}") for k in keys], "headword_key string, entry_id string")


def test_greedy_and_mutual(spark):
    a, b = entries_of(spark, ["bfdf", "dfec", "efde"]), entries_of(spark, ["efad", "defe", "dcea"])
    fuzzy = lambda alg: {(r.headword_key, r.key_b) for r in compare.align(a, b, alg, 70).where("method = 'fuzzy'").collect()}
    assert len(fuzzy("greedy")) == 2 and ("efde", "efad") in fuzzy("greedy") and len(fuzzy("mutual_best")) == 1
    a, b = entries_of(spark, ["color", "colur"]), entries_of(spark, ["colour", "beta"])
    assert compare.align(a, b, "greedy", 80).where("method = 'fuzzy'").count() == 1


def test_coverage(spark):
    rows = [("A", "alpha"), ("A", "beta"), ("B", "alpha"), ("B", "gamma")]
    df = compare.with_key(spark.createDataFrame(rows, "dict_id string, headword_raw string"))
    r = compare.coverage_counts(compare.coverage(df, ["A", "B"]), ["A", "B"]).first()
    assert (r.union_count, r.common_all, r.unique_a, r.unique_b) == (3, 1, 1, 1)


def test_match_and_cluster(spark):
    a = spark.createDataFrame([("a1", "alpha"), ("a2", "beta")], "entry_id string, form_norm string")
    b = spark.createDataFrame([("b1", "alpha", 1), ("b2", "betta", 2)], "entry_id string, form_norm string, line_no int")
    m = compare.match_entries(a, b, 80)
    assert {(r.entry_id_a, r.entry_id_b, r.status) for r in m.collect()} == {("a1", "b1", "exact"), ("a2", "b2", "fuzzy")}
    labels = a.select("entry_id", F.col("form_norm").alias("label")).unionByName(b.select("entry_id", F.col("form_norm").alias("label")))
    assert {(r.label, r.entry_id) for r in compare.cluster(m, labels).collect()} == {("alpha", "a1"), ("alpha", "b1"), ("beta", "a2"), ("beta", "b2")}


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_components_of_a_long_chain(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)  # false: links lie in several partitions
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overrides(spark):
    d = spark.createDataFrame([("k1", 0, "alpha beta", "alpha beta", None, None, "OK", None), ("k2", 0, "x", "y", None, None, "OK", None)], "record_key string, draft_no int, headword string, pron string, definition string, pos string, status string, reason string")
    o = spark.createDataFrame([("k1", 1, "SKIP_RECORD", None), ("k1", 2, "SPLIT", [("alpha", None), ("beta", None)])], "record_key string, override_id int, op string, entries array<struct<headword:string,pron:string>>")
    got = sorted((r.record_key, r.headword, r.pron) for r in templates.apply_overrides(d, o).collect())
    assert got == [("k1", "alpha", "alpha"), ("k1", "beta", "beta"), ("k2", "x", "y")]
    got = templates.apply_overrides(d, o.where("override_id = 1")).where("reason = 'SKIP_RECORD'")
    assert got.count() == 1


def test_curation(spark):
    e = spark.createDataFrame([("1", "a", None, None, "auto", False), ("2", "b", None, None, "auto", False)], "entry_id string, headword_edit string, pron_edit string, definition_edit string, status string, is_deleted boolean")
    log = spark.createDataFrame([(1, "1", "EDIT", "headword_edit", "z"), (2, "1", "EDIT", "headword_edit", " "), (3, "2", "DELETE", None, None), (4, "1", "VALIDATE", None, None)], "event_id int, entry_id string, op string, field string, value string")
    got = {r.entry_id: (r.headword_edit, r.status, r.is_deleted) for r in curation.replay(e, log).collect()}
    assert got == {"1": (None, "validated", False), "2": ("b", "auto", True)}
    got = {r.entry_id: r.is_deleted for r in curation.replay(e, curation.undo_last(log)).collect()}
    assert got == {"1": False, "2": False}
    p = spark.createDataFrame([("x", None, None, None), ("y", None, "p", None)], "headword_raw string, headword_edit string, pron_raw string, pron_edit string")
    assert [(r.pron_edit, r.filled) for r in curation.fill_pron(p).orderBy("headword_raw").collect()] == [("x", True), (None, False)]


def test_page_lines_in_two_columns(spark):
    words = [(1, 10.0, 10.0, "left"), (1, 40.0, 10.5, "one"), (1, 300.0, 10.0, "right"), (1, 330.0, 10.0, "one"), (1, 10.0, 30.0, "left"), (1, 40.0, 30.0, "two"), (1, 300.0, 31.0, "right"), (1, 330.0, 30.0, "two")]
    df = spark.createDataFrame(words, "page long, x0 double, top double, text string")
    got = [r.text for r in readers.page_lines(df, 2).orderBy("page", "col", "line_no").collect()]
    assert got == ["left one", "left two", "right one", "right two"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_text("x\ny\n")
    (tmp_path / "in/a.txt").write_text("y\nz")
    lines = readers.text_files(spark, str(tmp_path / "in"))
    assert lines.count() == 4 and sorted(r.raw for r in readers.merge_lines(lines).collect()) == ["x", "y", "z"]
    assert all("-" in r.stored_name for r in readers.file_digests(spark, str(tmp_path / "in")).collect())
    e = spark.createDataFrame([("en", "a", {"k": "v"}), ("fr", "b", None)], "dict_id string, h string, extra map<string,string>")
    sinks.write_entries(e, str(tmp_path / "e"))
    sinks.write_entries(e.where("dict_id = 'en'").withColumn("h", F.lit("c")), str(tmp_path / "e"))
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "e")).collect()) == ["b", "c"]
    sinks.write_csv(e, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.save_run("r1", {"t": e}, str(tmp_path / "runs"))
    assert sinks.load_run(spark, "r1", "t", str(tmp_path / "runs")).count() == 2


def test_listing(spark):
    e = spark.createDataFrame([("s", i, f"e{i}", i % 2 == 0) for i in range(1, 7)], "section string, line_no int, entry_id string, keep boolean")
    assert [r.entry_id for r in listing.page(e.where("keep"), 1, 2).collect()] == ["e4"]
    extra = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "", "c": "3"})], "x map<string,string>, p map<string,string>")
    assert extra.select(curation.patch_extra(F.col("x"), F.col("p"))).first()[0] == {"a": "1", "c": "3"}


def test_streamed_headwords(spark, tmp_path):
    from glossarium.streaming.lines import stream_headwords

    lines_df(spark, ["alpha beta", "... gamma,"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_path string, line_no int, raw string").parquet(str(tmp_path / "in"))
    q = stream_headwords(stream).writeStream.format("memory").queryName("heads").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.headword for r in spark.table("heads").collect()) == ["alpha", "beta", "gamma"]
