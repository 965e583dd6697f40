"""Rules by source, carried values, split text files, overrides, undo and comparison runs."""

import random

import pytest
from pyspark.sql import functions as F

from glossarium.operators import compare, comparison, curation, filters, paging, parsing, quality, templates
from glossarium.operators.carry import carried
from glossarium.sources import config, readers, sinks


def brute_filter(lines, rule):
    import re

    flags = re.IGNORECASE if rule.ignore_case else 0
    hit = lambda ps, s: any(re.search(p, s, flags) for p in ps)
    before = min((n for n, s in lines if hit(rule.drop_before, s)), default=None)
    after = min((n for n, s in lines if hit(rule.drop_after, s)), default=None)
    out = {}
    for n, s in lines:
        if before is not None and n < before:
            out[n] = "before"
        elif after is not None and n >= after:
            out[n] = "after"
        elif any(lo <= n <= hi for lo, hi in rule.line_ranges):
            out[n] = "ranges"
        else:
            out[n] = "regex" if hit(rule.drop_lines, s) else None
    return out


CONFIG = {
    "default": {"drop_line_regexes": ["^x"], "exclude_line_ranges": ["2"], "case_insensitive": True},
    "sources": {
        "special*.txt": {"exclude_line_ranges": ["3-4"], "drop_before_regex": "^start"},
        "*/sub/*": {"drop_line_regexes": ["END$"], "case_insensitive": False},
        "SPECIAL1.TXT": {"drop_after_regex": "^stop", "exclude_line_ranges": []},
    },
}


def test_rules_by_source_in_one_pass(spark):
    c = config.filters_of(CONFIG, "/p")
    rng = random.Random(2)
    words = ["x one", "X two", "start", "stop", "the end", "the END", "a", ""]
    sources = {p: [(n, rng.choice(words)) for n in range(1, 12)] for p in ("/p/a.txt", "/p/special1.txt", "/p/sub/special2.txt", "/p/sub/b.txt", "/q/Special9.txt", None)}
    rows = [(p, n, s, "clash") for p, ls in sources.items() for n, s in ls]
    got = filters.filter_sources(spark.createDataFrame(rows, "source_path string, line_no int, raw string, rule string"), c).collect()
    for p, ls in sources.items():
        rule, fits = c.rule(p)
        assert {r.line_no: r.drop_stage for r in got if r.source_path == p} == brute_filter(ls, rule), p
        assert {tuple(r.rule_patterns) for r in got if r.source_path == p} == {tuple(fits)}
    one = filters.filter_source(spark.createDataFrame(rows, "source_path string, line_no int, raw string, rule string"), c.rule(None)[0])
    assert {r.line_no: r.drop_stage for r in one.where("source_path is null").collect()} == brute_filter(sources[None], c.rule(None)[0])
    off = config.filters_of(CONFIG | {"enabled": False})
    assert filters.filter_sources(spark.createDataFrame(rows, "source_path string, line_no int, raw string, rule string"), off).where("drop_stage is not null").count() == 0
    assert filters.filter_sources(spark.createDataFrame([], "source_path string, line_no int, raw string"), c).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_values_are_carried_across_blocks(spark, block):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([None, None, None, f"v{n}"])) for n in range(200)]
    got = carried(spark.createDataFrame(rows, "k string, n int, v string").repartition(3), ["k"], "n", F.col("v"), "last", block)
    want, last = {}, {}
    for k, n, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[n] = last[k]
    assert {r.n: r["last"] for r in got.collect()} == want and got.columns == ["k", "n", "v", "last"]


def test_sections_of_a_long_source(spark):
    lines = [("s", n, "AB" if n % 9000 == 1 else "CD" if n == 12000 else "1 word, v") for n in range(1, 20001)] + [("t", 1, "1 word, v")]
    got = {(r.source_path, r.line_no): r.section for r in parsing.classify(spark.createDataFrame(lines, "source_path string, line_no int, raw string")).collect()}
    assert all(got["s", n] == ("CD" if 12000 <= n <= 18000 else "AB") for n in range(1, 20001)) and got["t", 1] == ""


ENDS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "\r\r\n", "\n\n"]


def test_text_files_are_split_and_numbered(spark, tmp_path):
    rng = random.Random(6)
    texts = {"empty": "", "end": "\n", "none": "a", "bom": "﻿a\nb", "bom2": "﻿a\n", "vt": "abc\x0b", "vtn": "abc\x0b\n", "cr": "a\r", "two": "a\r\r\n"}
    for k in range(12):
        texts[f"r{k}"] = "".join("é" * rng.randrange(4) + rng.choice(["w", ""]) + rng.choice(ENDS) for _ in range(rng.randrange(1, 400))) + rng.choice(["", "last"])
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"a\xff\nb")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        lines = readers.text_files(spark, str(tmp_path))
        got = {}
        for r in lines.collect():
            got.setdefault(r.source_path.rsplit("/", 1)[1].removesuffix(".txt"), []).append((r.line_no, r.raw))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        want = list(enumerate(text.removeprefix("﻿").splitlines(), 1))
        assert sorted(got.get(name, [])) == want, name
    assert sorted(got["bad"]) == [(1, "a�"), (2, "b")]


DRAFT = "record_key string, draft_no int, headword string, pron string, definition string, pos string, status string, reason string"
OVER = "record_key string, override_id int, op string, entries array<struct<headword:string,pron:string,definition:string>>, headword string, pron string, definition string, pos string"


def test_overrides_lose_no_record(spark):
    keys = ["plain", "null_entries", "empty_list", "blanks", "null_item", "scalar", "unknown", "skip", "defs", "edit_blank"]
    d = spark.createDataFrame([(k, n, f"h{n}", f"h{n}" if k != "defs" else "p", "d0", "n", "OK", None) for k in [*keys, None] for n in (0, 1)], DRAFT)
    none = (None, None, None, None)
    o = spark.createDataFrame(
        [
            ("null_entries", 1, "SPLIT_RECORD", None, *none), ("empty_list", 1, "EDIT_RECORD", [], *none), ("blanks", 1, "SPLIT_RECORD", [(" ", "x", None)], *none),
            ("null_item", 1, "SPLIT_RECORD", [None, (" a ", None, None), ("b", "q", "e")], *none), ("scalar", 1, "EDIT_RECORD", None, " new ", None, "nd", None),
            ("unknown", 1, "NOTE", [("z", None, None)], *none), ("skip", 1, "SPLIT_RECORD", [("z", None, None)], *none), ("skip", 2, "SKIP_RECORD", None, *none),
            ("defs", 1, "SPLIT_RECORD", [("a", None, "own"), ("b", None, " ")], *none), ("edit_blank", 1, "EDIT_RECORD", [(None, "x", None)], None, "np", None, "v"),
            (None, 9, "SKIP_RECORD", None, *none), ("nowhere", 1, "SKIP_RECORD", None, *none),
        ],
        OVER,
    )
    rows = lambda preview: sorted((r.record_key or "", r.draft_no, r.headword, r.pron, r.definition, r.pos, r.status) for r in templates.apply_overrides(d, o, preview).collect())
    as_is = lambda k: [(k, n, f"h{n}", f"h{n}", "d0", "n", "OK") for n in (0, 1)]
    want = [*as_is(""), *as_is("plain"), *as_is("null_entries"), *as_is("blanks"), *as_is("unknown")]
    want += [("empty_list", 0, "h0", "h0", "d0", "n", "OK"), ("scalar", 0, "new", "new", "nd", "n", "OK"), ("edit_blank", 0, "h0", "np", "d0", "v", "OK")]
    want += [("null_item", 0, "a", "a", "d0", "n", "OK"), ("null_item", 1, "b", "q", "e", "n", "OK"), ("skip", 0, None, None, "d0", "n", "IGNORED")]
    want += [("defs", 0, "a", "p", "own", "n", "OK"), ("defs", 1, "b", "p", "d0", "n", "OK")]
    assert rows(False) == sorted(want, key=lambda r: (r[0], r[1]))
    assert ("defs", 1, "b", "p", None, "n", "OK") in rows(True)
    left = templates.delete_overrides(o, spark.createDataFrame([("skip", 2)], "record_key string, override_id int").select("override_id")).where("record_key = 'skip'")
    assert left.count() == 1 and templates.delete_overrides(o, spark.createDataFrame([("skip",)], "record_key string")).where("record_key = 'skip'").count() == 0


def test_templates_of_records_with_a_draft_s_names(spark):
    r = spark.createDataFrame([("a b", 7, "x", "k")], "raw string, draft_no int, status string, record_key string")
    assert [(x.record_key, x.draft_no, x.headword, x.status) for x in templates.wordlist(r).collect()] == [("k", 0, "a", "OK"), ("k", 1, "b", "OK")]
    assert templates.entry_definition(r).columns == ["raw", "record_key", "draft_no", "headword", "pron", "definition", "pos", "status", "reason"]


class Store:
    """One entry as a store keeps it: undo puts back what the last event found, and is an event itself."""

    def __init__(self):
        self.fields, self.deleted, self.last = dict.fromkeys(("headword_edit", "pron_edit", "status")), False, None
        self.fields["status"] = "auto"

    def do(self, op, field, value):
        before = dict(self.fields)
        if op == "UNDO":
            if self.last and (changes := {k: v for k, v in self.last[0].items() if k in self.fields}):
                self.fields |= changes
                self.last = (self.last[1], changes)
            return
        if op in ("DELETE", "RESTORE"):
            self.deleted, self.last = op == "DELETE", ({}, {})
        elif op == "CREATE_ENTRY":
            self.last = ({}, {})
        else:
            new = {field: value} if op == "EDIT" else {"status": "validated" if op == "VALIDATE" else "reviewed"}
            self.fields |= new
            self.last = (before, new)


def test_undo_is_an_event_that_undo_takes_back(spark):
    rng = random.Random(5)
    logs = {
        "edit_edit_undo_undo": [("EDIT", "headword_edit", "a"), ("EDIT", "headword_edit", "b"), ("UNDO",), ("UNDO",)],
        "edit_edit_undo": [("EDIT", "headword_edit", "a"), ("EDIT", "headword_edit", "b"), ("UNDO",)],
        "delete_undo": [("DELETE",), ("UNDO",)], "create_undo": [("CREATE_ENTRY",), ("UNDO",)], "undo_first": [("UNDO",), ("EDIT", "pron_edit", "p")],
    }
    ops = [("EDIT", "headword_edit", "x"), ("EDIT", "pron_edit", "y"), ("VALIDATE",), ("REVIEW",), ("DELETE",), ("RESTORE",), ("UNDO",), ("UNDO",), ("UNDO",)]
    for k in range(40):
        chosen = [rng.choice(ops) for _ in range(rng.randrange(1, 30))]
        logs[f"r{k}"] = [(o[0], o[1], f"{o[2]}{i}") if o[0] == "EDIT" else o for i, o in enumerate(chosen)]
    events, want, n = [], {}, 0
    turns = sorted((i, e) for e, ops_ in logs.items() for i in range(len(ops_)))
    stores = {e: Store() for e in logs}
    for i, e in turns:
        op = (*logs[e][i], None, None)[:3]
        events.append((n, e, *op))
        stores[e].do(*op)
        n += 1
    want = {e: (s.fields["headword_edit"], s.fields["pron_edit"], s.fields["status"], s.deleted) for e, s in stores.items()}
    entries = spark.createDataFrame([(e, None, None, None, "auto", False) for e in logs], "entry_id string, headword_edit string, pron_edit string, definition_edit string, status string, is_deleted boolean")
    log = spark.createDataFrame(events, "event_id long, entry_id string, op string, field string, value string").repartition(3)
    got = {r.entry_id: (r.headword_edit, r.pron_edit, r.status, r.is_deleted) for r in curation.replay(entries, log).collect()}
    assert got == want


def test_split_create_and_raw_lines(spark):
    from hashlib import sha256

    e = spark.createDataFrame([("i", "d", "f", 4, "a b", "edited", "raw p", "edit p", " def ", None, "validated", "v"), ("j", "d", "f", 9, "x", None, None, None, None, None, "auto", "v")],
        "entry_id string, dict_id string, source_path string, line_no int, headword_raw string, headword_edit string, pron_raw string, pron_edit string, definition_raw string, definition_edit string, status string, pos_raw string")
    parts = spark.createDataFrame([("i", [" a ", "", None, "b"]), ("j", ["x", " "])], "entry_id string, headwords array<string>")
    got = {r.headword_raw: r for r in curation.split_entries(e, parts).collect()}
    assert set(got) == {"a", "b", "x"} and got["x"].entry_id == "j"
    assert (got["a"].headword_edit, got["a"].pron_raw, got["a"].pron_edit, got["a"].definition_raw, got["a"].status) == (None, "edit p", None, "def", "auto")
    assert got["b"].entry_id == sha256(b"d|f#split:i:2|4|b|v").hexdigest()
    new = spark.createDataFrame([("d", " z "), ("d", "y"), ("e", "w"), ("d", " "), ("d", None)], "dict_id string, headword_raw string")
    made = {r.headword_raw: r for r in curation.create_entries(e, new)[0].where("manual_created or entry_id not in ('i', 'j')").collect()} if "manual_created" in e.columns else {r.headword_raw: r for r in curation.create_entries(e, new)[0].where("status = 'reviewed'").collect()}
    assert {h: (r.line_no, r.source_path) for h, r in made.items()} == {"y": (10, "manual://d/curation"), "z": (11, "manual://d/curation"), "w": (1, "manual://e/curation")}
    assert made["y"].entry_id == sha256(b"d|manual://d/curation|10|y|p").hexdigest()
    r = spark.createDataFrame([(None, "h", None, None), (2, "h", "a", None), (2, "h", "a", " rec ")], "s int, h string, p string, r string")
    assert [x[0] for x in r.select(quality.raw_line(F.col("s"), F.col("h"), F.col("p"), F.col("r"))).collect()] == ["0 h, v", "2 h, a", "rec"]


ENTRY = "entry_id string, dict_id string, line_no int, headword_raw string, headword_edit string, status string, is_deleted boolean, form_norm string, form_display string, pron_raw string, features_json string, syllables int, pron_norm string, pron_render string"


def some_entries(spark):
    words = {"A": ["alpha", "beta", "gamma", "colour"], "B": ["alpha", "betta", "color", "zeta"], "C": ["alpha", "gamma"]}
    rows = [(f"{c}{i}", c, i, w, None, "auto", False, w, w.title(), None, '{"stress":"%s"}' % c, i, None, None) for c, ws in words.items() for i, w in enumerate(ws)]
    return spark.createDataFrame([*rows, ("gone", "A", 9, "zeta", None, "auto", True, "zeta", "zeta", None, None, 1, None, None)], ENTRY)


def test_a_comparison_run_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    e, path = some_entries(spark), str(tmp_path / "runs")
    s = comparison.Settings(("A", "B", "C"), "A", "B", fuzzy_threshold=80)
    run = comparison.run_comparison(e, s)
    assert comparison.list_comparisons(spark, path).count() == 0
    assert comparison.counts(run) == {
        "coverage": {"union_count": 7, "common_all": 1, "unique_a": 2, "unique_b": 3}, "alignment": {"total_a": 4, "total_b": 4, "matched_exact": 1, "matched_fuzzy": 2, "unmatched": 2},
        "diff": {"total_pairs": 3, "pron_render_diff": 2, "syll_count_diff": 1, "stress_diff": 3},
    }

    def crash(_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(comparison, "counts", crash)
        with pytest.raises(OSError):
            comparison.save_comparison(run, path, "r1")
    assert comparison.list_comparisons(spark, path).count() == 0
    with pytest.raises(ValueError):
        comparison.load_table(spark, "r1", "alignment", path)
    assert comparison.save_comparison(run, path, "r1") == "r1"
    with pytest.raises(ValueError):
        comparison.save_comparison(run, path, "r1")
    second = comparison.save_comparison(run, path)
    listed = comparison.list_comparisons(spark, path).collect()
    assert [r.run_id for r in listed] == [second, "r1"] and {r.settings_sha256 for r in listed} == {s.sha256()}
    back = comparison.load_comparison(spark, "r1", path)
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert back.settings == s and all(rows(back.tables()[t]) == rows(run.tables()[t]) for t in comparison.TABLES)
    modes = [comparison.difference(e, run="r1", path=path), comparison.difference(e, alignment=run.alignment), comparison.difference(e, settings=s)]
    assert len({tuple(rows(m)) for m in modes}) == 1
    assert [r.headword_key for r in comparison.difference(e, run="r1", path=path, bucket=" c ").collect()] == ["colour"]
    assert {r.bucket: r.n for r in comparison.letters(back)["coverage"].collect()} == {"A": 1, "B": 2, "C": 2, "G": 1, "Z": 1}
    with pytest.raises(ValueError, match="differ"):
        comparison.Settings(("A", "B"), "A", "A")


def test_pages_read_their_ranges_only(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.randrange(50), f"id{k:05d}", "x", 1) for k in range(5000)]
    df = spark.createDataFrame(rows, "section string, line_no int, entry_id string, rank_ string, n int").repartition(5)
    path, want = str(tmp_path / "pages"), sorted(rows)
    paging.build_pages(df, ["section", "line_no", "entry_id"], path, 32)
    assert paging.count_rows(spark, path) == 5000
    for size, number in ((100, 1), (100, 2), (7, 333), (999, 5), (1000, 5), (100, 50), (100, 51), (6000, 1)):
        got = [tuple(r)[:5] for r in paging.read_page(spark, path, size, number).collect()]
        assert got == want[size * (number - 1) : size * number], (size, number)
    page = paging.read_page(spark, path, 100, 25)
    files = {f.rsplit("/", 2)[1] for f in page.inputFiles()}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and [r["rank"] for r in page.collect()] == list(range(2400, 2500))
    read = spark.read.parquet(f"{path}/rows").where(F.col("_part").isin([int(f.split("=")[1]) for f in files]) & (F.lit(len(files)) < 4)).count()
    assert len(files) == 32 or read < 5000 * 0.15
    paging.build_pages(df.limit(0), ["section", "line_no", "entry_id"], path)
    assert paging.read_page(spark, path).collect() == [] and paging.count_rows(spark, path) == 0


STORE = "entry_id string, headword_raw string, headword_edit string, status string, is_deleted boolean, seq int"


@pytest.mark.parametrize("keep", [False, True])
def test_upserts_over_a_store(spark, tmp_path, keep):
    path = str(tmp_path / "store")
    rows = lambda: {r.entry_id: (r.headword_raw, r.headword_edit, r.status, r.is_deleted) for r in sinks.read_entries(spark, path).collect()}
    first = [(f"e{k}", f"h{k}", None, "auto", False, 1) for k in range(40)] + [(None, "none", None, "auto", False, 1)]
    sinks.upsert_entries(spark.createDataFrame(first, STORE), path, keep_curation=keep, buckets=8)
    curated = sinks.read_entries(spark, path).withColumns({"headword_edit": F.concat(F.lit("E"), "headword_raw"), "status": F.lit("validated"), "is_deleted": F.lit(True)})
    path = str(tmp_path / "curated")
    curated.withColumn("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(8)).cast("int")).write.partitionBy("bucket").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "curated").rglob("*.parquet")}
    new = [("e1", "old", None, "reviewed", None, 1), ("e1", "new", None, "reviewed", None, 2), ("x", "added", "xe", "reviewed", False, 1)]
    sinks.upsert_entries(spark.createDataFrame([(*r, 3) for r in new], STORE + ", more int"), path, "seq", keep, 8)
    want = {e: (h, f"E{h}", "validated", True) for e, h, *_ in first}
    want["e1"] = ("new", "Eh1", "validated", True) if keep else ("new", None, "auto", False)
    want["x"] = ("added", "xe", "reviewed", False) if keep else ("added", None, "auto", False)
    assert rows() == want
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items()) >= 6  # two buckets of eight were touched
    sinks.upsert_entries(spark.createDataFrame([(None, "second", None, "auto", False, 1)], STORE), path, keep_curation=keep, buckets=8)
    assert rows()[None] == (("second", "Enone", "validated", True) if keep else ("second", None, "auto", False)) and len(rows()) == 42


def test_memberships_of_earlier_runs_stay(spark):
    ddl = "group_id string, label string, dict_id string, entry_id string, score double, status string"
    old = spark.createDataFrame([("g", "a", "d", "1", 100.0, "auto"), ("g", "a", "d", "2", 90.0, "auto"), ("h", "b", "d", "3", 100.0, "validated")], ddl)
    new = spark.createDataFrame([("g", "a", "d", "2", 100.0, "auto"), ("i", "c", "d", "1", 100.0, "auto"), ("i", "c", "d", "1", 100.0, "auto")], ddl)
    got = sorted((r.group_id, r.entry_id, r.score, r.status) for r in compare.commit_clusters(old, new).collect())
    assert got == [("g", "1", 100.0, "auto"), ("g", "2", 100.0, "auto"), ("h", "3", 100.0, "validated"), ("i", "1", 100.0, "auto")]


def test_greedy_over_one_great_component(spark):
    rng = random.Random(4)
    pairs = {}
    for a in range(3000):
        for b in rng.sample(range(max(0, a - 40), a + 40), 4):
            pairs[f"a{a:05d}", f"b{b:05d}"] = float(rng.randrange(80, 100))
    taken, want = set(), {}
    by_a = {}
    for (a, b), s in pairs.items():
        by_a.setdefault(a, []).append((-s, b))
    for a in sorted(by_a):
        for s, b in sorted(by_a[a]):
            if b not in taken:
                taken.add(b)
                want[a] = b
                break
    frame = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "ka string, kb string, score double")
    assert {r.ka: r.kb for r in compare.greedy(frame).collect()} == want


@pytest.mark.parametrize("t", [50, 75, 85, 92])
def test_candidates_of_longer_keys_lose_nothing(spark, t):
    from test_lexical import ratio

    rng = random.Random(t)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(6, 34))) for _ in range(25)]

    def edited(w):
        w = list(w)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], rng.choice("abcdefghxyz")], [rng.choice("abcdefghxyz")]])
            w = w or ["a"]
        return "".join(w)

    a, b = sorted({edited(rng.choice(base)) for _ in range(70)}), sorted({edited(rng.choice(base)) for _ in range(70)})
    x, y = (spark.createDataFrame([(w,) for w in ws], "headword_key string") for ws in (a, b))
    got = {(r.ka, r.kb): r.score for r in compare.similar_pairs(x, y, t).collect()}
    assert got == pytest.approx({(p, q): s for p in a for q in b if (s := ratio(p, q)) >= t})


def test_stored_tables_go_when_told(spark):
    from glossarium.session import drop_stored, stored

    drop_stored(spark)
    kept = stored(spark.range(5))
    (file,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    assert kept.count() == 5 and drop_stored(spark) == 1 and drop_stored(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(file)


def test_sessions_are_restored_by_key(spark, tmp_path):
    path = str(tmp_path / "sessions")
    one, two = {"corpora": ["é", "b"], "threshold": 90}, {"threshold": 80}
    keys = [sinks.save_session(spark, c, path) for c in (one, two, {"threshold": 90, "corpora": ["é", "b"]})]
    assert keys[0] == keys[2] == sinks.session_key(one) != keys[1]
    assert sinks.load_session(spark, keys[0], path) == one and sinks.load_session(spark, keys[1], path) == two
    assert [r.session_id for r in sinks.list_sessions(spark, path).collect()] == [keys[0], keys[1]]


def test_csv_files_equal_python_s_reader(spark, tmp_path):
    import csv
    import io

    rng = random.Random(3)
    cells = ["", "a", "b c", "x,y", 'say "hi"', "two\nlines", "cr\r\nlf", " padded ", "é", "=1", "#"]
    texts = {}
    for k in range(6):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["word", "sense", "word"][: rng.randrange(1, 4)] if k else ["a,b", 'q"', "n\nl", "z"])
        for _ in range(rng.randrange(0, 40)):
            w.writerow([rng.choice(cells[1:])] + [rng.choice(cells) for _ in range(rng.randrange(0, 4))])
        texts[f"f{k}.csv"] = out.getvalue() + rng.choice(["", "\n"])
    texts |= {"bom.csv": "﻿h,i\n1,2\n", "head.csv": "h,i\n", "empty.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in readers.csv_files(spark, str(tmp_path)).collect():
        got.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.record_no, r.csv_row, r.raw))
    for name, text in texts.items():
        rows = csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""))
        plain = lambda r: {k: (v or "").replace("\r\n", "\n") for k, v in r.items() if k is not None}
        want = [(n, plain(r)) for n, r in enumerate(rows, 2)]
        assert [(n, plain(row)) for n, row, _ in sorted(got.get(name, []), key=lambda x: x[0])] == want, name
        assert all(raw.count("=") >= min(6, len(row)) for _, row, raw in got.get(name, []))


def test_alignment_of_an_empty_side(spark):
    some = spark.createDataFrame([("alpha", "1"), ("", "2")], "headword_key string, entry_id string")
    for algorithm in ("greedy", "mutual_best"):
        got = compare.align(some, some.limit(0), algorithm, 80).collect()
        assert sorted((r.headword_key, r.key_b, r.method) for r in got) == [("", None, "none"), ("alpha", None, "none")]
