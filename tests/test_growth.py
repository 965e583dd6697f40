"""Steps that are to grow with their input: results on odd rows, and what their plans hold."""

from collections import defaultdict

from pyspark.sql import functions as F

from glossarium.llm import lines
from glossarium.operators import compare, templates
from glossarium.plans import testbed as tb


def _documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_entries_first_place_without_sorting_tokens(spark, tmp_path):
    ids = [None, 0, 1, 2, 9, 10, 11, 19, 100, 101, 999, -1, -10, -2, -9223372036854775808, 9223372036854775807]
    rows = [(i, f"a{k % 3} b{k % 5}, --\r\n　c{k % 7} é{k % 2};\n\nz", "en" if k % 4 else None) for k, i in enumerate(ids)] + [(5, None, "fr"), (6, "", "fr"), (7, "one\ntwo one", "fr")]
    d = _documents(spark, tmp_path, rows)
    first = defaultdict(list)
    for i, text, lang in rows:
        for n, line in enumerate((text or "").splitlines(), 1):
            for word in (w.rstrip(templates.TRAILING) for w in line.split()):
                if any(c.isalnum() for c in word):
                    first[lang, word].append(((i is not None, f"doc/{i}"), n))
    expected = {(lang, word, min(at)[0][1] if min(at)[0][0] else None, min(at)[1]) for (lang, word), at in first.items()}
    out = tb.entries(spark, d)
    assert {(r.dict_id, r.headword_raw, r.source_path, r.line_no) for r in out.collect()} == expected
    # the least place of a word is held in a hash table: no task sorts its tokens
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_headwords_are_those_of_the_word_list(spark):
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(["", " ", None, "a  b, c.", "... ?!", "\tx/ |y| ;z", "é٣ ʹ 1.", ".a."])], "k int, raw string")
    want = templates.wordlist(lines).where("status = 'OK'").select("k", "headword")
    assert sorted(map(tuple, templates.headwords(lines).select("k", "headword").collect())) == sorted(map(tuple, want.collect()))


def test_matches_of_a_frequent_form_in_blocks_and_as_links(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 3)
    forms = ["anvil"] * 20 + ["bolt", " bolt ", "anvils", "ring", " ", None]
    a = spark.createDataFrame([(f"a{k}", f) for k, f in enumerate(forms)], "entry_id string, form_norm string")
    b = spark.createDataFrame([(f"b{k}", 100 - k, f) for k, f in enumerate(["anvil"] * 7 + ["bolt", "xyz", None])], "entry_id string, line_no int, form_norm string")
    pairs = compare.match_entries(a, b, 80.0).collect()
    want = {(f"a{k}", f"b{n}") for k in range(20) for n in range(7)} | {("a20", "b7"), ("a21", "b7"), ("a22", "b6")}
    assert len(pairs) == len(want) and {(r.entry_id_a, r.entry_id_b) for r in pairs} == want
    links = {r.entry_id_a: (r.entry_id_b, r.n_links, r.status) for r in compare.match_links(a, b, 80.0).collect()}
    assert links == {f"a{k}": ("b6", 7, "exact") for k in range(20)} | {"a20": ("b7", 1, "exact"), "a21": ("b7", 1, "exact"), "a22": ("b6", 1, "fuzzy")}


def test_copies_of_a_frequent_form_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 3)
    monkeypatch.setattr(compare, "TASK", 100, raising=False)
    ids = spark.range(40).select(F.col("id").cast("string").alias("entry_id"), F.col("id").alias("line_no"), F.concat(F.lit("form"), F.col("id") % 2).alias("form_norm"))
    out = compare.match_entries(ids, ids, 80.0)
    assert sorted((r.entry_id_a, r.entry_id_b) for r in out.collect()) == sorted((str(a), str(b)) for a in range(40) for b in range(a % 2, 40, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    # what grows with the entries of a form, or with all entries, does not go to the driver: neither the copies nor the entries
    assert any("SortMergeJoin [headword_key" in j and "block" in j for j in joins)
    assert not [j for j in joins if "BroadcastHashJoin" in j and "block" in j.split("Inner")[0]]
    # 800 pairs, 100 a task
    assert "REPARTITION_BY_NUM" in plan and "8), REPARTITION_BY_NUM" in plan


def test_line_candidates_in_parts_are_all_candidates(spark, monkeypatch):
    names, write = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: names.append(name) or write(df, name))
    words = [f"w{k}" for k in range(40)]
    texts = ["\n".join(" ".join(words[(3 * d + 7 * n + j * (1 + n % 3)) % 40] for j in range(10 + d % 3)) for n in range(6)) for d in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, kept = [], {}
    for d, text in enumerate(texts):
        kept[d] = []
        for line in text.split("\n"):
            t = set(line.split())
            if not any(len(t & u) / len(t | u) >= 0.8 for u in seen):
                kept[d].append(line)
            seen.append(t)
    assert 0 < sum(map(len, kept.values())) < 180
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {d: "\n".join(v) for d, v in kept.items()}
    assert names.count("line_candidates") == lines.PARTS > 1


def test_line_crowds_meet_their_first_line_and_few_lines_each_other(spark, monkeypatch):
    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta iota word{i}") for i in range(12)] + [(90, "rare one two three"), (91, "rare one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for crowd in (2, 1000):
        monkeypatch.setattr(lines, "CROWD", crowd)
        names = []
        keep = lines.stored
        monkeypatch.setattr(lines, "stored", lambda df, name="part": names.append((name, df.count())) or keep(df, name))
        got[crowd] = sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(docs).collect())
        monkeypatch.setattr(lines, "stored", keep)
        crowds = dict(names)["line_crowds"]
        assert crowds > 0 if crowd == 2 else crowds == 0
    assert got[2] == got[1000] == [(0, 0), *((i, 1) for i in range(1, 12)), (90, 0), (91, 1)]
