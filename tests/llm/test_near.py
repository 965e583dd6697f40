import math
import random

import numpy as np
import pytest

from glossarium.llm import embeddings, lines, minhash
from glossarium.llm.common import table


def find_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    n = len(a & b)
    return n / (len(a) + len(b) - n) if a or b else 0.0


def near_brute(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if 0.79 * len(sets[a]) <= len(sets[b]) <= 1.27 * len(sets[a]) and jaccard(sets[a], sets[b]) >= 0.8
    ]
    return find_components(list(sets), links)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f", "", "A  B\nc", "x " * 9, "one two three four five six seven eight", "é ü ß   y"]
    doc, s, _ = minhash.shingles([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(shingle_set(t)), t
    assert len(set(s[doc == 0]) & set(s[doc == 2])) == 0


@pytest.mark.parametrize("j", [0.5, 0.8])
def test_signatures_agree_as_weighted_jaccard(j):
    rng = np.random.default_rng(5)
    n = 300
    common = int(round(2 * n * j / (1 + j)))
    agree = []
    for _ in range(12):
        e = rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = e[:n], np.concatenate([e[:common], e[n:]])
        sig = minhash.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), np.full(2 * n, 2.5), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - j) < 0.04
    w = rng.uniform(0.5, 6, n)
    e = rng.integers(1, 2**63, n, dtype=np.uint64)
    want = np.minimum(w, w[::-1]).sum() / np.maximum(w, w[::-1]).sum()
    sig = minhash.signatures(np.repeat([0, 1], n), np.concatenate([e, e]), np.concatenate([w, w[::-1]]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = near_brute(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, weighted=False).collect()}
    assert got == want


def occurrences(text):
    seen, out = {}, set()
    w = (text or "").encode().lower().split()
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        seen[s] = seen.get(s, 0) + 1
        out.add((s, seen[s]))
    return out


def test_weighted_near_duplicates_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000, "p q r s t " * 30 + "u"), (10_001, "p q r s t " * 3 + "u"), (10_002, "p q r s t " * 28 + "u")]
    rows += [(10_010, "same line of words here " * 4), (10_011, "same line of words here " * 4 + "x" * 300_000)]
    sets = {i: occurrences(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 0.79 * len(sets[a]) <= len(sets[b]) <= 1.27 * len(sets[a]) and jaccard(sets[a], sets[b]) >= 0.8]
    want = find_components(list(sets), links)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert want[10_002] == 10_000 and want[10_001] == 10_001


def test_near_duplicates_of_a_bucket_beyond_a_block(spark, monkeypatch):
    """Copies of one text with edits: more than a block holds, many pairs just below the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(9)
    words = [f"g{i}" for i in range(150)]
    rows = []
    for i in range(500):
        copy = list(words)
        for _ in range(rng.randrange(1, 7)):
            del copy[rng.randrange(len(copy))]
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighted=False).collect()}
    assert got == near_brute(rows)


def test_memory_of_a_cell_whose_rows_all_agree():
    """Bands are compared for so many pairs at a time, not for all pairs of a cell; signing takes slices of text."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    n = 2 * minhash.BLOCK
    rng = np.random.default_rng(5)
    sig = np.tile(rng.integers(1, 2**32, minhash.BANDS * minhash.ROWS, dtype=np.uint32), (n, 1))
    sig[:, 1 :: minhash.ROWS] = np.arange(n, dtype=np.uint32)[:, None]  # no band is shared
    sig[:, 4:8] = 7  # but the second is
    pdf = pd.DataFrame({"cell": 1, "side": np.arange(n) // minhash.BLOCK, "doc_id": np.arange(n), "component": np.arange(n), "band": 1, "sig": [r.tobytes() for r in sig]})
    texts = [" ".join(f"w{i}x{k}" for k in range(1500)) for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    busy = minhash._busy(pdf)
    cells = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    signed = sum(b.num_rows for b in minhash._sign(True)(iter([batch])))
    signing = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(busy.doc_id) == list(range(n)) and signed == len(texts)
    assert cells < 60e6 and signing < 60e6


def test_near_duplicates_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "x50")
    rows = [(5, base), (3, near), (9, base), (1, None), (2, ""), (4, "a b"), (7, "A b"), (8, " \n"), (6, "lonely words that stand here alone today")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, bucket string")
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {5: (3, False), 3: (3, True), 9: (3, False), 1: (1, True), 2: (2, True), 4: (4, True), 7: (4, False), 8: (8, True), 6: (6, True)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_chain_without_a_common_leader(spark):
    rng = random.Random(4)
    words = [f"k{i}" for i in range(400)]
    rows = []
    for i in range(40):  # each near the one before, far from most
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(400)] = f"n{i}_{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == near_brute(rows)


def lines_brute(docs, t=0.8):
    seen, out = [], {}
    for doc_id, text in sorted(docs):
        parts = (text or "").split("\n")
        left = []
        for p in parts:
            s = frozenset(p.lower().split())
            if not s or not any(jaccard(s, o) >= t for o in seen if t * len(s) <= len(o) + 1e-9 and len(o) * t <= len(s) + 1e-9):
                left.append(p)
            if s:
                seen.append(s)
        out[doc_id] = (len(parts), len(parts) - len(left), "\n".join(left))
    return out


def test_line_dedup_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c\n\n  \nA  b C"), (4, "c b a"), (5, "a b c d e\nf"), (6, "a b c d e g\nf"), (7, "a b c d\nnew"), (8, "\ttab tab\r\nx")]
    rows += [(10 + i, f"one two three four five six seven eight nine v{i}") for i in range(30)]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, line_no int, n int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()}
    assert got == lines_brute(rows)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_without_doc_ids_and_with_repeated_rows(spark):
    rows = [(None, "first line here\nsecond line there"), (1, "first line here"), (2, "own words only"), (2, "own words only"), (3, "a b c d e f g h i")]
    rows += [(None, "a b c d e f g h i j")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.n_removed, r.text, r.lang) for r in lines.dedup_lines(df, more=("lang",)).collect())
    assert [g for g in got if g[0]] == [(1, 1, "", "x"), (2, 0, "own words only", "x"), (2, 0, "own words only", "x"), (3, 1, "", "x")]
    assert [g[1] for g in got if not g[0]] == [0, 0]


def test_line_dedup_of_many_alike_lines(spark):
    """A great group of alike lines, many of them just below the threshold, and one of few tokens."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        line = list(words)
        for _ in range(rng.randrange(0, 9)):
            line[rng.randrange(40)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(line) + "\n" + " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_cuts_at_all_white_space(spark):
    words = "one two three four five six seven eight"
    rows = [(1, words), (2, words + "\r\nnew line\r"), (3, "\t" + words), (4, words.replace(" ", "\t")), (5, words.replace(" ", "\x0b\f ")), (6, "new\tline")]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = [], {}
    for i, text in rows:  # tokens as str.split cuts them
        left = []
        for line in text.split("\n"):
            s = frozenset(line.lower().split())
            if not any(jaccard(s, o) >= 0.8 for o in seen):
                left.append(line)
            seen.append(s)
        want[i] = (len(text.split("\n")) - len(left), "\n".join(left))
    assert got == want and [got[i][0] for i in range(1, 7)] == [0, 1, 1, 1, 1, 1]


def test_near_vectors_against_brute_force(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r.vec_id, embeddings.unit(r.embedding), r.label) for r in df.collect()]
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert len(got) == len(rows)
    pairs = [(a, b) for k, (a, x, p) in enumerate(rows) for b, y, q in rows[:k] if p == q and p is not None and x is not None and y is not None and x @ y >= 0.98]
    want = find_components([r[0] for r in rows], pairs)
    same = sum(got[i].component_id == want[i] for i in want)
    assert same >= 0.99 * len(want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(pairs)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(1, base.tolist(), 1), (2, base.tolist(), 1), (3, (base * 2).tolist(), 1), (4, base.tolist(), 2), (5, base.tolist(), None), (6, None, 1), (7, [0.0] * 8, 1)]
    rows += [(8, [math.nan] + [1.0] * 7, 1), (9, [math.inf] + [1.0] * 7, 1), (10, [], 1), (11, [1.0, None] + [1.0] * 6, 1), (12, base.tolist()[:4], 1)]
    rows += [(100 + i, (base + 0.001 * rng.standard_normal(8)).tolist(), 3) for i in range(90)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, component int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got[1] == got[2] == got[3] == (2, 1)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert all(got[100 + i] == (89, 100) for i in range(90))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_a_large_clustered_label(spark):
    rng = np.random.default_rng(11)
    n, dim = 4000, 64
    x = rng.standard_normal((20, dim))[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.982 * x + (1 - 0.982**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in embeddings.near_vectors(df, window=2).collect()}
    assert sum(got[i] == got[n + i] for i in range(n)) >= 0.998 * n


def test_near_vectors_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5)).tolist(), "k") for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {}
    keys = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": None}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 61):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got[n] = sorted(tuple(r) for r in embeddings.near_vectors(df, threshold=0.9, passes=1).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[1] == got[61] and any(r[1] for r in got[1])


def test_partitions_meet_as_many_before_them_as_a_window_takes():
    assert embeddings.meetings([], 12) == []
    assert embeddings.meetings([(5, 12), (0, 3), (2, 1), (4, 12)], 12) == [(0, 2), (2, 4), (0, 4), (4, 5)]
    assert [p for p, at in embeddings.meetings([(k, 1) for k in range(30)], 4) if at == 20] == [19, 18, 17, 16]


def test_passes_follow_from_the_largest_label():
    sizes = [embeddings.effort(n) for n in (0, 1, 500, 10**4, 10**5, 5 * 10**5, 10**8)]
    assert sizes[0] == (embeddings.PASSES, embeddings.BITS) and sizes == sorted(sizes) and sizes[4][0] > 30
