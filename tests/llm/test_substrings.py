import hashlib
import random

import numpy as np

from glossarium.llm import substrings
from glossarium.llm.common import table


def brute(docs):
    n = substrings.LENGTH
    seen = {}
    for i, t in docs:
        b = (t or "").encode()
        for q in range(len(b) - n + 1):
            seen.setdefault(b[q : q + n], []).append((i, q))
    gone = {i: np.zeros(len((t or "").encode()), bool) for i, t in docs}
    for places in seen.values():
        if len(places) > 1:
            for i, q in places:
                gone[i][q : q + n] = True
    out = {}
    for i, t in docs:
        b, g = (t or "").encode(), gone[i]
        runs = int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~g]) if b else b""
        out[i] = (len(b), int(g.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(df).collect()}


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for k in range(400):
        s = [rng.randrange(1, rng.choice((2, 3, 5, 40))) for _ in range(rng.randrange(0, 60))]
        if k % 5 == 0 and s:
            s = s * rng.randrange(1, 5)
        assert substrings.group_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:]), s


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    a = bytes(rng.choice(b"abc") for _ in range(900))
    for data in (a, b"x" * 700, b"ab" * 400, a[:300] * 3):
        c = substrings.contexts(data)
        assert c["q0"][0] == 0 and c["q1"][-1] == len(data) - substrings.LENGTH
        assert (c["q0"][1:] == c["q1"][:-1] + 1).all()
        of = {}
        for q0, q1, p in zip(c["q0"], c["q1"], c["p"]):
            for q in range(q0, q1 + 1):
                assert q <= p <= q + substrings.REACH - 1
                assert of.setdefault(data[q : q + substrings.LENGTH], p - q) == p - q


def test_equals_brute_force(spark, sf):
    df = table(spark, sf, "documents").where("length(text) < 8000")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(df) == brute(rows)


def odd_rows():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefg hé\n") for _ in range(n))
    p, q = word(260), word(230)
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 700), (5, "x" * 199), (6, "y" * 200), (7, p), (8, p), (9, word(50) + q + word(90)), (10, q[:215] + word(30) + q[10:])]
    rows += [(20 + i, word(rng.randrange(0, 60)) + p[rng.randrange(0, 40) :] + word(rng.randrange(0, 300))) for i in range(25)]
    rows += [(60, "\x00" * 450), (61, "ab" * 300), (62, word(600) * 2)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, q0 int, k string")
    assert found(df) == brute(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_spread_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 3)
    rows = odd_rows()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rows_without_doc_id_stay_and_count_as_places(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 1)
    text = odd_rows()[6][1]
    rows = substrings.remove_repeats(spark.createDataFrame([(None, text), (None, text), (1, text)], "doc_id long, text string")).collect()
    n = len(text.encode())
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, n)]
