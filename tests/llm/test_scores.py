import io
import random
import tracemalloc
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossarium.llm import language_model, media, mixing, toxicity, urls
from glossarium.llm.common import crc_fold, table
from glossarium.llm.pieces import MARK, encoder, public_model


# ---- language model


def test_counts_and_base_score_equal_brute_force(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, words in rows:
        if not held(i):
            for w in [*words, b""]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in language_model.score_documents(docs, public_model(), crc_fold("doc_id", 7) == 2).collect()}
    assert len(got) == len(rows)
    for i, words in rows:
        w, r = [*words, b""], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count.get(x, 0) > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    monkeypatch.setattr(language_model, "ROUNDS", 0)
    plain = language_model.score_documents(docs, public_model(), crc_fold("doc_id", 7) == 2).collect()
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.score for r in plain if r.held_out)


def test_windows_score_each_position_once_and_causally():
    lengths = np.array([1, 27, 28, 29, 100, 0, 5])
    first, begin = language_model.windows(lengths)
    cls = np.arange(lengths.sum()) % 200
    inputs, live, target, scored, at = language_model.gather(cls, np.cumsum(lengths), first, begin)
    assert sorted(at[scored].tolist()) == list(range(lengths.sum()))
    starts = set((np.cumsum(lengths) - lengths).tolist())
    for w, p in zip(*np.nonzero(scored)):
        t = at[w, p]
        assert inputs[w, p] == (2 * language_model.CLASSES if t in starts else cls[t - 1])
    net = language_model.Attention(np.zeros(2 * language_model.CLASSES))
    a, _ = net.forward(inputs, live)
    changed = inputs.copy()
    changed[:, -1] = 3
    b, _ = net.forward(changed, live)
    shape = inputs.shape + (-1,)
    before = live[:, :-1]
    assert np.allclose(a.reshape(shape)[:, :-1][before], b.reshape(shape)[:, :-1][before])


def test_scorer_is_the_network():
    net = language_model.Attention(np.zeros(2 * language_model.CLASSES))
    lengths = np.array([1, 27, 100, 3])
    first, begin = language_model.windows(lengths)
    cls = np.random.default_rng(1).integers(0, 2 * language_model.CLASSES, lengths.sum())
    inputs, live, target, scored, _ = language_model.gather(cls, np.cumsum(lengths), first, begin)
    late = np.s_[:, language_model.SPAN - language_model.STRIDE :]
    for size in (1, 1000):
        net.p["q"] *= size
        scorer = language_model.Scorer(net, np.ones(language_model.CLASSES))
        assert scorer.calm == (size == 1)
        slow = net.forward(inputs, live)[0].reshape(*inputs.shape, -1)[late]
        assert np.allclose(scorer.hidden(inputs)[scored[late]], slow[scored[late]], rtol=1e-3, atol=1e-4)
    logp, mean = scorer.log_probs(slow[scored[late]], target[scored])
    side = target[scored] >= language_model.CLASSES
    logits = slow[scored[late]] @ net.p["u"] + net.p["ub"]
    logits[(np.arange(2 * language_model.CLASSES) >= language_model.CLASSES) != side[:, None]] = -1e9
    want = logits[np.arange(len(side)), target[scored]] - np.log(np.exp(logits).sum(1))
    assert np.allclose(logp, want, atol=1e-3) and np.allclose(mean, ~side, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language_model.Attention(np.zeros(2 * language_model.CLASSES))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    c = rng.integers(0, 200, (2, language_model.SPAN))
    live = np.ones(c.shape, bool)
    live[0, :9] = False
    target = rng.integers(0, 2 * language_model.CLASSES, c.shape)
    scored = live & (np.arange(language_model.SPAN) > 15)
    rows = np.flatnonzero(scored.reshape(-1))
    scorer = lambda: language_model.Scorer(net, np.zeros(language_model.CLASSES))
    loss = lambda: -scorer().log_probs(net.forward(c, live)[0][rows], target.reshape(-1)[rows])[0].mean()
    d = net.gradients(c, live, target, scored)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert d[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=2e-4), k


def test_language_model_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b " * 50), (4, "a B " * 50), (5, "é▁ß \x00 日本"), (6, "zebra")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = language_model.score_documents(df, public_model(), F.col("doc_id") == 6).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].n_tokens == 1 and by[1].score == by[2].score and all(np.isfinite(r.score) for r in got)
    assert by[6].held_out and by[6].n_known == 1
    assert language_model.score_documents(df.limit(0), public_model()).count() == 0
    assert len(language_model.score_documents(df, public_model(), F.lit(True)).collect()) == 7


def test_training_covers_every_id_once_over_the_rounds():
    lengths = np.array([1, 300, 28, 5, 1000, 29])
    codes = np.arange(lengths.sum())
    steps = [s for k in range(language_model.ROUNDS) for s in language_model._steps(codes, lengths, np.random.default_rng(k), k)]
    assert sorted(np.concatenate([t[s] for _, _, t, s in steps]).tolist()) == codes.tolist()
    assert max(len(t) for _, _, t, _ in steps) <= language_model.STEP


def test_no_row_or_list_holds_a_block(spark, monkeypatch):
    made, write = {}, language_model.stored
    monkeypatch.setattr(language_model, "stored", lambda df, name: made.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(i, f"word{i % 7} of {i}") for i in range(50)], "doc_id long, text string")
    out = language_model.score_documents(docs, public_model())
    assert out.count() == 50 and made["blocks"].count() == 50
    assert not [kind for df in made.values() for _, kind in df.dtypes if kind.startswith("array")]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_go_on_over_batches():
    rows = [(0, True, b"a b"), (0, False, b""), (1, True, b"c"), (1, True, b"d" * 10), (1, False, b"e"), (7, True, b"")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("block", "train", "text"), r)) for r in rows[a:b]], pa.schema([("block", pa.int64()), ("train", pa.bool_()), ("text", pa.binary())])) for a, b in ((0, 1), (1, 3), (3, 3), (3, 6))]
    assert list(language_model._blocks(iter(batches))) == [(0, [True, False], [b"a b", b""]), (1, [True, True, False], [b"c", b"d" * 10, b"e"]), (7, [True], [b""])]
    assert list(language_model._blocks(iter([]))) == []


def test_a_block_is_coded_and_scored_in_runs_with_the_same_results(monkeypatch):
    e, rng = encoder(public_model()), random.Random(3)
    n = len(e.lengths)
    initial = np.array([e.library.id_to_piece(i).startswith(MARK) for i in range(n)])
    initial[e.eos] = True
    layout = language_model.Layout(np.arange(n) % 50 + 1.0, np.arange(n) % 2 + 0.5, np.zeros(n), initial, e.eos)
    vocabulary = ["".join(rng.choice("aeioubcdt") for _ in range(rng.randrange(2, 9))).encode() for _ in range(3000)]
    texts = [b" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 300, 2000]))) for _ in range(150)]
    docs = pa.table({"doc_id": range(150), "train": [True] * 150, "text": texts})
    known = pa.table({"word": pa.array([*vocabulary, b""], pa.binary()), "c": [i % 5 for i in range(3001)]})
    got, peak = [], []
    for size in (1 << 30, 1 << 16):
        monkeypatch.setattr(language_model, "CHUNK", size)
        score = language_model._score(layout, public_model(), None, 10_000, 2_000)
        score(docs, known)
        tracemalloc.start()
        got.append((score(docs, known), language_model._coded(layout, public_model(), texts)))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    (whole, codes), (runs, same) = got
    assert runs.column("score").to_pylist() == pytest.approx(whole.column("score").to_pylist(), rel=1e-7)  # products of single floats
    assert runs.drop_columns("score").equals(whole.drop_columns("score"))
    assert all((a == b).all() for a, b in zip(codes, same))
    assert peak[1] < peak[0] / 3


# ---- toxicity


def test_toxicity_finds_learned_words(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and", "rain", "tree", "house", "stone"]) + rng.choice(["", "s", "er", "ing"])
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grubfool", "vexling", "vexlord"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(400, 500))
    assert got[1000] == got[1001] < toxicity.THRESHOLD
    none = toxicity.train(docs, known.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_isotonic_is_the_least_squares_fit():
    x, y = isotonic_case()
    knots, means = toxicity.isotonic(x, y)
    fit = np.interp(x, knots, means)
    order = np.argsort(x)
    assert (np.diff(fit[order]) >= -1e-12).all()
    for t in np.linspace(0, 1, 11):  # no better step function of one level change
        for cut in x:
            assert ((fit - y) ** 2).sum() <= ((np.where(x < cut, min(t, 0.5), max(t, 0.5)) - y) ** 2).sum() + 1e-9


def isotonic_case():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 60).astype(float)
    return x, (rng.random(60) < x / 12).astype(float)


# ---- URL filters


def test_url_rules(spark):
    rows = [
        (1, "https://www.Example.ORG/es/x?q=1", "www.example.org", "/es/x", "example.org/es/", "block"),
        (2, "http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://example.org", "example.org", "", None, "allow"),
        (4, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        (5, "http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        (6, "http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "x://h?/es/", "h", "", None, "allow"),
        (9, "x://h?/es/", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in urls.url_filter(pages, labels).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *r[2:]) for r in rows], key=str)
    assert urls.url_filter(pages.limit(0), labels).count() == 0


def test_url_rules_are_mined_from_labels(spark):
    rows = [(i, f"https://{'spam.net' if i % 4 == 0 else f'h{i % 9}.net'}/{'buy' if i % 2 == 0 else 'read'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined_tokens) for r in urls.url_filter(pages, labels).collect()}
    assert all((got[i][0] == "block") == (i % 4 == 0) for i in range(200))
    assert all("spam.net" in got[i][1] for i in range(0, 200, 4))


def test_url_rules_see_deep_paths_and_long_hosts(spark):
    deep = "/".join("abcdefghijklmnopqrst")  # segments of all pages, then the one that tells
    url = lambda i: f"https://{'bad' if i % 4 == 0 else 'h' + str(i % 9)}.e.d.c.b.a.net/x" if i % 2 == 0 else f"https://h{i % 9}.net/{deep}/{'spam' if i % 4 == 1 else 'fine'}"
    pages = spark.createDataFrame([(i, url(i)) for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 > 1), 0) for i in range(320)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.url_filter(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 4 < 2) for i in range(400))


# ---- mixing


def test_rates_equal_projected_least_squares(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = mixing.mix(docs, labels).collect()
    m, p, r = (np.array([x[c] for x in rows], float) for c in ("n_tokens", "p", "rate"))
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and len(rows) == docs.count()
    total = m.sum()
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    got = (m * r) @ p / total
    assert np.abs(got - want).max() < 1e-3
    # stationarity of the projected problem: r = max(0, 1 - p . dual), dual = (totals - wanted) / ridge
    dual = (got - want) / mixing.RIDGE
    assert np.abs(np.maximum(0, 1 - p @ dual) - r).max() < 0.05 * max(1, r.max())
    copies = np.array([x["copies"] for x in rows])
    assert ((copies == np.floor(r)) | (copies == np.floor(r) + 1)).all()


@pytest.mark.parametrize("targets", [(0.84, 0.08, 0.08), (0.3, 0.4, 0.3), (1.0, 0.0, 0.0)])
def test_totals_meet_targets_or_say_how_near_they_come(spark, targets):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.3, 0.1], 400)
    m = rng.integers(1, 200, 400).astype(float)
    frame = spark.createDataFrame([(x, q.tolist()) for x, q in zip(m.tolist(), p)], "m double, p array<double>")
    wanted = dict(zip(mixing.DOMAINS, targets))
    fit = mixing.fit(frame, wanted)
    r = np.array([x.r for x in frame.select(fit.rate.alias("r")).collect()])
    assert (r >= 0).all() and np.allclose((m * r) @ p / m.sum(), fit.totals, atol=1e-9) and fit.residual < mixing.TOLERANCE and fit.passes < mixing.MAX_STEPS
    # the optimum of the projected problem: rates follow from the totals' distance
    dual = (np.array(fit.totals) - targets) / mixing.RIDGE
    assert np.abs(np.maximum(0, 1 - p @ dual) - r).max() < 0.02 * max(1, r.max())
    if min(targets) > 0:
        assert np.abs(np.array(fit.totals) - targets).max() < 1e-3
    else:  # every document has some of each domain
        assert fit.totals[2] > 0


def test_posteriors_separate_domains_by_words(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["rain", "tree", "house", "stone", "river", "cloud"]) for _ in range(30)]
        if i % 5 < 2:  # as long as a word of the others, so that no measure of the text tells
            words[rng.randrange(30)] = rng.choice(["vexer", "grubs"] if i % 5 == 0 else ["blurb", "promo"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 != 1), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.p for r in mixing.mix(docs, known).collect()}
    assert all(np.argmax(got[i]) == {0: 2, 1: 1}.get(i % 5, 0) for i in range(400, 600))


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b c", 9), (3, "a b c", 9), (4, "W! " * 9000, 9)], "doc_id long, text string, m int")
    labels = spark.createDataFrame([(3, None, None), (3, 0, None), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 5 and all(np.isfinite(r.rate) and r.rate >= 0 for r in got)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert {r.doc_id: r.domain for r in mixing.domain_of(labels).collect()} == {3: "low_quality", 4: "toxic"}


# ---- media


def test_media_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 40), (5, "hello world " * 400), (6, "hello world " * 400)]
    got = {r.doc_id: r for r in media.media_column(spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, media int")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        want = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.readframes(w.getnframes()) == want and w.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(want), zlib.crc32(want[-64:]))
    assert got[5].peak_hash == got[6].peak_hash and len(got[5].peak_hash) > 0
    assert list(got[5].peak_time) == sorted(got[5].peak_time)


def test_spectrogram_finds_a_tone():
    t = np.arange(8000) / media.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    spec = media.spectrogram(tone)
    assert abs(spec[3].argmax() * media.RATE / media.FRAME - 1000) < media.RATE / media.FRAME


def test_fingerprints_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    samples = rng.integers(90, 170, 64 * 300, dtype=np.uint8).tobytes()
    spec = media.spectrogram(samples)
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    for k in (0, 7, len(spec) - 1):
        frame = np.zeros(media.FRAME, np.float32)
        part = x[k * media.HOP : k * media.HOP + media.FRAME]
        frame[: len(part)] = part
        assert spec[k] == pytest.approx(np.abs(np.fft.rfft(frame * np.hanning(media.FRAME).astype(np.float32))), rel=1e-4, abs=1e-3)
    want = []
    for band, (lo, hi) in enumerate(zip(media.BANDS, media.BANDS[1:])):
        peaks = [max(range(lo, hi), key=lambda b: (row[b], -b)) for row in spec]
        mean = sum(float(spec[i][p]) for i, p in enumerate(peaks)) / len(spec)
        loud = [spec[i][p] >= mean - 1e-3 for i, p in enumerate(peaks)]
        for i in range(len(spec)):
            for gap in range(1, media.FAN_OUT + 1):
                if i + gap < len(spec) and loud[i] and loud[i + gap]:
                    want.append((i, peaks[i] << 20 | peaks[i + gap] << 8 | band << 4 | gap))
    t, h = media.peak_pairs(spec)
    assert list(zip(t.tolist(), h.tolist())) == sorted(want)


def test_mined_rules_equal_brute_force(spark):
    """Every combination of the few tokens there are, counted page by page."""
    from itertools import combinations

    rng = random.Random(8)
    rows = [([t for t in "abcde" if rng.random() < 0.5], rng.choice(["block", "block", "allow"])) for _ in range(400)]
    rows = [(t, "block" if "a" in t and "c" in t else y) for t, y in rows if t]
    rules, items = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.7)
    name = {r.token: r.item for r in items.collect()}
    assert set(name) == set("abcde") and all(k == v for k, v in name.items())
    want = {}
    for n in range(1, 6):
        for c in combinations("abcde", n):
            held = [y for t, y in rows if set(c) <= set(t)]
            for y in ("block", "allow"):
                if held.count(y) >= max(0.05 * len(rows), urls.MIN_PAGES) and held.count(y) >= 0.7 * len(held):
                    want[c, y] = (round(held.count(y) / len(held), 9), round(held.count(y) / len(rows), 9))
    assert {(tuple(r["items"]), r.verdict): (r.confidence, r.support) for r in rules.collect()} == want


def test_null_urls_do_not_meet(spark):
    pages = spark.createDataFrame([(i, None) for i in range(50)] + [(99, "http://org/x")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.verdict) for r in urls.url_filter(pages, labels).collect()}
    assert got[3] == ("", "allow") and len(got) == 51
