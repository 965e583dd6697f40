"""Toxicity's features and trees, and mixing's posteriors, against plain loops."""

import math
import random
import re

import numpy as np
import xxhash

from glossarium.llm import mixing, toxicity
from glossarium.llm.common import table

LEXICON = {"w:vile": 3.0, "w:rot": 2.5, "p:vile": 2.2, "p:scum": 4.0, "w:häss": 2.1}


def brute_features(text):
    tokens = re.findall(r"\S+", text)
    n, hits, you_at = max(1, len(tokens)), [], []
    kinds = dict.fromkeys(("word", "stem", "hidden", "upper", "mixed", "run"), 0)
    for at, token in enumerate(tokens):
        low = token.lower()
        bare = low.strip("".join({c for c in low if not c.isalnum()} | {"_"}))
        kind, weight, key = None, 0.0, ""
        if "w:" + bare in LEXICON:
            kind, weight, key = "word", LEXICON["w:" + bare], bare
        else:
            for k in sorted(("p:" + bare[:m] for m in (4, 5, 6, 7) if len(bare) > m and "p:" + bare[:m] in LEXICON), key=lambda k: (LEXICON[k], k)):
                kind, weight, key = "stem", LEXICON[k], k
        mixed = any(not c.isalpha() for c in bare)
        if mixed and not weight:
            swapped = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}.get(c, c) for c in low)
            for plain in ("".join(c for c in s if c.isalpha()) for s in (swapped, low)):
                if plain and "w:" + plain in LEXICON and kind is None:
                    kind, weight, key = "hidden", LEXICON["w:" + plain], plain
        if kind:
            kinds[kind] += 1
            hits.append((at, weight, key))
        if bare in toxicity.SECOND_PERSON:
            you_at.append(at)
        kinds["upper"] += len(token) > 2 and token.isupper()
        kinds["mixed"] += mixed
        kinds["run"] += any(a == b and not (a.isalnum() or a == "_") and not a.isspace() for a, b in zip(token, token[1:]))
    raw = text.encode()
    size = max(1, len(raw))
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 or b == 0xC3 for b in raw)
    marks = sum(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in raw)
    near = sum(any(abs(at - y) <= 5 for y in you_at) for at, _, _ in hits)
    k = 1000.0 / n
    return [
        math.log(1 + len(tokens)), kinds["word"] * k, kinds["stem"] * k, kinds["hidden"] * k, sum(w for _, w, _ in hits) * k, max((w for _, w, _ in hits), default=0.0),
        len(hits), len({key for _, _, key in hits}), near * k, len(you_at) * k, upper / max(1, upper + lower), kinds["upper"] / n, raw.count(b"!") / size, raw.count(b"?") / size,
        (marks - raw.count(b"!") - raw.count(b"?")) / size, sum(48 <= b <= 57 for b in raw) / size, kinds["mixed"] / n, kinds["run"] / n, size / n,
    ]


def test_features_equal_plain_loops():
    rng = random.Random(7)
    words = ["vile", "VILE", "vileness", "scumbag", "sc-um", "v1le", "v!le!!", "r0t", "rot.", "(rot)", "you", "You,", "tú", "häss", "plain", "words", "a", "B2B", "...", "??", "x__y", "A!!", "é", "12", "vi.le"]
    cache = toxicity.Words(LEXICON)
    for text in ["", " ", "vile", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(300)), "vile you " * 20_000]:
        assert np.allclose(toxicity.features(text, cache), brute_features(text)), text[:200]


def test_a_tree_takes_the_best_split_of_each_node():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, g = rng.integers(0, 6, (80, 4)), rng.standard_normal(80)
        h = rng.uniform(0.1, 1, 80)
        splits, value = toxicity._tree(x, g, h, 6)
        node = np.zeros(80, int)
        for depth in range(toxicity.DEPTH):
            for k in range(1 << depth):
                at = node == k
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + toxicity.RIDGE)
                gains = {(j, b): score(at & (x[:, j] <= b)) + score(at & (x[:, j] > b)) - score(at) for j in range(4) for b in range(6) if min((at & (x[:, j] <= b)).sum(), (at & (x[:, j] > b)).sum()) >= toxicity.LEAST_LEAF}
                j, b = splits[(1 << depth) - 1 + k]
                best = max(gains.values(), default=0.0)
                if best > 1e-6:
                    assert gains[j, b] > best - 1e-6
                else:
                    assert (x[at, j] <= b).all()
            chosen = [splits[(1 << depth) - 1 + k] for k in node]
            node = node * 2 + np.array([x[i, j] > b for i, (j, b) in enumerate(chosen)])
        for leaf in range(1 << toxicity.DEPTH):
            at = node == leaf
            assert np.isclose(value[leaf], -toxicity.RATE * g[at].sum() / (h[at].sum() + toxicity.RIDGE))


def brute_posteriors(docs, labels):
    worst = {}
    for i, quality, toxic in labels:
        worst[i] = max(worst.get(i, 0), 2 if toxic == 1 else 1 if quality == 0 else 0)
    domain = {i: ("clean", "low_quality", "toxic")[w] for i, w in worst.items()}
    bins, words = {}, {}
    for i, text in docs:
        text = text or ""
        tokens = re.findall(r"[^ \t\n\x0b\f\r]+", text)
        n, size = max(1, len(tokens)), max(1, len(text))
        value = {"log_words": math.log2(n), "capitals": len(re.findall("[A-Z]", text)) / size, "marks": len(re.findall(r"[!-+:-@|]", text)) / size, "digits": len(re.findall("[0-9]", text)) / size, "word_length": size / n if text else 1 / n}
        value["word_length"] = size / n
        bins[i] = {m: sum(v > e for e in mixing.EDGES[m]) for m, v in value.items()}
        hashed = (xxhash.xxh64(t.lower().encode(), seed=42).intdigest() for t in tokens)
        words[i] = {(h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS for h in hashed}
    known = [i for i, _ in docs if i in domain]
    total = {d: sum(domain[i] == d for i in known) for d in mixing.DOMAINS}
    weight = {}
    for b in set().union(*(words[i] for i in known)) if known else ():
        held = {d: sum(domain[i] == d and b in words[i] for i in known) for d in mixing.DOMAINS}
        share = sum(held.values()) / len(known)
        spread = {d: math.sqrt(total[d] * share * (1 - share)) for d in mixing.DOMAINS}
        if any(abs(held[d] - total[d] * share) > mixing.DEVIATIONS * spread[d] > 0 for d in mixing.DOMAINS):
            weight[b] = {d: math.log((held[d] + mixing.PRIOR * share) / (total[d] + mixing.PRIOR) / share) for d in mixing.DOMAINS}
    out = {}
    for i, _ in docs:
        s = {}
        for d in mixing.DOMAINS:
            s[d] = math.log(total[d] + 1) + sum(weight[b][d] for b in words[i] if b in weight)
            for m, edges in mixing.EDGES.items():
                s[d] += math.log((sum(domain[j] == d and bins[j][m] == bins[i][m] for j in known) + 1) / (total[d] + len(edges) + 1))
        e = {d: math.exp(v - max(s.values())) for d, v in s.items()}
        out[i] = [e[d] / sum(e.values()) for d in mixing.DOMAINS]
    return out


def test_posteriors_equal_plain_naive_bayes(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "A1! \t b\x0bC\n")]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.p for r in mixing.mix(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute_posteriors(docs, labels)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
