"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of lexicons learned from labelled texts (words and word beginnings that mark the label),
how near those stand to a second person, capitals, punctuation and obfuscation. One pass computes them; the model is
small and travels with the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, doc_text, ship, slices, table

#: Most labelled rows that the model is fitted on; of more, a hash of the id picks about so many.
MAX_LABELLED = 24_000
#: Most entries of the learned lexicon, and the fewest toxic texts that must hold one.
MAX_LEXICON = 3000
MIN_TOXIC_TEXTS = 3
#: Least log odds ratio of an entry.
MIN_LOG_ODDS = 2.0
#: Lengths of word beginnings that can be entries.
STEMS = (4, 5, 6, 7)
#: Words apart at most for a second person to stand near an entry.
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.15, 32, 5, 1.0
#: Score from which a text counts as toxic.
THRESHOLD = 0.3

# Pronouns and determiners of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split()
)
# Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

FEATURES = (
    "log_words", "word_hits", "stem_hits", "hidden_hits", "hit_weight", "most_weight", "hit_count", "distinct_hits",
    "near_you", "you_rate", "upper_letters", "upper_words", "exclamations", "questions", "other_marks", "digits",
    "mixed_words", "mark_runs", "word_length",
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"([^\w\s])\1")
WORD, STEM, HIDDEN, YOU, UPPER, MIXED, RUN = (1 << k for k in range(7))


def grams(word: str) -> list[str]:
    """Lexicon keys of a bare lower-case word: itself and its beginnings."""
    return ["w:" + word, *("p:" + word[:n] for n in STEMS if len(word) > n)]


class Words(dict):
    """Token to (flags, weight, entry), worked out once for each distinct token and kept."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def find(self, word: str) -> tuple[int, float, str]:
        lexicon = self.lexicon
        if (w := lexicon.get("w:" + word)) is not None:
            return WORD, w, word
        w, key = max(((lexicon[k], k) for k in grams(word)[1:] if k in lexicon), default=(0.0, ""))
        return (STEM, w, key) if key else (0, 0.0, "")

    def __missing__(self, token: str) -> tuple[int, float, str]:
        low = token.lower()
        bare = _EDGE.sub("", low)
        flags, weight, key = self.find(bare) if bare else (0, 0.0, "")
        if bare in SECOND_PERSON:
            flags |= YOU
        if len(token) > 2 and token.isupper():
            flags |= UPPER
        if bare and _INNER.search(bare):
            flags |= MIXED
            if not weight:
                for plain in (_INNER.sub("", low.translate(LOOKALIKES)), _INNER.sub("", low)):
                    if plain and "w:" + plain in self.lexicon:
                        flags, weight, key = flags | HIDDEN, self.lexicon["w:" + plain], plain
                        break
        if _RUN.search(token):
            flags |= RUN
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[token] = (flags, weight, key)
        return got


def features(text: str, words: Words) -> list[float]:
    tokens = text.split()
    n = max(1, len(tokens))
    found = [words[t] for t in tokens]
    flags = np.fromiter([f[0] for f in found], np.uint8, len(found))
    hit = np.flatnonzero(flags & (WORD | STEM | HIDDEN))
    you = np.flatnonzero(flags & YOU)
    weights = [found[i][1] for i in hit]
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        left = hit - you[np.maximum(at - 1, 0)]
        right = you[np.minimum(at, len(you) - 1)] - hit
        near = int((np.minimum(np.abs(left), np.abs(right)) <= NEAR).sum())
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum()) + int(raw[0xC3])
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    count = lambda bit: float(np.count_nonzero(flags & bit))
    k = 1000.0 / n
    return [
        math.log1p(len(tokens)), count(WORD) * k, count(STEM) * k, count(HIDDEN) * k, sum(weights) * k, max(weights, default=0.0),
        float(len(hit)), float(len({found[i][2] for i in hit})), near * k, len(you) * k, upper / max(1, upper + lower),
        count(UPPER) / n, raw[33] / size, raw[63] / size, (marks - int(raw[33]) - int(raw[63])) / size,
        int(raw[48:58].sum()) / size, count(MIXED) / n, count(RUN) / n, size / n,
    ]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A level-wise tree of DEPTH levels: (feature, bin) for each inner node, values of the leaves."""
    node = np.zeros(len(g), np.int64)
    splits: list[tuple[int, int]] = []
    for depth in range(DEPTH):
        width = 1 << depth
        best = [(0.0, 0, bins)] * width
        for j in range(x.shape[1]):
            cell = node * bins + x[:, j]
            sums = [np.bincount(cell, v, width * bins).reshape(width, bins).cumsum(1) for v in (g, h, np.ones_like(g))]
            left_g, left_h, left_n = sums
            all_g, all_h, all_n = (s[:, -1:] for s in sums)
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_n < LEAST_LEAF) | (all_n - left_n < LEAST_LEAF)] = 0
            for k, b in enumerate(gain.argmax(1)):
                if gain[k, b] > best[k][0] + 1e-9:
                    best[k] = (float(gain[k, b]), j, int(b))
        splits += [(j, b) for _, j, b in best]
        feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
        node = node * 2 + (x[np.arange(len(g)), feature[node]] > cut[node])
    leaves = 1 << DEPTH
    value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
    return splits, value * RATE


class Boosted:
    """Binary gradient boosting on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        self.cuts = cuts
        self.base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        binned, f = self.binned(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = _tree(binned, p - y, p * (1 - p), BINS)
            self.trees.append(tree)
            f += self.apply(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1).astype(np.int64)

    @staticmethod
    def apply(tree, binned: np.ndarray) -> np.ndarray:
        splits, value = tree
        rows, node = np.arange(len(binned)), np.zeros(len(binned), np.int64)
        feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for depth in range(DEPTH):
            at = (1 << depth) - 1 + node
            node = node * 2 + (binned[rows, feature[at]] > cut[at])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return sum((self.apply(t, binned) for t in self.trees), np.full(len(x), self.base))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit (pool adjacent violators); equal scores pool first."""
    at, back = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # mean, weight, first knot, last knot
    for k, (total, n) in enumerate(zip(np.bincount(back, y), np.bincount(back))):
        blocks.append([total / n, n, at[k], at[k]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[:] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2], last]
    return np.array([b[k] for b in blocks for k in (2, 3)]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Model:
    """A lexicon, trees and a calibration; scores are 0 to 1. A slight share of the trees' own probability keeps
    apart what the calibration pools."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray):
        self.lexicon = lexicon
        self.rate = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y.sum() < len(y):
            fold = np.arange(len(y)) % 3
            out = np.zeros(len(y))
            for k in range(3):
                part = Boosted(x[fold != k], y[fold != k])
                out[fold == k] = part.margin(x[fold == k])
            self.trees = Boosted(x, y)
            self.knots, self.means = isotonic(out, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        m = self.trees.margin(x)
        return np.clip(0.98 * np.interp(m, self.knots, self.means) + 0.02 / (1 + np.exp(-m)), 0, 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
            names=["gram", "toxic", "clean"],
        )

    for batch in slices(batches):
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            bare = {_EDGE.sub("", t) for t in set(text.as_py().lower().split())}
            (toxic if label else clean).update({g for w in bare if w for g in grams(w)})
        if len(toxic) + len(clean) > 400_000:
            yield out()
            toxic.clear()
            clean.clear()
    yield out()


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Log odds ratios of the words and beginnings that mark toxic texts, from rows (text, label 0 or 1)."""
    totals = labelled.groupBy("label").count().collect()
    n = {int(r["label"]): r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return {}
    counts = labelled.select("text", "label").mapInArrow(_count_grams, "gram string, toxic long, clean long")
    counts = counts.groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (F.lit(n[1]) - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(n[0]) - F.col("c") + 0.5))
    best = counts.where(F.col("t") >= MIN_TOXIC_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "gram").limit(MAX_LEXICON)
    return {r["gram"]: r["odds"] for r in best.collect()}


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in slices(batches):
            x = [features(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most about ``max_labelled`` of the labelled rows (doc_id, toxic) given, half of them for the lexicon
    and half for trees and calibration. Rows with a null label or without a document are left out; of several labels
    for a document the largest counts; one class alone gives its rate as every score."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = marks.count()
    share = min(1.0, max_labelled / max(1, n))
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000))
    marks = marks.where(spot < int(share * 1_000_000)).withColumn("half", spot % 2)
    rows = doc_text(docs).join(F.broadcast(marks), "doc_id")
    lexicon = learn_lexicon(rows.where("half = 0"))
    x = rows.where("half = 1").mapInArrow(_featured(lexicon), "doc_id long, x array<double>")
    got = x.join(marks.select("doc_id", "label"), "doc_id").orderBy("doc_id").select("x", "label").collect()
    return Model(lexicon, np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score 0 to 1 of each whole text, row by row and without a shuffle. Null and empty texts are scored
    as texts without words; equal texts score alike; an empty table gives none; further columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in slices(batches):
            x = np.array([features(t.as_py(), words) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"]
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2)
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
