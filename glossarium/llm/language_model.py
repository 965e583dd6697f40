"""Language-model scores: causal self-attention over subword ids, trained in numpy across the corpus.

A text is its words (runs without ASCII white space, A-Z lower-cased), then one end. Attention spells a word: each next id
is drawn by its class (frequent ids have their own), then by its share in the class, and whether a word ends after an id is
drawn by that id's own rate. A frequent word, which is one id with its own class, has the probability of its spelling. Let M be
that of all frequent words together at a place. Any other word has

    (1 - M) * (count - DISCOUNT) / N'  +  DISCOUNT * V' / N' * its spelling

where N' and V' count the training tokens and words that are not frequent: what the discounts take away pays for spelling
words, new ones too. All counts are of all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, doc_text, ship, slices, stored, table
from .pieces import MARK, encoder, public_model

#: Bytes of text in a block, whose distinct words and their counts travel together, and of text whose ids a worker holds at once.
BLOCK, CHUNK = 4 << 20, 1 << 20
#: Subtracted from the count of each known word that is not frequent.
DISCOUNT = 0.7
#: Classes of ids that begin a word, and of the others; width of the embedding and of the hidden layer.
CLASSES, WIDTH, HIDDEN = 128, 16, 32
#: Positions of a window, and how many of the last it scores; those before are context only.
SPAN, STRIDE = 40, 28
#: Rounds; windows in a step; step size. Each round takes its share of the windows of every training text, so that over
#: all rounds every id is a target once.
ROUNDS, STEP, RATE = 2, 32, 0.02
END = b""
_STRAY = 1e-6  # of a non-initial position for an id that begins with the word mark


class Layout:
    """Class, share in its class (log), and end rate of every id."""

    def __init__(self, count: np.ndarray, ends: np.ndarray, lone: np.ndarray, initial: np.ndarray, eos: int):
        self.initial, self.eos = initial, eos
        own = np.zeros(len(count), bool)
        self.cls = np.zeros(len(count), np.int32)
        self.inside = np.zeros(len(count))
        for side, ids in enumerate((np.flatnonzero(initial), np.flatnonzero(~initial))):
            ids = ids[np.lexsort((ids, -count[ids]))]
            single = min(len(ids), CLASSES - 24)
            self.cls[ids[:single]] = np.arange(single) + side * CLASSES
            own[ids[:single]] = side == 0
            rest = ids[single:]
            if len(rest):
                band = np.minimum(23, (24 * np.log1p(np.arange(len(rest))) / np.log1p(len(rest))).astype(int))
                self.cls[rest] = single + band + side * CLASSES
        mass = np.bincount(self.cls, count + 0.5, 2 * CLASSES)
        self.inside = np.log(count + 0.5) - np.log(mass[self.cls])
        self.end = (ends + 0.5) / (count + 1.0)
        self.end[eos] = 1.0
        #: ids that are frequent words by themselves, how many those are, and the end rate of each one's class
        self.frequent = own & (lone > 0)
        self.n_frequent, self.frequent_tokens = int(self.frequent.sum()), float(lone[self.frequent].sum())
        self.whole = np.zeros(CLASSES, np.float32)
        self.whole[self.cls[self.frequent]] = self.end[self.frequent]
        self.prior = np.log(np.maximum(mass, 1e-3) / mass.sum())
        #: log probabilities that a word ends after an id, and that it goes on
        self.log_end, self.log_more = np.log(self.end), np.log1p(-np.minimum(self.end, 1 - 1e-9))


class Attention:
    """One layer of causal self-attention with a bias for each distance, a hidden layer, and a softmax over the classes
    that can stand at a position."""

    def __init__(self, prior: np.ndarray, flat: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        n = 2 * CLASSES
        self.shapes = {
            "emb": (n + 2, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
            "dist": (SPAN,), "h": (WIDTH, HIDDEN), "hb": (HIDDEN,), "u": (HIDDEN, n), "ub": (n,),
        }
        self.p = {k: (rng.standard_normal(s) * (0.3 if k == "emb" else 0.25)).astype(np.float32) for k, s in self.shapes.items()}
        for k in ("dist", "hb"):
            self.p[k][:] = 0
        self.p["u"] *= 0.2
        self.p["ub"] = prior.astype(np.float32)
        if flat is not None:
            at = 0
            for k, s in self.shapes.items():
                size = int(np.prod(s))
                self.p[k] = flat[at : at + size].reshape(s).astype(np.float32)
                at += size
        i = np.arange(SPAN)
        self.gap = np.maximum(i[:, None] - i[None, :], 0)
        self.past = i[None, :] <= i[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.shapes])

    def forward(self, c: np.ndarray, live: np.ndarray):
        """c: classes at the positions of windows; live: positions that hold something. Hidden rows of every position."""
        p = self.p
        x = p["emb"][c]
        q, k, v = (x.reshape(-1, WIDTH) @ p[w] for w in "qkv")
        q, k, v = (a.reshape(x.shape) for a in (q, k, v))
        s = (q * np.float32(WIDTH**-0.5)) @ k.transpose(0, 2, 1)
        s += np.where(self.past, p["dist"][self.gap], np.float32(-1e4))
        s += np.where(live, np.float32(0), np.float32(-1e4))[:, None, :]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        z = s @ v
        h = x + (z.reshape(-1, WIDTH) @ p["o"]).reshape(x.shape)
        g = np.maximum(h.reshape(-1, WIDTH) @ p["h"] + p["hb"], 0)
        return g, (x, q, k, v, s, z, h)

    def gradients(self, c: np.ndarray, live: np.ndarray, target: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        g, (x, q, k, v, s, z, h) = self.forward(c, live)
        at = np.flatnonzero(scored.reshape(-1))
        t = target.reshape(-1)[at]
        d = {"u": np.zeros_like(p["u"]), "ub": np.zeros_like(p["ub"])}
        dg = np.zeros_like(g)
        for side in (0, 1):
            of = (t >= CLASSES) == bool(side)
            rows, cut = at[of], slice(side * CLASSES, (side + 1) * CLASSES)
            logits = g[rows] @ p["u"][:, cut] + p["ub"][cut]
            logits -= logits.max(1, keepdims=True, initial=-1e4)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            logits[np.arange(len(rows)), t[of] - side * CLASSES] -= 1
            logits /= max(1, len(t))
            d["u"][:, cut], d["ub"][cut] = g[rows].T @ logits, logits.sum(0)
            dg[rows] = logits @ p["u"][:, cut].T
        dg *= g > 0
        d["hb"] = dg.sum(0)
        flat = lambda a: a.reshape(-1, WIDTH)
        d["h"] = flat(h).T @ dg
        dh = (dg @ p["h"].T).reshape(x.shape)
        d["o"] = flat(z).T @ flat(dh)
        dz = (flat(dh) @ p["o"].T).reshape(x.shape)
        ds = dz @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ dz
        ds = s * (ds - (ds * s).sum(2, keepdims=True))
        d["dist"] = np.bincount(self.gap[self.past], ds.sum(0)[self.past], SPAN).astype(np.float32)
        dq, dk = ds @ k * WIDTH**-0.5, ds.transpose(0, 2, 1) @ q * WIDTH**-0.5
        dx = dh.copy()
        for w, grad in (("q", dq), ("k", dk), ("v", dv)):
            d[w] = flat(x).T @ flat(grad)
            dx += (flat(grad) @ p[w].T).reshape(x.shape)
        d["emb"] = np.stack([np.bincount(c.reshape(-1), dx[..., i].reshape(-1), len(p["emb"])) for i in range(WIDTH)], 1).astype(np.float32)
        return d


class Adam:
    """Adam steps, and ``mean``: the parameters averaged over the steps, the latest ones the most."""

    def __init__(self, net: Attention):
        self.net, self.t = net, 0
        self.m, self.s, self.mean = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(3))

    def step(self, d: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in d.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.99 * self.s[k] + 0.01 * g * g
            self.net.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)
            self.mean[k] += np.float32(4 / (self.t + 3)) * (self.net.p[k] - self.mean[k])


class Scorer:
    """The same network for scoring alone: as classes are its only inputs, what its matrices make of each class is a table,
    and only the positions that a window scores are computed."""

    def __init__(self, net: Attention, whole: np.ndarray):
        p, n = net.p, 2 * CLASSES
        emb = p["emb"]
        self.q = np.concatenate([emb @ p["q"] * np.float32(WIDTH**-0.5), np.ones((n + 2, 1), np.float32)], 1)
        self.k = np.concatenate([emb @ p["k"], np.zeros((n + 2, 1), np.float32)], 1)
        self.k[n + 1, -1] = -1e4  # the class of empty positions
        self.v = np.concatenate([emb @ p["v"] @ p["o"] @ p["h"], np.ones((n + 2, 1), np.float32)], 1)
        self.x = emb @ p["h"] + p["hb"]
        self.bias = np.where(net.past, p["dist"][net.gap], np.float32(-1e4))[SPAN - STRIDE :]
        most = np.abs(self.q[:, :-1] @ self.k[:, :-1].T).max() + np.abs(p["dist"]).max()
        self.calm = most < 40  # no weight can overflow or vanish, so none is shifted
        self.sides = []
        for side in (0, 1):
            cut = slice(side * CLASSES, (side + 1) * CLASSES)
            u, ub = np.ascontiguousarray(p["u"][:, cut]), p["ub"][cut]
            self.sides.append((u, ub, float(np.sqrt((u * u).sum(0)).max()), float(np.abs(ub).max())))
        self.sums = np.stack([np.ones(CLASSES, np.float32), whole.astype(np.float32)], 1)

    def hidden(self, c: np.ndarray) -> np.ndarray:
        """Hidden rows of the last STRIDE positions of windows of the classes c."""
        late = c[:, SPAN - STRIDE :]
        s = self.q.take(late, 0) @ self.k.take(c, 0).transpose(0, 2, 1)
        s += self.bias
        if not self.calm:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        z = s @ self.v.take(c, 0)
        g = z[..., :-1]
        g /= z[..., -1:]
        g += self.x.take(late, 0)
        return np.maximum(g, 0, out=g)

    def log_probs(self, g: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each row's target class among the classes of its kind, and at the beginnings of words the
        mean of ``whole``, a number for each initial class."""
        out, mean = np.zeros(len(target)), np.zeros(len(target))
        for side, (u, ub, steep, flat) in enumerate(self.sides):
            at = np.flatnonzero((target >= CLASSES) == bool(side))
            if not len(at):
                continue
            at = np.pad(at, (0, -len(at) % 64), "edge")  # full blocks, as products round otherwise at their edges
            rows = g.take(at, 0)
            logits = rows @ u
            logits += ub
            high = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * steep + flat > 80
            if high.any():  # by row, so that a row's result does not depend on the others
                logits[high] -= logits[high].max(1, keepdims=True)
            own = logits[np.arange(len(at)), target[at] - side * CLASSES]
            np.exp(logits, out=logits)
            total = logits @ self.sums
            out[at] = own - np.log(total[:, 0])
            if not side:
                mean[at] = total[:, 1] / total[:, 0]
        return out, mean


class Spelling:
    """Words of a block as subword ids: ids one after another, and where each word's begin."""

    def __init__(self, words: pa.Array, model_path: str, eos: int):
        get = encoder(model_path).cache.__getitem__
        marked = pc.binary_join_element_wise(pa.scalar(MARK), words.cast(pa.string()), pa.scalar(""))
        end = np.array([eos], "<u4").tobytes()
        spelled = [get(m) if n else end for m, n in zip(marked.to_pylist(), pc.binary_length(words).to_pylist())]
        self.n = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        self.at = np.cumsum(self.n) - self.n
        self.ids = np.frombuffer(b"".join(spelled), "<u4").astype(np.int64)

    def text(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of a run of words, and the number of the word that each belongs to."""
        n = self.n[words]
        owner = np.repeat(np.arange(len(words)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.ids[self.at[words][owner] + within], owner


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many ids one after another: the first target of every window, and the first id of its text. The
    windows of a text score STRIDE targets each, one after another."""
    n = -(-lengths // STRIDE)
    start = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return start[text] + k * STRIDE, start[text]


def gather(cls: np.ndarray, ends: np.ndarray, first: np.ndarray, begin: np.ndarray):
    """Inputs, which of them hold something, targets and which of those are scored, windows by positions. The input
    of a text's first target is the begin class; a window has the ids before its targets as context."""
    at = first[:, None] + np.arange(SPAN)[None, :] - (SPAN - STRIDE)  # target positions
    stop = ends[np.searchsorted(ends, first, side="right")]
    scored = (np.arange(SPAN)[None, :] >= SPAN - STRIDE) & (at < stop[:, None])
    live = (at >= begin[:, None]) & (at < stop[:, None])
    inside = np.clip(at, 0, len(cls) - 1)
    inputs = np.where(at > begin[:, None], cls[np.maximum(inside - 1, 0)], 2 * CLASSES)
    inputs[~live] = 2 * CLASSES + 1
    live[:, 0] |= ~live.any(1)
    return inputs, live, cls[inside], scored, at


def _runs(texts: list[bytes], limit: int) -> Iterator[slice]:
    """Runs of texts of about so many bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the number of their block, their fold and lower-cased bytes."""
    import pyspark

    part, k = pyspark.TaskContext.get().partitionId(), 0
    for batch in slices(batches, limit=BLOCK):
        texts = [t.as_py().encode().lower() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | k] * len(texts), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("train"), pa.array(texts, pa.binary())],
            names=["block", "doc_id", "train", "text"],
        )
        k += 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bool], list[bytes]]]:
    """Number, folds and texts of each block, of rows in order of blocks. Where a file is split inside a block, both parts are one."""
    block, train, texts = -1, [], []
    for batch in slices(batches, limit=CHUNK):
        for b, ok, text in zip(*(batch.column(c).to_pylist() for c in ("block", "train", "text"))):
            if b != block and texts:
                yield block, train, texts
                train, texts = [], []
            block = b
            train.append(ok)
            texts.append(text)
    if texts:
        yield block, train, texts


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a block and how often its training texts hold it."""
    from collections import Counter

    for block, train, texts in _blocks(batches):
        counts: Counter[bytes] = Counter()
        other: set[bytes] = {END}
        for ok, text in zip(train, texts):
            if ok:
                counts.update(text.split())
                counts[END] += 1
            else:
                other.update(text.split())
        words = [*counts, *(other - counts.keys())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(words), pa.int64()), pa.array(words, pa.binary()), pa.array([counts.get(w, 0) for w in words], pa.int64())],
            names=["block", "word", "n"],
        )


def _piece_counts(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        count, ends, lone = (np.zeros(len(e.lengths), np.int64) for _ in range(3))
        for batch in batches:
            words, c = batch.column("word"), np.asarray(batch.column("c"))
            if not len(words):
                continue
            s = Spelling(words, model_path, e.eos)
            np.add.at(count, s.ids, np.repeat(c, s.n))
            np.add.at(ends, s.ids[s.at + s.n - 1], c)
            np.add.at(lone, s.ids[s.at[s.n == 1]], c[s.n == 1])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x[at]) for x in (count, ends, lone))], names=["id", "n", "ends", "lone"])

    return run


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts one after another, an end after each, and how many words each has, its end included."""
    flat: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        before = len(flat)
        flat += t.split()
        flat.append(END)
        n[i] = len(flat) - before
    return pa.array(flat, pa.binary()), n


def _coded(layout: Layout, model_path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all ids of texts one after another, and how many ids each text has."""
    classes, lengths = [], []
    for run in _runs(texts, CHUNK):
        words, n = _words(texts[run])
        coded = words.dictionary_encode()
        ids, owner = Spelling(coded.dictionary, model_path, layout.eos).text(np.asarray(coded.indices))
        classes.append(layout.cls[ids])
        lengths.append(np.bincount(np.repeat(np.arange(len(n)), n)[owner], minlength=len(n)))
    return np.concatenate(classes), np.concatenate(lengths)


def _steps(cls: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, round_: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, live, targets, scored of the steps over the round's share of all windows of texts, in random order."""
    ends = np.cumsum(lengths)
    first, begin = windows(lengths)
    order = rng.permutation(np.arange(round_, len(first), ROUNDS))
    for at in range(0, len(order), STEP):
        pick = order[at : at + STEP]
        yield gather(cls, ends, first[pick], begin[pick])[:4]


def _train(layout: Layout, model_path: str, flat: np.ndarray | None, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Attention(layout.prior, flat)
        adam, rng = Adam(net), np.random.default_rng(round_)
        for _, train, texts in _blocks(batches):
            texts = [t for ok, t in zip(train, texts) if ok]
            if texts:
                for step in _steps(*_coded(layout, model_path, texts), rng, round_):
                    adam.step(net.gradients(*step), RATE / (1 + round_) / (1 + adam.t / 400) ** 0.5)
        if adam.t:
            net.p = adam.mean
            p = net.flat().astype(np.float64) * adam.t
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(p)), pa.int64()), pa.array(p), pa.array(np.full(len(p), float(adam.t)))], names=["i", "v", "w"]
            )

    return run


def _score(layout: Layout, model_path: str, flat: np.ndarray | None, total: int, distinct: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        """A block's documents and its words with their counts, a run of texts at a time."""
        net = Scorer(Attention(layout.prior, flat), layout.whole)
        words = known.column("word").combine_chunks()
        count = known.column("c").to_numpy().astype(np.float64)
        spelling = Spelling(words, model_path, layout.eos)
        ids, train, texts = (docs.column(c).to_pylist() for c in ("doc_id", "train", "text"))
        return pa.Table.from_batches([_score_run(net, layout, spelling, total, distinct, ids[r], train[r], texts[r], words, count) for r in _runs(texts, CHUNK)])

    return run


def _score_run(net, layout, spelling, total, distinct, doc_ids, train, texts, words, count) -> pa.RecordBatch:
    flat, n = _words(texts)
    numbers = np.asarray(pc.index_in(flat, value_set=words))
    doc = np.repeat(np.arange(len(texts)), n)
    c = count[numbers]
    base = np.log10((c + 1) / (total + distinct + 1))
    ids, owner = spelling.text(numbers)
    cls = layout.cls[ids]
    per_text = np.bincount(doc[owner], minlength=len(texts))
    ends = np.cumsum(per_text)
    logp, frequent = np.zeros(len(ids)), np.zeros(len(ids))
    first, begin = windows(per_text)
    for at in range(0, len(first), 128):
        inputs, _, target, scored, place = gather(cls, ends, first[at : at + 128], begin[at : at + 128])
        g = net.hidden(inputs).reshape(-1, HIDDEN)
        rows = np.flatnonzero(scored[:, SPAN - STRIDE :])
        where, target = (x[:, SPAN - STRIDE :].reshape(-1)[rows] for x in (place, target))
        logp[where], frequent[where] = net.log_probs(g[rows], target)
    logp += layout.inside[ids]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    initial = np.concatenate([[True], last[:-1]])
    logp += np.where(last, layout.log_end[ids], layout.log_more[ids])
    stray = ~initial & layout.initial[ids]
    logp += np.where(initial, 0.0, np.where(stray, np.log(_STRAY), np.log1p(-_STRAY)))
    word = np.bincount(owner, logp, len(numbers))
    rest = total - layout.frequent_tokens
    if rest > 0:
        common = initial & last & layout.frequent[ids]
        is_common = np.bincount(owner, common, len(numbers)) > 0
        mass = np.bincount(owner, np.where(initial, frequent, 0.0), len(numbers))
        with np.errstate(divide="ignore"):
            known = np.log(np.maximum(1 - mass, 1e-9)) + np.log(np.maximum(c - DISCOUNT, 0) / rest)
            spelled = np.log(DISCOUNT * max(1, distinct - layout.n_frequent) / rest) + word
        word = np.where(is_common, word, np.logaddexp(known, spelled))
    score = np.bincount(doc, word, len(texts)) / np.log(10)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array([not t for t in train], pa.bool_()),
            pa.array(n, pa.int64()),
            pa.array(np.bincount(doc, c > 0, len(texts)).astype(np.int64)),
            pa.array(np.full(len(texts), total, np.int64)),
            pa.array(np.bincount(doc, base, len(texts))),
            pa.array(score),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score_documents(docs: DataFrame, model_path: str, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Documents for which the condition ``held_out`` is true are not learned from (default: none). Documents are dealt
    into blocks of BLOCK bytes and written once, a row each; a block's distinct words are summed before the shuffle and meet their
    corpus-wide counts in a join that adaptive execution can split, as a frequent word has a row for each block. Blocks meet
    their words in sorted groups, one at a time, so no row, list or task holds more than a block. Training is data-parallel:
    every task steps through its training texts, block by block, a share of their windows in each round, so that over all
    rounds each id is a target once; the parameters are averaged over a task's steps, and over tasks between rounds. To the driver go the counts of the ids (as many as the tokenizer has) and the parameters.

    Null and empty texts are scored as an end alone; equal texts of a block's fold score alike; repeated rows stay; an
    empty table gives none; without training texts words are only spelled; further columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    train = ~F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(True)
    packed = doc_text(docs, train.alias("train")).mapInArrow(_pack, "block long, doc_id long, train boolean, text binary")
    blocks = stored(packed, "blocks")
    words = blocks.select("block", "train", "text").mapInArrow(_block_words, "block long, word binary, n long")
    words = stored(words, "words")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    one = counts.where("c > 0")
    stats = one.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = int(stats["total"] or 0), int(stats["distinct"])
    e = encoder(model_path)
    count, ends, lone = (np.zeros(len(e.lengths)) for _ in range(3))
    spelled = one.mapInArrow(_piece_counts(model_path), "id long, n long, ends long, lone long").groupBy("id")
    for r in spelled.agg(*(F.sum(c).alias(c) for c in ("n", "ends", "lone"))).collect():
        count[r["id"]], ends[r["id"]], lone[r["id"]] = r["n"], r["ends"], r["lone"]
    initial = np.array([e.library.id_to_piece(i).startswith(MARK) for i in range(len(count))])
    initial[e.eos] = True
    layout = Layout(count, ends, lone, initial, e.eos)
    flat = None
    for k in range(ROUNDS if total else 0):
        tuned = blocks.select("block", "train", "text").mapInArrow(_train(layout, model_path, flat, k), "i long, v double, w double")
        got = sorted(tuned.groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).collect())
        flat = np.array([r["v"] for r in got]) if got else flat
    known = words.select("block", "word").join(counts, "word").select("block", "word", "c")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(layout, model_path, flat, total, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op1_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), public_model(), crc_fold("doc_id", 7) == 2)
