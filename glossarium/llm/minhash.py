"""Near-duplicate documents: DartMinHash signatures of word shingles, banded joining and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import doc_text, ship, slices, stored, table

WORDS = 5
THRESHOLD = 0.8
#: Signature coordinates = BANDS * ROWS. At similarity 0.8 a pair shares no band with probability 3e-5.
BANDS, ROWS = 20, 4
#: Rows (or 512 shingles each of them) of a block when what a bucket has left is compared, and rows of all cells that
#: one call handles, about.
BLOCK, CALL = 512, 4096
#: Bytes of text that are signed or cut into elements at a time, and pairs of a cell whose bands are compared at a time: a
#: worker's memory follows them, some 60 bytes for each byte and 650 for each pair.
SLICE, PAIRS = 1 << 18, 1 << 14
#: Agreement of two signatures from which a pair is verified: 0.8 less 5 standard deviations.
AGREEMENT = 0.58

_M1, _M2, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse mod 2**64
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k : k + 1] = [np.cumprod(p)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, 64-bit hashes and numbers of occurrences of all distinct shingles, sorted by document, then hash.

    Words are runs between ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has one shingle
    of all its words, a text without words none.
    """
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * up)])
    h = mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(ends_of, start, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    s = np.zeros(len(h), np.uint64)
    left = n_words[doc] - (np.arange(len(h)) - first[doc])  # words from here to the end of the document
    for k in range(words):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        part[left <= k] = 0
        s = s * np.uint64(0x100000001B3) + part
    keep = (left >= words) | ((n_words[doc] < words) & (left == n_words[doc]))
    s, doc = mix(s[keep]), doc[keep]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[new], s[new], np.diff(np.append(first, len(s)))


def numbered(doc: np.ndarray, s: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of a shingle as an element of its own, by shingle and number: the Jaccard similarity of such sets
    is the weighted one of the counts."""
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = np.repeat(s, count)
    return np.repeat(doc, count), np.where(k > 0, mix(s + _G * k.astype(np.uint64)), s)


def _cells(limit: float) -> Iterator[tuple[int, float, float]]:
    """Rank intervals (number, from, to), the same for all sets: the first to 2**-12, then doubling ones up to 1,
    then ones of length 1."""
    at, width, k = 0.0, 2.0**-12, 0
    while at < limit:
        yield k, at, at + width
        at, k = at + width, k + 1
        width = at if at < 1 else 1.0


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int):
    """Darts in the region of each weighted element: (owner, coordinate, rank, id) of those below the element's
    weight and the owner's rank limit.

    Over every element hangs the same random pattern of points, on average one per unit of weight times rank. The
    plane is cut into regions by weight (0 to 1, 1 to 2, 2 to 4, ...) and rank; the number of points of a region and
    their places are hashes of element and region, so equal elements of two sets have equal darts.
    """
    out = []
    if not len(element):
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.uint64)]
    weight_cells = [(0, 0.0, 1.0)]
    while weight_cells[-1][2] < weight.max():
        nu, _, top = weight_cells[-1]
        weight_cells.append((nu + 1, top, 2 * top))
    for nu, w0, w1 in weight_cells:
        tall = np.flatnonzero(weight > w0)
        for cell, r0, r1 in _cells(float(limit[tall].max()) if len(tall) else 0.0):
            at = tall[limit[tall] > r0]
            area = (w1 - w0) * (r1 - r0)
            seed = mix(element[at] + np.uint64((nu * 1_000_003 + cell + 1) * 0x2545F4914F6CDD1D % 2**64))
            cdf = np.cumsum([math.exp(-area + i * math.log(area) - math.lgamma(i + 1)) for i in range(int(area + 12 * math.sqrt(area) + 12))])
            u = _uniform(seed)
            hit = np.flatnonzero(u >= cdf[0])
            n = np.searchsorted(cdf, u[hit], side="right")
            row = np.repeat(hit, n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            a = mix(seed[row] ^ (number.astype(np.uint64) + np.uint64(1)) * _G)
            b = mix(a)
            rank = r0 + (r1 - r0) * _uniform(b)
            height = w0 + (w1 - w0) * _uniform(mix(b))
            row = at[row]
            ok = (rank <= limit[row]) & (height <= weight[row])
            out.append((owner[row[ok]], (a[ok] % np.uint64(k)).astype(np.int64), rank[ok], mix(a[ok] ^ _M1)))
    return [np.concatenate(x) for x in zip(*out)]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n by k signatures (uint32): in each coordinate the id of the owner's earliest dart. Two sets agree in a
    coordinate with the probability of their weighted Jaccard similarity. Owners without elements have zeros."""
    sig = np.zeros((n, k), np.uint32)
    total = np.bincount(owner, weight, n)
    with np.errstate(divide="ignore"):
        limit = k * (math.log(k) + 3) / total
    open_ = total > 0
    while open_.any():
        at = np.flatnonzero(open_[owner])
        o, j, rank, ident = darts(owner[at], element[at], weight[at], limit[owner[at]], k)
        packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (ident & np.uint64(0xFFFFFFFF))
        best = np.full(n * k, np.uint64(2**64 - 1))
        np.minimum.at(best, o * k + j, packed)
        best = best.reshape(n, k)
        full = open_ & (best != np.uint64(2**64 - 1)).all(1)
        sig[full] = (best[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        open_ &= ~full
        limit = limit * 2  # a coordinate without a dart: look further
    return sig


def _elements(batch: pa.RecordBatch, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, s, count = shingles([t.as_py().encode() for t in batch.column("text")])
    return doc, s, count if weighted else np.ones_like(count)


def _sign(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            doc, s, count = _elements(batch, weighted)
            n = batch.num_rows
            size = np.bincount(doc, count, n).astype(np.int64)
            sums = []
            for salt in (0x1234567, 0x89ABCDEF):
                c = np.zeros(n, np.uint64)
                np.add.at(c, doc, mix(s ^ np.uint64(salt)) * count.astype(np.uint64))
                sums.append(c.view(np.int64))
            sig = signatures(doc, s, count.astype(np.float64), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc_id", "n", "c1", "c2", "sig"],
            )

    return run


def _sets(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            doc, s = numbered(*_elements(batch, weighted))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.view(np.int64)))], names=["doc_id", "s"]
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS)
        h = np.tile(mix(np.arange(BANDS, dtype=np.uint64)), (batch.num_rows, 1))
        for r in range(ROWS):
            h = mix(h ^ sig[:, :, r].astype(np.uint64))
        ids, n = (np.repeat(np.asarray(batch.column(c)), BANDS) for c in ("doc_id", "n"))
        band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(band), pa.array(h.reshape(-1).view(np.int64))], names=["doc_id", "n", "band", "bucket"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        same = (x == y).sum(1) if batch.num_rows else np.zeros(0)
        yield batch.select(["a", "b"]).filter(pa.array(same >= AGREEMENT * BANDS * ROWS))


def _in_cells(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of the two sides of each cell (two blocks of a bucket), of different components, whose signatures agree
    enough. A pair comes in the first bucket it shares only."""
    cell, side, part, band = (pdf[c].to_numpy() for c in ("cell", "side", "component", "band"))
    sig = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(len(pdf), BANDS * ROWS)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    for lo, hi in zip(starts, np.append(starts[1:], len(pdf))):
        mid = lo + int(np.searchsorted(side[lo:hi], 1))
        x, y = (lo, mid), (mid, hi)
        if x[0] == x[1]:
            x = y  # a block against itself comes once
        if y[0] == y[1]:
            y = x
        if hi - lo < 2:
            continue
        sx, sy = sig[x[0] : x[1]], sig[y[0] : y[1]]
        apart = part[x[0] : x[1], None] != part[None, y[0] : y[1]]
        if hi - lo <= 48:
            same = (sx[:, None, :] == sy[None, :, :]).sum(2)
        else:
            same = np.zeros(apart.shape, np.int16)
            for k in range(BANDS * ROWS):
                same += sx[:, k, None] == sy[None, :, k]
        i, j = np.nonzero(apart & (same >= AGREEMENT * BANDS * ROWS))
        if x == y:
            i, j = i[i < j], j[i < j]
        once = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            cut = slice(at, at + PAIRS)
            equal = (sx[i[cut]] == sy[j[cut]]).reshape(-1, BANDS, ROWS).all(2)
            once[cut] = equal.argmax(1) == band[lo]
        if once.any():
            yield x[0] + i[once], y[0] + j[once]


def _busy(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of cells that have a partner there."""
    pdf = pdf.sort_values(["cell", "side"], kind="stable", ignore_index=True)
    busy = np.zeros(len(pdf), bool)
    for i, j in _in_cells(pdf):
        busy[i] = busy[j] = True
    return pdf.loc[busy, ["cell", "side", "doc_id"]]


def _spanning(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between rows of a cell that join components which no link before them has joined, each verified on
        whole sets: fewer than the cell has rows."""
        pdf = pdf.sort_values(["cell", "side"], kind="stable", ignore_index=True)
        ids, part, sets = pdf.doc_id.to_numpy(), pdf.component.to_numpy(), [np.sort(x) for x in pdf.s]
        size = np.array([len(x) for x in sets])
        found: list[tuple[int, int]] = []
        for i, j in _in_cells(pdf):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            for a, b in zip(i[fits].tolist(), j[fits].tolist()):
                u, v = root(part[a]), root(part[b])
                if u == v:
                    continue
                x, y = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
                common = int((y.take(np.searchsorted(y, x), mode="clip") == x).sum())
                if common >= threshold * (size[a] + size[b] - common) - 1e-9:
                    parent[max(u, v)] = min(u, v)
                    found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64").drop_duplicates()

    return run


def _sets_of(needed: DataFrame, docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id and elements of the documents of the table ``needed``. It is stored first, so that a small one is
    broadcast below Spark's own limit and texts then are not shuffled."""
    needed = stored(needed.select("doc_id").distinct(), "needed")
    sets = doc_text(docs).join(needed, "doc_id", "left_semi").mapInArrow(_sets(weighted), "doc_id long, s array<long>")
    return stored(sets, "sets")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Those of the pairs (a, b) whose elements have a Jaccard similarity of the threshold or more."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "sa", "sb")
    pairs = stored(pairs.mapInArrow(_alike, "a long, b long"), "alike")
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = _sets_of(ends, docs, weighted)
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return stored(both.where(common >= F.lit(threshold) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"), "links")


def _members(buckets: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """The rows of buckets that hold more than one component of the links, with theirs."""
    parts = stored(components(links), "parts")
    member = buckets.join(parts, buckets.doc_id == parts.node, "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    return stored(member.join(mixed.where("lo < hi").drop("lo", "hi"), "bucket"), "members")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, class_id and kept: classes are the connected components of links between texts whose five-word shingles
    have a Jaccard similarity of ``threshold`` or more, the weighted one of their numbers of occurrences (plain sets
    if not ``weighted``); class_id is the least doc_id, and kept marks that row.

    Texts with equal shingles are one class from the start and only their least id goes on. Candidates come from equal
    bands of DartMinHash signatures. In each bucket all meet its least id, then those of other components a leader
    picked by the bucket's hash. What then is in different components of a bucket is compared block by block by
    signature; rows that have a partner take their elements to the cell, which verifies and returns a spanning forest,
    never all pairs. Every link is verified on whole texts. Texts without words (null, empty, white space) link with
    nothing; an empty table gives none; rows of equal id and text stay that many rows, of equal id and other texts
    are one document whose texts all count; further columns are not read.
    """
    ship(docs.sparkSession)
    signed = stored(doc_text(docs).mapInArrow(_sign(weighted), "doc_id long, n long, c1 long, c2 long, sig binary"), "signed")
    classes = signed.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"))
    ids = stored(signed.select("doc_id", "n", "c1", "c2").join(classes, ["n", "c1", "c2"]).select("doc_id", "rep").distinct(), "reps")
    reps = stored(signed.select("doc_id", "n", "c1", "c2", "sig").join(classes, ["n", "c1", "c2"]).where("doc_id = rep").select("doc_id", "n", "sig").distinct(), "signatures")
    spread = reps.mapInArrow(_bands, "doc_id long, n long, band int, bucket long")
    mask = F.col("doc_id").bitwiseXOR(F.col("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"), F.min(mask).bitwiseXOR(F.col("bucket")).alias("leader"))
    buckets = stored(spread.join(shared.where("size > 1").drop("size"), "bucket"), "buckets")
    pair = lambda c: (F.least("doc_id", c).alias("a"), F.greatest("doc_id", c).alias("b"))
    links = _verified(buckets.where("doc_id <> least").select(*pair("least")).distinct(), reps, docs, threshold, weighted)
    members = _members(buckets, links)
    other = members.where("doc_id = leader").select("bucket", F.col("component").alias("of_leader"))
    stars = members.where("doc_id <> leader and leader <> least").join(other, "bucket").where("component <> of_leader").select(*pair("leader")).distinct()
    links = links.unionByName(_verified(stars, reps, docs, threshold, weighted))
    links = stored(links.unionByName(_rest(_members(buckets, links), reps, docs, threshold, weighted)), "all_links")
    parts = components(links)
    of_rep = ids.join(parts, ids.rep == parts.node, "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    out = docs.select("doc_id").join(of_rep.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("doc_id") == F.coalesce("class_id", "doc_id")).alias("kept"))


def _rest(members: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links that join what is in different components of the same bucket: a spanning forest of them for each cell."""
    members = members.withColumn("blocks", F.ceil(F.greatest(F.col("rows"), F.col("weight") / BLOCK) / BLOCK).cast("int"))
    rest = members.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")).join(reps.select("doc_id", "n", "sig"), ["doc_id", "n"])
    columns = ("band", "doc_id", "component", "sig")
    x = rest.select("bucket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *columns)
    y = rest.where("block > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *columns)
    cells = x.unionByName(y).withColumn("cell", F.xxhash64("bucket", "i", "j")).drop("bucket", "i", "j")
    per_bucket = members.select("bucket", "blocks").distinct()
    calls = max(1, int((per_bucket.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2 * BLOCK).cast("long")).first()[0] or 0) // CALL))
    busy = stored(cells.groupBy(F.pmod("cell", F.lit(calls)).alias("call")).applyInPandas(_busy, "cell long, side int, doc_id long"), "busy")
    cells = cells.join(busy, ["cell", "side", "doc_id"], "left_semi").join(_sets_of(busy, docs, weighted), "doc_id")
    return cells.groupBy(F.pmod("cell", F.lit(calls)).alias("call")).applyInPandas(_spanning(threshold), "a long, b long").distinct()


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
