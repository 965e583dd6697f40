"""Removal of repeated byte strings, by suffix arrays over the places where repeats can be.

Every string of LENGTH bytes has one anchor: of the GRAM-byte strings in it the leftmost of least hash. Neighbouring
strings with the same anchor make a context, so the contexts of a text cover it with short overlaps. Equal strings have
equal anchors: contexts whose anchor stands nowhere else hold no repeat; contexts that stand elsewhere as a whole are
repeats throughout; the others meet those of the same anchor, where a suffix array finds which of their strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, ship, slices, stored, table
from .minhash import _BASE, _BYTES, mix

LENGTH = 200
GRAM = 41
#: Strings of LENGTH bytes that can share an anchor.
REACH = LENGTH - GRAM + 1
#: Contexts of an anchor up to which one window counts them, and different ones up to which a suffix array handles them;
#: more are aggregated before the shuffle, and spread by the hashes of their strings.
MOST = 4096
#: Bytes of contexts that share a suffix array, about.
BUCKET = 1 << 19
_PLACE = np.uint64(30)  # bits of a place: texts are below 1 GB
_TOP = np.uint64(2**64 - 1)
_OTHER = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _TABLES:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _TABLES.clear()
        _TABLES[size] = tuple(both)
    up, down = _TABLES[size]
    return up, down


def _sums(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which _hash gives the hash of any stretch."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * _powers(len(raw) + 1)[0][: len(raw)])])


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``, by running minima from both ends of blocks of that width."""
    blocks = np.concatenate([h, np.full(-len(h) % width, _TOP)]).reshape(-1, width)
    up = np.minimum.accumulate(blocks, 1).reshape(-1)
    down = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    n = len(h) - width + 1
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def contexts(data: bytes) -> dict[str, np.ndarray]:
    """First and last start of the strings of each context, its anchor's place and hash, and two hashes of its bytes and
    the anchor's place in it. Ties of the least hash go to the leftmost, so equal strings agree."""
    if len(data) < LENGTH:
        return {}
    raw = np.frombuffer(data, np.uint8)
    sums = _sums(raw, _BYTES)
    at = np.arange(len(raw) - GRAM + 1)
    h = _hash(sums, at, at + GRAM)
    # the upper bits of the hash, then the place: of equal ones the leftmost is the least
    low = _least(h >> _PLACE << _PLACE | at.astype(np.uint64), REACH)
    place = (low & (np.uint64(1) << _PLACE) - np.uint64(1)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    q0, q1 = edge, np.append(edge[1:], len(low)) - 1
    p = place[q0]
    shape = ((p - q0) * 1024 + (q1 - q0)).astype(np.uint64)
    other = _sums(raw, _OTHER)
    end = q1 + LENGTH
    return {"q0": q0, "q1": q1, "p": p, "k": h[p], "c1": mix(_hash(sums, q0, end) + shape), "c2": mix(_hash(other, q0, end) + shape)}


def group_suffixes(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of small nonnegative integers, by grouping (linear in its length but for the
    sorting of moved members).

    First phase: groups of suffixes, at the start by first symbol, are taken in descending order. Each member points to
    the nearest suffix before it that is in a lower group; what is pointed to moves to new groups right above its own,
    ordered by how many members point to it. At the end the suffixes of a group share their longest Lyndon prefix.
    Second phase: in ascending order each suffix lets the one before it, and those that its pointers lead to, take the
    next place of their group.
    """
    n = len(symbols)
    if not n:
        return []
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        buckets.setdefault(c, []).append(i)
    group, size, members, start_of = [0] * n, [0] * n, {}, [0] * n
    at = 0
    for c in sorted(buckets):
        b = buckets[c]
        for i in b:
            group[i] = at
        size[at], members[at] = len(b), b
        start_of[at + len(b) - 1] = at
        at += len(b)
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = start_of[end]
        count = size[g]
        own = members.pop(g)
        if len(own) != count:
            own = [i for i in own if group[i] == g]
        if count == 1:
            j = own[0] - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[own[0]] = j
            if j >= 0 and (h := size[group[j]]) > 1:
                low = group[j]
                top = low + h - 1
                size[low], size[top], group[j] = h - 1, 1, top
                members[top], start_of[top], start_of[top - 1] = [j], top, low
            end = g - 1
            continue
        own.sort()
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, t in times.items():
            by_times.setdefault(t, {}).setdefault(group[j], []).append(j)
        for t in sorted(by_times, reverse=True):
            for low, moved in by_times[t].items():
                k, h = len(moved), size[low]
                if k == h:
                    continue
                top = low + h - k
                size[low], size[top] = h - k, k
                for j in moved:
                    group[j] = top
                members[top], start_of[low + h - 1], start_of[top - 1] = moved, top, low
        end = g - 1
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    i = n - 1
    for r in range(-1, n):
        if r >= 0:
            i = out[r] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = before[i]
    return out


def _anchored_order(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of the texts that begin at the anchors, from the suffix array of all of them one after another.

    A symbol is seven bytes and how many of them the text has, as a rank; 0 stands between texts."""
    n, width = rows.shape
    cells = -(-width // 7)
    wide = np.zeros((n, cells * 7), np.uint8)
    wide[:, :width] = rows
    valid = np.clip(lengths[:, None] - 7 * np.arange(cells)[None, :], 0, 7)
    wide = wide.reshape(n, cells, 7)
    code = np.zeros((n, cells), np.uint64)
    for b in range(7):
        code = code << np.uint64(8) | wide[:, :, b]
    code = code << np.uint64(8) | valid.astype(np.uint64)
    rank = np.unique(code, return_inverse=True)[1].reshape(n, cells) + 1
    used = -(-lengths // 7)
    live = np.arange(cells + 1)[None, :] <= used[:, None]
    table_ = np.zeros((n, cells + 1), np.int64)
    table_[:, :cells] = np.where(np.arange(cells)[None, :] < used[:, None], rank, 0)
    symbols = table_[live]
    begin = np.cumsum(used + 1) - (used + 1)
    owner = np.full(len(symbols), -1)
    owner[begin] = np.arange(n)
    order = owner[np.array(group_suffixes(symbols.tolist()), np.int64)]
    return order[order >= 0]


def repeated_starts(texts: list[bytes], place: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For contexts with their anchors' places and last starts: which of their strings stand in another one too, contexts
    by starts."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(size) - size
    right_n = size - place
    step = np.arange(LENGTH)
    pick = lambda at, ok: np.where(ok, flat[np.clip(at, 0, len(flat) - 1)], 0).astype(np.uint8)
    right = pick((base + place)[:, None] + step, step[None, :] < right_n[:, None])
    left = pick((base + place)[:, None] - 1 - step[:REACH], step[None, :REACH] < place[:, None])
    order = _anchored_order(right, right_n)
    same = right[order[1:]] == right[order[:-1]]
    shared = np.where(same.all(1), LENGTH, same.argmin(1))
    shared = np.minimum(shared, np.minimum(right_n[order[1:]], right_n[order[:-1]]))
    out = np.zeros((n, REACH), bool)
    h = np.zeros(n, np.uint64)
    for k in range(REACH):  # strings with k bytes before the anchor
        if k:
            h = (h + left[:, k - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        rank = np.zeros(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(shared < LENGTH - k)]).astype(np.uint64)
        at = np.flatnonzero((k <= place) & (place - k <= runs))
        if len(at) < 2:
            continue
        key = mix(mix(h[at]) ^ rank[at])
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[many[back] > 1]
        out[hit, place[hit] - k] = True
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, parts = batch.column("doc_id").to_pylist(), []
        for i, t in zip(ids, batch.column("text")):
            c = contexts(t.as_buffer().to_pybytes() if len(t.as_py()) else b"")
            if c:
                parts.append((np.full(len(c["p"]), i), c))
        if parts:
            get = lambda k: np.concatenate([c[k] for _, c in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i for i, _ in parts]), pa.int64())]
                + [pa.array(get(k), pa.int32()) for k in ("q0", "q1", "p")]
                + [pa.array(get(k).view(np.int64)) for k in ("k", "c1", "c2")],
                names=["doc_id", "q0", "q1", "p", "k", "c1", "c2"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""
    for batch in slices(batches):
        out: list[tuple] = []
        for i, t, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            data = t.encode()
            out += [(i, w["q0"], w["q1"] - w["q0"], w["p"] - w["q0"], w["k"], w["n"], w["others"], data[w["q0"] : w["q1"] + LENGTH]) for w in wanted]
        columns = list(zip(*out)) if out else [()] * 8
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "q0", "run", "place", "k", "n", "others", "bytes"])


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    flags = repeated_starts(list(pdf.bytes), pdf.place.to_numpy().astype(np.int64), pdf.run.to_numpy().astype(np.int64))
    flags[pdf.n.to_numpy() > 1] = False  # those repeat throughout, which is known
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    q0 = pdf.q0.to_numpy()[row]
    return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[row], "start": q0 + start, "stop": q0 + stop - 1 + LENGTH})


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of a context."""
    for batch in slices(batches, "bytes", 1 << 18):
        for i, q0, run, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "q0", "run", "n", "bytes"))):
            raw = np.frombuffer(data, np.uint8)
            at = np.arange(run + 1)
            h = [_hash(_sums(raw, v), at, at + LENGTH).view(np.int64) for v in (_BYTES, _OTHER)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(run + 1, i), pa.int64()), pa.array(q0 + at, pa.int32()), pa.array(np.full(run + 1, n), pa.int64()), pa.array(h[0]), pa.array(h[1])],
                names=["doc_id", "start", "n", "h1", "h2"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, merged = t.encode(), []
            for s in sorted(spans or [], key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["stop"])
                else:
                    merged.append([s["start"], s["stop"]])
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for k, v in zip(out, (len(data), len(data) - len(kept), len(merged), kept, [x for m in merged for x in m])):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.int32()))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
        )


def _span(first: str, last: str) -> Column:
    """The bytes of the strings that start from ``first`` to ``last``."""
    return F.struct(F.col(first).alias("start"), (F.col(last) + LENGTH).alias("stop"))


def _with_others(mixed: DataFrame) -> DataFrame:
    """Each context with the number of different ones of its anchor."""
    return mixed.join(mixed.groupBy("k").agg(F.count(F.lit(1)).alias("others")), "k")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): stretches (start, stop) of bytes that are covered by strings of LENGTH bytes that start elsewhere
    too. A document can have several rows and they can overlap. Contexts are counted by anchor in windows; those of an
    anchor that more than MOST have are counted by partial aggregates, a row for each document, and found again by a join
    that adaptive execution can split, with the same result."""
    ship(docs.sparkSession)
    spots = stored(doc_text(docs).mapInArrow(_anchors, "doc_id long, q0 int, q1 int, p int, k long, c1 long, c2 long"), "anchors")
    crowded = stored(spots.groupBy("k").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > MOST), "crowded")
    alike = Window.partitionBy("k", "c1", "c2")
    counted = spots.join(crowded.select("k"), "k", "left_anti").repartition("k")
    counted = counted.withColumn("n", F.count(F.lit(1)).over(alike)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("k")))
    first = F.row_number().over(alike.orderBy("doc_id", "q0")) == 1
    counted = stored(counted.where("all > 1").withColumn("first", first), "repeated_anchors")
    whole = counted.where("n > 1").select("doc_id", F.array(_span("q0", "q1")).alias("spans"))
    mixed = _with_others(counted.where("first and all > n").select("doc_id", "q0", "q1", "p", "k", "n"))
    # anchors of many contexts: a document's like contexts travel as one row, and aggregates take the place of windows
    packed = spots.join(crowded, "k").groupBy("doc_id", "k", "c1", "c2", "all")
    packed = packed.agg(F.collect_list(_span("q0", "q1")).alias("spans"), F.min(F.struct("doc_id", "q0", "q1", "p")).alias("at"))
    packed = stored(packed, "crowded_contexts")
    kinds = packed.groupBy("k", "c1", "c2", "all").agg(F.sum(F.size("spans")).alias("n"), F.min("at").alias("at"))
    kinds = stored(kinds, "crowded_kinds")
    whole = whole.unionByName(packed.join(kinds.where("n > 1").select("k", "c1", "c2"), ["k", "c1", "c2"]).select("doc_id", "spans"))
    mixed = mixed.unionByName(_with_others(kinds.where("all > n").select("at.*", "k", "n")))
    wanted = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("q0", "q1", "p", "k", "n", "others")).alias("wanted"))
    pieces = stored(doc_text(docs).join(wanted, "doc_id").mapInArrow(_cut, "doc_id long, q0 int, run int, place int, k long, n long, others long, bytes binary"), "contexts")
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("k"), F.lit(1 + total // BUCKET)).alias("bucket")
    few = pieces.where(F.col("others") <= MOST).select("doc_id", "q0", "run", "place", "n", "bytes", bucket)
    partly = few.groupBy("bucket").applyInPandas(_compare, "doc_id long, start int, stop int")
    strings = pieces.where(F.col("others") > MOST).mapInArrow(_string_hashes, "doc_id long, start int, n long, h1 long, h2 long")
    many = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    spread = strings.join(many, ["h1", "h2"]).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    stretch = F.array(F.struct("start", "stop")).alias("spans")
    return whole.unionByName(partly.unionByName(spread).select("doc_id", stretch))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and spans (first byte and byte after the last of each
    removed run, one after another) of each whole text.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another;
    overlaps count, nothing is kept of a repeat, and all is judged on the input. Null and empty texts and those shorter
    than LENGTH stay as they are; of rows with one doc_id the spans are shared, so doc_id should be unique; rows without doc_id
    stay as they are, though what stands in them goes elsewhere; an empty table gives none; further columns are not read.
    """
    spans = stored(repeated_spans(docs), "spans")
    per_doc = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return doc_text(docs).join(per_doc, "doc_id", "left").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<int>"
    )


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
