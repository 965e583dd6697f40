"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import ship, stored, table

THRESHOLD = 0.98
#: Least sorted passes and hash bits that make a pass's sort key, and neighbours compared with each vector in a pass.
PASSES, BITS, WINDOW = 10, 32, 12
#: Share of links at the threshold that passes are to hold, for labels whose rows need so many bits for each halving.
RECALL, BITS_A_HALVING = 0.999, 2.0
#: Rows in a block when a component's members are compared with each other.
BLOCK = 512
SEED = 20240501


def effort(size: int, threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[int, int]:
    """Passes and bits for a largest label of ``size`` classes.

    Two vectors at the threshold agree in a bit with probability 1 - angle / pi. They are in one window for sure if they agree
    in so many first bits that no more classes than the window have these in common: log2(size / window) bits if bits halve
    the classes evenly, BITS_A_HALVING times as many allowed for as clustered classes are not halved evenly. Passes are
    independent, so the links that all of them lose are at most 1 - RECALL.
    """
    first = BITS_A_HALVING * log2(max(2.0, size / window))
    bits = min(62, max(BITS, ceil(first)))
    held = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** min(first, bits)
    return (PASSES if held >= 1 else max(PASSES, ceil(log(1 - RECALL) / log(1 - held)))), bits


def planes(dim: int, passes: int = PASSES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Random directions, passes by bits by dim: the same for everyone who asks."""
    return np.random.default_rng(seed).standard_normal((passes, bits, dim))


def unit(v: list) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None where it can link with nothing."""
    if v is None or not len(v) or any(c is None for c in v):
        return None
    x = np.asarray(v, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # else squares could overflow
    return x / np.sqrt((x * x).sum())


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, the dimension and the unit vector's bytes, of vectors that can link."""
    for batch in batches:
        ids, labels, out = [], [], []
        for i, v, y in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
            x = unit(v)
            if x is not None and y is not None:
                ids.append(i)
                labels.append(y)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "label", "v"]
        )


def _keyed(passes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per pass: its sort key of concatenated hash bits, most significant first."""
        for batch in batches:
            raw = batch.column("v").to_pylist()
            for dim in sorted({len(b) // 8 for b in raw}):
                at = [k for k, b in enumerate(raw) if len(b) == 8 * dim]
                x = np.frombuffer(b"".join([raw[k] for k in at]), np.float64).reshape(-1, dim)
                h = planes(dim, passes, bits)
                part = batch.take(pa.array(at))
                for p in range(passes):
                    key = ((x @ h[p].T) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), pa.array(key, pa.int64()), pa.array(np.full(len(at), dim, np.int32)), *part.columns],
                        names=["pass", "key", "dim", "vec_id", "label", "v"],
                    )

    return run


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) >= threshold


def _windows(threshold: float, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs within the window of a sorted partition; and its first and last rows, which meet those of other
        partitions afterwards."""
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        tail, head, seen = None, [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            if seen < window:
                head.append(pdf.head(window - seen))
                seen += min(window - seen, len(pdf))
            block = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            fresh = len(block) - len(pdf)
            yield _pairs(block, fresh, threshold, window)
            tail = block.tail(window).reset_index(drop=True)
        if tail is not None:
            for side, rows in (("tail", tail), ("head", pd.concat(head))):
                yield pd.DataFrame(
                    {"a": rows.vec_id, "b": None, "part": part, "side": side, "pass": rows["pass"], "dim": rows.dim, "label": rows.label, "v": rows.v, "pos": np.arange(len(rows))}
                ).astype({"b": "Int64"})

    return run


def _pairs(block: pd.DataFrame, fresh: int, threshold: float, window: int) -> pd.DataFrame:
    """Pairs (a, b) of rows at most ``window`` apart in one pass and label, whose later row is at ``fresh`` or after."""
    found_a, found_b = [], []
    ids = block.vec_id.to_numpy()
    group = block.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
    for dim in sorted(set(block.dim)):
        of = np.flatnonzero(block.dim.to_numpy() == dim)
        x = np.frombuffer(b"".join(block.v.iloc[of]), np.float64).reshape(len(of), dim)
        for gap in range(1, min(window, len(of) - 1) + 1):
            i, j = of[:-gap], of[gap:]
            at = np.flatnonzero((j >= fresh) & (j - i == gap) & (group[i] == group[j]))
            at = at[_near(x[at], x[at + gap], threshold)]
            found_a.append(ids[i[at]])
            found_b.append(ids[j[at]])
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "part": None, "side": None, "pass": None, "dim": None, "label": None, "v": None, "pos": None}).astype(
        {"b": "Int64", "part": "Int32", "pass": "Int32", "dim": "Int32", "pos": "Int32"}
    )


_WINDOW_SCHEMA = "a long, b long, part int, side string, pass int, dim int, label string, v binary, pos int"


def meetings(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """(part, at): of which partitions the last rows meet the first rows of which, from (part, rows or ``window`` if there are
    more): those before it, as many as it takes for ``window`` rows."""
    out, sizes = [], sorted(sizes)
    for k, (at, _) in enumerate(sizes):
        rows = 0
        for part, n in reversed(sizes[max(0, k - window) : k]):
            if rows >= window:
                break
            out.append((part, at))
            rows += n
    return out


def _across(threshold: float, window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first rows of a partition and the ``window`` rows before them, from one or more partitions."""
        pdf = pdf.sort_values(["part", "pos"])
        before, after = pdf[pdf.side == "tail"].tail(window), pdf[pdf.side == "head"]
        if not len(before) or not len(after):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        block = pd.concat([before, after], ignore_index=True).rename(columns={"a": "vec_id"}).drop(columns="b")
        got = _pairs(block, len(before), threshold, window)
        left = set(before.a)
        keep = [(a in left) != (b in left) for a, b in zip(got.a, got.b)]
        return got.loc[keep, ["a", "b"]].astype("int64")

    return run


def _count_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each row of one block to the rows of another of the same component, weighted by copies."""
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []}, dtype="int64")
        x, y = (np.frombuffer(b"".join(s.v), np.float64).reshape(len(s), -1) for s in (left, right))
        score = x @ y.T
        near = score >= threshold
        i, j = np.nonzero(np.abs(score - threshold) < 1e-9)
        near[i, j] = _near(x[i], y[j], threshold)  # the last bits of a matrix product depend on its shape
        near &= left.vec_id.to_numpy()[:, None] != right.vec_id.to_numpy()[None, :]
        return pd.DataFrame({"vec_id": left.vec_id.to_numpy(), "n": near @ right.copies.to_numpy()})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, bits: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label).

    Equal vectors of a label are one class with a count. In every pass classes are ordered by label and by a key of
    concatenated random hashes, and each is compared with its ``window`` neighbours, across partitions too; pairs
    of all passes are united. Then the members of each component are compared with each other in blocks, which
    finds the links within it that no window held; only counts leave a block. Passes and bits follow from the size of
    the largest label unless they are given.

    Null labels and null, empty, zero or non-finite vectors, and vectors of different length, link with nothing; a
    repeated row (same id and vector) is one copy more of its class; a row without vec_id counts as a link of others but has
    no links itself; an empty table gives none; further columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    valid = base.mapInArrow(_prepared, "vec_id long, label string, v binary")
    classes = stored(valid.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    largest = classes.groupBy("label", F.length("v")).count().agg(F.max("count")).first()[0] or 0
    passes, bits = (given or needed for given, needed in zip((passes, bits), effort(largest, threshold, window)))
    keyed = classes.select("vec_id", "label", "v").mapInArrow(_keyed(passes, bits), "pass int, key long, dim int, vec_id long, label string, v binary")
    spread = keyed.repartitionByRange("pass", "label", "dim", "key", "vec_id").sortWithinPartitions("pass", "label", "dim", "key", "vec_id")
    seen = stored(spread.mapInPandas(_windows(threshold, window), _WINDOW_SCHEMA), "windows")
    edges = seen.where("part is not null").select("a", F.lit(None).cast("long").alias("b"), "part", "side", "pass", "dim", "label", "v", "pos")
    sizes = edges.where("side = 'head'").groupBy("part").count().collect()  # a row for each partition
    meet = spark.createDataFrame(meetings([(r["part"], r["count"]) for r in sizes], window), "part int, at int")
    tails = edges.where("side = 'tail'").join(meet, "part")
    crossing = tails.unionByName(edges.where("side = 'head'").withColumn("at", F.col("part"))).groupBy("at").applyInPandas(_across(threshold, window), "a long, b long")
    links = seen.where("part is null").select("a", "b").unionByName(crossing)
    members = stored(components(links), "members")
    inside = classes.join(members, classes.vec_id == members.node).select("component", "vec_id", "copies", "v")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    inside = inside.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = inside.select("component", F.col("block").alias("i"), other.alias("j"), F.lit(0).alias("side"), "vec_id", "copies", "v")
    right = inside.select("component", other.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "vec_id", "copies", "v")
    counted = left.unionByName(right).groupBy("component", "i", "j").applyInPandas(_count_links(threshold), "vec_id long, n long")
    direct = counted.groupBy("vec_id").agg(F.sum("n").alias("n"))
    per_class = classes.join(direct, "vec_id", "left").join(members.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per_class = per_class.select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    linked = valid.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
