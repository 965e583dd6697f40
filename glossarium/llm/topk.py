"""Exact top-k by integer inner product, term at a time over blocks of the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, table

#: Rows of a block of candidates and of one of queries.
CANDIDATES, QUERIES = 4096, 4096
#: Queries that are scored together, so that their dense scores stay in a core's cache.
TILE = 32
#: Stands for a null id in a block: after every other in ties.
_NULL = np.iinfo(np.int64).max


def quantized(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """id and the integer parts of ``scale`` times each component, in double precision, of vectors that take part. What is
    beyond a long is at its ends."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(vector).isNotNull() & ~bad).select(F.col(id_column).alias("id"), whole.alias("v"))


def _rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every component that is not 0, ordered by term and row."""
    ends = np.asarray(column.offsets).astype(np.int64)
    sizes = np.diff(ends)
    weight = np.asarray(column.values)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weight)) - np.repeat(ends[:-1] - ends[0], sizes)
    at = np.flatnonzero(weight)
    at = at[np.lexsort((row[at], term[at]))]
    return row[at], term[at], weight[at]


def _postings(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each term the rows that have it and their weights; a posting that most rows have is a dense one of all rows."""
    row, term, weight = _rows(column)
    out, n = {}, len(column)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(term)]):
        if 4 * (b - a) >= n:
            full = np.zeros(n, np.int64)
            full[row[a:b]] = weight[a:b]
            out[int(term[a])] = (slice(None), full)
        else:
            out[int(term[a])] = (row[a:b], weight[a:b])
    return out


def block_top(query_ids: np.ndarray, queries: pa.ListArray, ids: np.ndarray, vectors: pa.ListArray, k: int):
    """(query id, candidate id, score) of the ``k`` best candidates of each query in one block, ties to the smaller id.

    A term of the block's postings scatters its weights, times those of the queries that have it, into dense scores.
    Candidates of one id count as the best of them.
    """
    postings = _postings(vectors)
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    names, repeated = ids[order][starts], len(starts) < len(ids)
    found = []
    for top in range(0, len(query_ids), TILE):
        own = query_ids[top : top + TILE]
        row, term, weight = _rows(queries.slice(top, TILE))
        scores = np.zeros((len(own), len(ids)), np.int64)
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        for a, b in zip(at, np.r_[at[1:], len(term)]):
            if (posting := postings.get(int(term[a]))) is not None:
                where, there = posting
                rows = slice(None) if b - a == len(own) else row[a:b]
                if isinstance(where, slice) or isinstance(rows, slice):
                    scores[rows, where] += np.multiply.outer(weight[a:b], there)
                else:
                    scores[np.ix_(rows, where)] += np.multiply.outer(weight[a:b], there)
        scores = np.maximum.reduceat(scores[:, order], starts, axis=1) if repeated else scores[:, order]
        for q, line in zip(own, scores):
            other = names != q
            line, rest = line[other], names[other]
            if not len(line):
                continue
            least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else line.min()
            best = np.flatnonzero(line >= least)
            best = best[np.lexsort((rest[best], -line[best].astype(np.float64)))] if abs(int(least)) < 1 << 52 else np.array(sorted(best, key=lambda j: (-int(line[j]), rest[j])))
            best = best[:k]
            found.append((np.full(len(best), q), rest[best], line[best]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(map(np.concatenate, zip(*found)))


def _scored(k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = np.asarray(group.column("asks"))
        ids = np.asarray(group.column("id").fill_null(_NULL))
        v = group.column("v").combine_chunks()
        v = v if isinstance(v, pa.ListArray) else v.chunk(0)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        got = block_top(ids[q], v.take(pa.array(q)), ids[c], v.take(pa.array(c)), k) if len(q) and len(c) else tuple(np.zeros(0, np.int64) for _ in range(3))
        named = pa.array(got[1], mask=got[1] == _NULL)
        return pa.table({"query_id": pa.array(got[0]), "id": named, "score": pa.array(got[2])})

    return run


def exact_top(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the ``k`` best candidates of every row whose id ``every`` divides.

    Queries and candidates are dealt out by hash in blocks of about a fixed size, equal rows once, and each block of queries
    meets each of candidates in a group of its own. Only the best of a group leave it; the best of these are the result: what
    beats a row in its block beats it among all.

    Null vectors and ones with null or non-finite components take no part; empty ones score 0; of vectors of different
    length the longer counts as far as the shorter goes. Rows of one id are one candidate and one query, with the best
    score that any of them gives, and none of them is a candidate of its own query. A row without id is a candidate, the
    last in ties, and all such rows are one. Scores beyond a long wrap. An empty table gives none; further columns are
    not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(quantized(vectors, id_column, vector, scale).distinct(), "vectors")
    asks = rows.where(F.col("id") % every == 0)
    n_rows, n_asks = rows.count(), asks.count()
    n, m = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_asks // QUERIES))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    left = asks.select(block(m).alias("i"), all_of(n).alias("j"), F.lit(True).alias("asks"), "id", "v")
    right = rows.select(all_of(m).alias("i"), block(n).alias("j"), F.lit(False).alias("asks"), "id", "v")
    part = left.unionByName(right).groupBy("i", "j").applyInArrow(_scored(k), "query_id long, id long, score long")
    best = part.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.w, c.w)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id is distinct from q.vec_id
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from s
) where rank <= 5
"""
