"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored

def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links (u, v) of one partition: every node by the least it is linked to there."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for u, v in zip(frame.u.tolist(), frame.v.tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, y) for x in list(parent) if (y := root(x)) != x]
    yield pd.DataFrame(pairs, columns=["u", "v"])


def _least_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_by(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_by(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        joined.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node that some link touches; ``component`` is the least node of
    its connected component.

    Each partition first replaces its links by those of its nodes to the least node they reach there, then rounds of star
    contractions join the partitions, until nothing changes. There is one way for all sizes: a table that fits into one
    partition is settled by the first step, and one round finds that nothing changes.

    Self links and rows with a null end are ignored, repeated links count once, an empty table gives none.
    Each round halves the depth of what is left, so rounds grow with the logarithm of the longest chain.
    The minimum of a node's neighbours is a partially aggregated group-by and the join back to the links is
    one that adaptive execution can split, so a hub with most of the links does not land in one task.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    ship(links.sparkSession)
    kind = e.schema["u"].dataType.simpleString()
    e = stored(e.mapInPandas(_contracted, f"u {kind}, v {kind}"), "links")
    digest = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = digest(e)
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e)).where("u <> v").distinct(), "stars")
        now = digest(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()
