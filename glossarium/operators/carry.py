"""The last value before each row of an order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of an order that are settled together.
BLOCK = 4096


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with ``name``: the last ``value`` that is not null at or before the row, by the whole number ``order``, among the
    rows of the same keys.

    A group is cut into blocks of its order. Within a block the last value is a window over at most so many places; what
    comes into a block is the last value of the blocks before it, over one row for each block. So a group of any size is
    spread over tasks. Null keys are a group; of rows at one place the value of any may be taken; rows without an order
    get null.
    """
    ids = [f"_k{i}" for i in range(len(keys))]
    cut = rows.withColumns({"_value": value, "_block": F.floor(F.col(order) / block)} | {i: F.col(k) for i, k in zip(ids, keys)})
    inside = Window.partitionBy(*ids, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = cut.groupBy(*ids, "_block").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(order, "_value"))).getField("_value").alias("_last"))
    blocks = Window.partitionBy(*ids).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    into = per.withColumn("_into", F.last("_last", ignorenulls=True).over(blocks)).where("_into is not null").drop("_last")
    into = into.select(*(F.col(i).alias(f"{i}b") for i in ids), F.col("_block").alias("_at"), "_into")
    same = F.col("_block") == F.col("_at")
    for i in ids:
        same = same & F.col(i).eqNullSafe(F.col(f"{i}b"))
    out = cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(into, same, "left")
    return out.withColumn(name, F.coalesce("_inside", "_into")).drop("_value", "_block", "_inside", "_into", "_at", *ids, *(f"{i}b" for i in ids))
