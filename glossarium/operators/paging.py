"""Pages of a long listing by an index of ranks, so that a page reads what it shows and not all before it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def build_pages(rows: DataFrame, order: list[Column | str], path: str, parts: int = 64) -> None:
    """Write rows in an order, cut into ``parts`` ranges of about equal size (by a sample of the order's columns), and a row
    for each range with how many rows stand before it. Orders that leave rows tied are settled by the columns as they
    come, so name a last one that tells rows apart."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    spread = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"_at": place, "_part": F.spark_partition_id()})
    rows.sparkSession.createDataFrame([(spread.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    spread.write.mode("overwrite").option("parquet.block.size", 1 << 22).partitionBy("_part").parquet(f"{path}/rows")
    sizes = _rows(rows.sparkSession, path).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes.select("_part", F.coalesce(before, F.lit(0)).alias("before"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The listing's rows; a listing without any has no files to tell its columns."""
    return spark.read.schema(StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, size: int = 100, number: int = 1) -> DataFrame:
    """Page ``number`` (from 1), with ``rank`` (from 0): the ranges that it touches are named by the index, and of these the
    rows between two places. A page beyond the end is empty."""
    first, end = size * (number - 1), size * number
    index = spark.read.parquet(f"{path}/index").where((F.col("before") < end) & (F.col("before") + F.col("n") > first)).collect()  # a page's ranges
    rows = _rows(spark, path)
    if not index:
        return rows.where("false").withColumn("rank", F.col("_at")).drop("_part", "_at")
    inside = F.lit(False)
    for r in index:
        inside = inside | ((F.col("_part") == r["_part"]) & F.col("_at").between(first - r["before"], end - 1 - r["before"]))
    start = F.create_map(*(F.lit(x) for r in index for x in (r["_part"], r["before"])))
    near = rows.where(F.col("_part").isin([r["_part"] for r in index]) & inside)
    return near.withColumn("rank", F.col("_at") + F.try_element_at(start, F.col("_part"))).orderBy("rank").drop("_part", "_at")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of the listing, by its index."""
    return spark.read.parquet(f"{path}/index").agg(F.sum("n")).first()[0] or 0
