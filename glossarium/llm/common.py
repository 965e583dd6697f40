"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, ship, shared_dir, stored, table  # noqa: F401


def doc_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty), with no other column read."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def crc_fold(column: str, k: int) -> Column:
    """crc32 of the id as text, mod k."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(k))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose ``column`` holds about ``limit`` bytes, so that memory follows
    one run. No row is dropped; a longer value makes a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.binary_length(sizes).fill_null(0)).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
