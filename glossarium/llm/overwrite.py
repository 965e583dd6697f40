"""A layout of sorted, evenly cut Parquet files by day, and its overwrite where late rows arrive.

The layout lies in the folder that driver and executors share. Spark settles which row of a key stands and deals rows out
by day; one executor task a dirty day lets DuckDB merge, sort and cut that day's files, on disk beyond its memory limit.
"""

from __future__ import annotations

import glob
import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir, ship, table

#: What DuckDB may hold of a day; more is sorted on disk.
MEMORY = "256MB"
#: Parts a day's staged rows are written in, so that a day with a third of all rows is not one task's.
SALT = 4


def shared_path(uri: str) -> str:
    """The path of the shared folder as a file system mounts it: DuckDB reads and writes paths."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a folder that executors have mounted, not {uri}")
    return unquote(parts.path) if parts.scheme else uri


def day_of(at: Column) -> Column:
    """Whole days since 1970 of a timestamp without a zone, -1 for null."""
    return F.coalesce(F.unix_date(at.cast("date")), F.lit(-1)).cast("long")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it while a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def latest(rows: DataFrame, key: str, arrived: str, early: Column) -> DataFrame:
    """For each key the row that arrived last among the early ones (``early``, null if there is none) and among all
    (``final``). Aggregated before the shuffle, so a key with a third of all rows is no task's burden."""
    row = F.struct(*(F.col(f"`{c}`") for c in [arrived, *(c for c in rows.columns if c != arrived)]))
    got = rows.select(F.col(f"`{key}`").alias("key"), row.alias("row"), early.alias("is_early"))
    return got.groupBy("key").agg(F.max(F.when(F.col("is_early"), F.col("row"))).alias("early"), F.max("row").alias("final"))


def _columns(side: str, columns: list[str]) -> list[Column]:
    return [F.col(side).getField(c).alias(c) for c in columns]


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it is read back from a folder of the run's own, which goes when the run is done."""
    df.write.parquet(f"file://{path}")
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{path}")


def _stage(rows: DataFrame, day: str, path: str) -> None:
    """Rows as Parquet in a folder for each day."""
    rows.repartition(F.col(day), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(SALT))).write.partitionBy(day).parquet(path)


def _files(folder: str, day_column: str, day: int) -> list[str]:
    return sorted(glob.glob(f"{glob.escape(folder)}/{glob.escape(day_column)}={day}/*.parquet"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _scan(files: list[str]) -> str:
    return f"read_parquet([{', '.join(chr(39) + f.replace(chr(39), chr(39) * 2) + chr(39) for f in files)}], hive_partitioning = false)"


def merge_day(old: list[str], gone: list[str], incoming: list[str], to: str, stamp: str, columns: list[str], key: str, order: list[str], size: int, work: str) -> list[str]:
    """Files of one day in the folder ``to``: rows of ``old`` files whose key ``gone`` does not hold, and ``incoming`` rows,
    in order, ``size`` to a file. DuckDB sorts in ``work``, which is emptied, within its memory limit."""
    import duckdb

    names = ", ".join(map(_quoted, columns))
    parts = []
    if old:
        keep = f" where not exists (select 1 from {_scan(gone)} g where g.{_quoted(key)} is not distinct from o.{_quoted(key)})" if gone else ""
        parts.append(f"select {names} from {_scan(old)} o{keep}")
    if incoming:
        parts.append(f"select {names} from {_scan(incoming)}")
    if not parts:
        return []
    os.makedirs(work)
    os.makedirs(to, exist_ok=True)
    out, n = [], fresh("row_number", columns)
    try:
        with duckdb.connect(f"{work}/day.db", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": f"{work}/spill"}) as db:
            by = ", ".join(f"{_quoted(c)} asc nulls first" for c in order)
            db.execute(f"create table sorted as select *, row_number() over () - 1 as {_quoted(n)} from (select * from ({' union all '.join(parts)}) order by {by})")
            total = db.execute("select count(*) from sorted").fetchall()[0][0]
            for k in range(-(-total // size)):
                path = f"{to}/part-{k:05d}-{stamp}.parquet"
                one = f"select {names} from sorted where {_quoted(n)} >= {k * size} and {_quoted(n)} < {(k + 1) * size} order by {_quoted(n)}"
                db.execute(f"copy ({one}) to '{path.replace(chr(39), chr(39) * 2)}' (format parquet, compression zstd)")
                out.append(path)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return out


def _rewrite(layout: str, staging: str, day: str, stamp: str, **how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each dirty day's new files, in a folder of this attempt's own: the layout itself is only read."""
        for batch in batches:
            for d in batch.column("day").to_pylist():
                own = f"{staging}/new/{d}-{uuid.uuid4().hex}"
                merge_day(_files(layout, "day", d), _files(f"{staging}/gone", day, d), _files(f"{staging}/in", day, d), own, stamp, work=f"{own}-work", **how)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([own])], names=["day", "folder"])

    return run


def _commit(layout: str, stamp: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Move each day's new files into the layout, then drop the files that are not among them. May be run again at any
        point: what has been moved is left, what is gone is not missed."""
        for batch in batches:
            for d, own in zip(batch.column("day").to_pylist(), batch.column("folder").to_pylist()):
                home = f"{layout}/day={d}"
                for path in sorted(glob.glob(f"{glob.escape(own)}/*.parquet")):
                    os.makedirs(home, exist_ok=True)
                    try:
                        os.replace(path, f"{home}/{os.path.basename(path)}")
                    except FileNotFoundError:  # another attempt has moved it
                        if not os.path.exists(f"{home}/{os.path.basename(path)}"):
                            raise
                for path in glob.glob(f"{glob.escape(home)}/*.parquet"):
                    if not path.endswith(f"-{stamp}.parquet"):
                        try:
                            os.remove(path)
                        except FileNotFoundError:
                            pass
                if os.path.isdir(home) and not os.listdir(home):
                    os.rmdir(home)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64())], names=["day"])

    return run


def rewrite_days(days: DataFrame, layout: str, staging: str, day: str, **how) -> None:
    """Make new files for each day (one column, ``day``), then put them in the place of the old.

    New files are made beside the layout, and only those of the attempt that Spark has committed are moved into it, so
    executors may be lost at any point of either step.
    """
    stamp = uuid.uuid4().hex
    n = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, or few short rows would all become one task's
    made = days.repartition(n, "day").mapInArrow(_rewrite(layout, staging, day, stamp, **how), "day long, folder string")
    made = _kept(made, f"{staging}/days")
    made.repartition(n, "day").mapInArrow(_commit(layout, stamp), "day long").write.format("noop").mode("overwrite").save()


def layout_files(layout: str) -> list[str]:
    """Paths of a layout's data files; there are about as many as days and slices, whatever the rows."""
    return sorted(glob.glob(f"{glob.escape(layout)}/day=*/*.parquet"))


def build_and_overwrite(rows: DataFrame, cutoff: str, size: int, key: str, arrived: str, at: str) -> tuple[str, set[str]]:
    """Write the layout of the rows that arrived before ``cutoff``, then make it that of all rows; returns its folder and
    the files that it had at first.

    A key's row is the one that arrived last; of rows that arrived together the greatest stands, column by column, a null
    being least. Rows without arrival are late but least. Rows without a key are those of one key. Days are those of
    ``at``, -1 if null; a day is sorted by ``at`` and key. An empty table gives a layout without files. Only days that a
    late row enters or leaves are rewritten.
    """
    spark, columns = rows.sparkSession, rows.columns
    ship(spark)
    top, run = shared_path(shared_dir(spark)), uuid.uuid4().hex
    layout, staging = f"{top}/layout-{run}", f"{top}/staging-{run}"
    day = fresh("layout_day", columns)
    is_early = F.coalesce(F.col(f"`{arrived}`") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    kept = _kept(latest(rows, key, arrived, is_early), f"{staging}/latest")
    now = kept.where("early is not null").select(*_columns("early", columns)).withColumn(day, day_of(F.col(f"`{at}`")))
    how = {"columns": columns, "key": key, "order": [at, key], "size": size}

    os.makedirs(layout, exist_ok=True)
    _stage(now, day, f"file://{staging}/first/in")
    rewrite_days(now.select(F.col(day).alias("day")).distinct(), layout, f"{staging}/first", day, **how)
    first = set(layout_files(layout))

    late = kept.where(~F.coalesce(F.col("final").getField(arrived) < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False)))
    into = late.select(*_columns("final", columns)).withColumn(day, day_of(F.col(f"`{at}`")))
    gone = late.where("early is not null").select(F.col("key").alias(key), day_of(F.col("early").getField(at)).alias(day))
    _stage(into, day, f"file://{staging}/late/in")
    _stage(gone, day, f"file://{staging}/late/gone")
    days = into.select(F.col(day).alias("day")).union(gone.select(F.col(day).alias("day"))).distinct()
    rewrite_days(days, layout, f"{staging}/late", day, **how)
    shutil.rmtree(staging)
    release(spark)
    return layout, first


def _described(key: str, at: str, arrived: str, total: str):
    """Rows of a report, a row for each file, from what stands in it; batch by batch."""

    def text(column: pa.ChunkedArray) -> list[str]:
        return ["" if x is None else str(x) for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, n, cents, crc, sha = pq.ParquetFile(row["path"]), 0, 0, 0, hashlib.sha256()
                for part in file.iter_batches(1 << 16):
                    value = np.asarray(part.column(part.schema.get_field_index(total)).cast(pa.float64()).fill_null(0.0))
                    cents += int(np.floor(100 * value + 0.5).astype(np.int64).sum())
                    ids, sold, came = (text(part.column(part.schema.get_field_index(c)).cast(pa.int64())) for c in (key, at, arrived))
                    crc += sum(zlib.crc32(f"{i}:{s}:{a}".encode()) for i, s, a in zip(ids, sold, came))
                    sha.update((("," if n else "") + ",".join(ids)).encode())
                    n += part.num_rows
                yield pa.RecordBatch.from_pylist(
                    [row | {"n_rows": n, "cents": cents, "rows_crc": crc, "columns": ",".join(file.schema_arrow.names), "ids_sha256": sha.hexdigest()}], _REPORT
                )

    return run


_REPORT = pa.schema(
    [("day", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("rewritten", pa.bool_()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("columns", pa.string()), ("ids_sha256", pa.string())]
)


def report(spark, layout: str, first: set[str], key: str, at: str, arrived: str, total: str) -> DataFrame:
    """A row for each file of the layout, computed from the file itself; ``rewritten`` are those that were not there at first."""
    listed, numbers = [], {}
    for path in layout_files(layout):
        day = int(path.split("/")[-2].removeprefix("day="))
        numbers[day] = numbers.get(day, -1) + 1
        listed.append((day, numbers[day], path, path not in first))
    files = spark.createDataFrame(listed, "day long, file_no long, path string, rewritten boolean")
    kinds = "day long, file_no long, path string, rewritten boolean, n_rows long, cents long, rows_crc long, columns string, ids_sha256 string"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(_described(key, at, arrived, total), kinds)


def zoneless(rows: DataFrame, *columns: str) -> DataFrame:
    """Timestamps with a zone as those of UTC without one; others as they are."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.convert_timezone(None, F.lit("UTC"), F.col(c)) for c in columns if kinds[c] == "timestamp"})


def with_copies(sales: DataFrame) -> DataFrame:
    """Sales and the later copies of those whose day 7 divides and whose h (crc32 of the id) 3 divides."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    later = lambda c, days: (F.col(c) + F.make_dt_interval(days.cast("int"))).alias(c)
    moved = {"total": (F.col("total") + 1).alias("total"), "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", h % 97 + 1)}
    copied = sales.where((h % 3 == 0) & (day_of(F.col("sold_at")) % 7 == 0))
    return sales.unionByName(copied.select(*(moved.get(c, F.col(f"`{c}`")) for c in sales.columns)))


def op11_overwrite(spark, sf_dir: str) -> DataFrame:
    sales = zoneless(table(spark, sf_dir, "sales"), "sold_at", "arrived_at")
    layout, first = build_and_overwrite(with_copies(sales), "2024-04-10 00:00:00", 1 + sales.count() // 700, "sale_id", "arrived_at", "sold_at")
    return report(spark, layout, first, "sale_id", "sold_at", "arrived_at", "total").select(
        "day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten"
    )
