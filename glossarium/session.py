"""Session settings that every entry point shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of the tables that ``stored`` has written, by application.
_STORED: dict[str, list[str]] = {}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glossarium")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="glossarium-"), "glossarium.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, on a local
    master only: on a cluster each executor would write to its own disk."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "glossarium-checkpoints"))
        current = sc.getCheckpointDir()
    return current


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that no one holds any more: it learns of them when the
    driver collects its garbage, which a small driver with much memory does too seldom for the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str = "part", codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there and a lost
    executor costs no recomputation beyond the files' readers."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/glossarium-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(folder)
    release(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this application, and say how many: for when all results that were
    made of them have been written. Frames that still read them fail."""
    folders = _STORED.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
