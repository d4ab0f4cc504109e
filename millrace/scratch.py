"""Tables that cut a long lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_KEPT: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("On a cluster spark.checkpoint.dir must name a folder that the driver and all executors share.")
        app = spark.sparkContext.applicationId
        named = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return named.rstrip("/")


#: Rows of a few numbers worth a task of their own.
ROWS_A_TASK = 50_000


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation.

    With `rows`, about how many df has at most, it is written by no more tasks than those rows and the cores are worth.
    """
    spark = df.sparkSession
    if rows is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
        if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    path = f"{folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path  # noqa: SLF001
    return out


#: Rows of a few numbers that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, kept; to be broadcast if it has no more than BROADCAST_ROWS rows, else joined by a shuffle that can split hot keys.

    `rows` is as for `keep`.
    """
    kept = keep(df, rows)
    return F.broadcast(kept) if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else kept


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that none of df's columns has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # noqa: SLF001
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # noqa: SLF001


@atexit.register
def _sweep() -> None:
    for spark, path in _KEPT:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session has ended
            continue


#: Rows and bytes that Spark hands to a Python worker at once; long texts fill a batch by bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def prepare(spark: SparkSession) -> None:
    """Bound the batches sent to Python workers, and let those of a local session import this package."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # gives freed batches back
    env.setdefault("MALLOC_ARENA_MAX", "2")
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *([have] if have else [])])
