"""Shared plumbing: the shared work folder, written intermediates, table access."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may carry to a Python worker; texts can be long, so far fewer than Spark's default.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a temporary folder of this machine is set instead.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='traceloom-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/traceloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation.

    ``hashes``: its values hardly repeat, so that no dictionaries of them are tried.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    (df.write.option("parquet.enable.dictionary", "false") if hashes else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (tables := _scratch.get()) is not None:
        tables.append(out)
    return out


#: Tables written inside of the innermost ``scratch``.
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are ``written`` inside are deleted at the end, except those handed to what this yields."""
    tables: list[DataFrame] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_to)
        return df

    token = _scratch.set(tables)
    try:
        yield keep
    finally:
        _scratch.reset(token)
        for df in tables:
            if df._written_to not in kept:
                _delete(df)
        release(spark)


def _delete(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more, and let go of the shuffles of finished steps."""
    _delete(df)
    release(df.sparkSession)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast only if its rows are counted to be at most ``most``; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def private(df: DataFrame, *labels: str) -> list[str]:
    """Column names like ``labels`` that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for label in labels:
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        out.append(label)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so once the driver has collected its garbage.

    Twice, as Python's references to the steps end only while the first collection goes on.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a Python worker never gets thousands of long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy() -> None:
    """At the end of a task in a Python worker: give memory that the task freed back to the system.

    Workers serve one task after another, and what the allocators keep would count against the executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
