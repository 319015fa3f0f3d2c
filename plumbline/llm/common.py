"""Helpers shared by the operators: table access, staging and size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the ids of a semi join are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Rows of texts in an Arrow batch.
BATCH_ROWS = 1000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A temporary folder is used only where that is unset and the master is local.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="plumbline-")
    shared_dir.own = where
    return f"file://{where}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in ids.  ids are broadcast only if counted to be few."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def batched(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, with Arrow batches of at most so many rows from now on in its session: texts are long, and each batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *tables: Callable[[], dict]) -> Callable:
    """run, with released() when a task is over; tables give the dictionaries to empty."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            released(*(t() for t in tables))

    return tidied


def released(*tables: dict) -> None:
    """Empties a worker's tables at the end of a task and gives the memory back, since workers live on and serve other operators."""
    for t in tables:
        t.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def prefixed(df: DataFrame, columns: tuple[str, ...] | list[str]) -> list:
    """Columns by exact name, so that dots or other marks in a name do no harm."""
    return [df[f"`{c}`"] for c in columns]
