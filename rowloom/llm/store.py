"""Tables written to the folder that driver and executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one under /tmp only where the session names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that this process wrote and has not deleted.
WRITTEN: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, lineage cut."""
    path = new_path(df.sparkSession, name)
    WRITTEN.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def drop(df: DataFrame | None) -> None:
    """Delete a table that ``keep`` wrote and that no later plan reads."""
    path = getattr(df, "_kept_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every table that was kept inside it: results must be written or collected before."""
    before = set(WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in WRITTEN if p not in before]:
            _delete(spark, path)


def finished(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` plans, kept, without the tables that were kept on the way to it."""
    before = set(WRITTEN)
    out = keep(build(), name)
    for path in [p for p in WRITTEN if p not in before and p != out._kept_path]:
        _delete(spark, path)
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark understands it, as a URI with scheme and authority."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, cut off from any extra or clashing ones of the input."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows and bytes of text that one Arrow batch hands to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which the defaults let grow to 10000 whole texts on either side of the pipe."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))
