"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in ``spark.checkpoint.dir``; under /tmp only where the session names none and all run on
    one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so that every use sees the same rows."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, order: list[Column], name: str = "at") -> DataFrame:
    """``df`` with ``name``, the number of a row from 0 in ``order``: sorted in ranges, never in one task."""
    low, parts = F.lit((1 << 33) - 1), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = written(rows, "numbered")
    part = F.shiftright("__id", 33)
    # one row a partition
    before = F.sum("m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("m")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.withColumn("__part", part).join(F.broadcast(counts), "__part")
    return rows.withColumn(name, F.col("__id").bitwiseAND(low) + F.col("__before")).drop("__part", "__before", "__id")
