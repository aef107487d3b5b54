"""Tables in the shared folder that cut lineage, and global order without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a session in local mode sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each name in sums, the sum of its column over all rows up to and with this one.

    Rows are range-partitioned by ``order`` and staged with their partition's
    number; partitions' totals (a row each) give the offsets.  No step orders
    all rows in one task.
    """
    names = list(sums)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(sums[c]).alias(f"_t_{c}") for c in names])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in names])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(sums[c]).over(inside).alias(f"_r_{c}") for c in names])
    out = out.join(F.broadcast(bases), "_part")
    return out.select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).cast("long").alias(c) for c in names])


def numbered(df: DataFrame, order: list[str], name: str = "record_index") -> DataFrame:
    """df with each row's place, from 1, in the order given (which should be total)."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def lagged(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """df with the column's value in the row before, over all rows in order; partitions hand on their last row."""
    ranged = _ranged(df, order)
    key = F.struct(*order)
    tails = ranged.groupBy("_part").agg(F.max_by(F.struct(column), key).alias("_tail"))
    tails = tails.select("_part", F.lag("_tail").over(W.orderBy("_part"))[column].alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order)
    out = ranged.withColumns({"_nth": F.row_number().over(inside), "_lag": F.lag(column).over(inside)}).join(F.broadcast(tails), "_part")
    return out.select(*df.columns, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_lag")).alias(name))


def filled(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """df with the column's nulls replaced by the last value before them, over all rows in order."""
    ranged = _ranged(df, order)
    key = F.struct(*order)
    tails = ranged.where(F.col(column).isNotNull()).groupBy("_part").agg(F.max_by(column, key).alias("_tail"))
    tails = ranged.select("_part").distinct().join(tails, "_part", "left")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select("_part", F.last("_tail", ignorenulls=True).over(before).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumn("_seen", F.last(column, ignorenulls=True).over(inside)).join(F.broadcast(tails), "_part")
    return out.select(*[F.coalesce("_seen", "_before").alias(c) if c == column else F.col(c) for c in df.columns])
