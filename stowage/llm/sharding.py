"""Contiguous shards of near equal byte size, from prefix sums.

Documents are ordered by the MD5 of their text, then by id, so equal texts are
neighbours.  The order is range-partitioned; each partition's total is summed,
the totals (a row per partition) give each partition's offset, and a running
sum inside a partition gives each document's place among all bytes.  Cutting
the bytes at equal targets gives the shard.

A document whose group of equal texts began less than 1/64 of a shard before
it goes where the group began.  So small groups stay whole, groups of any size
are cut where they must be, and shards differ by at most that and a document.

Edge cases: a null text counts as no bytes; null ids are ordered first;
repeated rows are rows of their own, and which of equal ones stands first is
all the same; a text longer than a shard's target makes its shard longer by
what it goes over; all columns are kept, and the new ones' names lengthened
where the table has them; an empty table gives an empty result; with fewer
bytes than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CRC_TABLE, Scratch, crc_sql, fresh, read

OVERHEAD = 8
SLACK = 64


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard, slot of each row."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_hash"),
    )
    order = ["text_hash", "text_crc32", "size", "doc_id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.keep(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    rows = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy("part", "text_hash").orderBy(*order[1:])
    local = (
        ranged.withColumn("upto", F.sum("size").over(rows))
        .withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy(*order)))
        .withColumn("start", F.col("upto") - F.col("size"))
        .withColumn("group_start", F.first("start").over(group))
    )
    # one row for each partition
    totals = ranged.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("text_hash").alias("head"), F.max("text_hash").alias("tail")
    )
    tails = (
        ranged.join(F.broadcast(totals.select("part", "tail")), "part")
        .groupBy("part")
        .agg(F.sum(F.when(F.col("text_hash") != F.col("tail"), F.col("size")).otherwise(0)).alias("tail_at"))
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    table = (
        totals.join(tails, "part")
        .withColumn("byte_base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .withColumn("row_base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("total", F.sum("bytes").over(W.partitionBy()))
        .withColumn("tail_at", F.col("byte_base") + F.col("tail_at"))
        # where the group that reaches over the partition's edge began
        .withColumn("run", F.min("tail_at").over(W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("prev_tail", F.lag("tail").over(W.orderBy("part")))
        .withColumn("carried", F.when(F.col("prev_tail") == F.col("head"), F.lag("run").over(W.orderBy("part"))))
        .select("part", "byte_base", "row_base", "total", "head", "carried")
    )
    start = F.col("byte_base") + F.col("start")
    begun = F.when((F.col("text_hash") == F.col("head")) & F.col("carried").isNotNull(), F.col("carried")).otherwise(F.col("byte_base") + F.col("group_start"))
    near = (start - begun) * (shards * SLACK) < F.col("total")
    placed = scratch.keep(
        local.join(F.broadcast(table), "part").select(
            "doc_id",
            "size",
            "text_crc32",
            "text_hash",
            (F.col("row_base") + F.col("nth")).alias("rank"),
            F.lit(shards).cast("long").alias("n"),
            F.when(near, begun).otherwise(start).alias("at"),
            "total",
        )
        .withColumn("shard", F.expr("CAST((at * n) DIV total AS INT)"))
        .select("doc_id", "size", "text_crc32", "text_hash", "rank", "shard")
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("base"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "text_hash", "shard", (F.col("rank") - F.col("base")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with shard and slot; equal rows take the places of their kind in turn."""
    key, turn, every, at, shard, slot = fresh(docs, "_key", "_turn", "_all", "_at", "shard", "slot")
    kind = lambda i, h: F.struct(F.col(i).isNull(), F.coalesce(F.col(i).cast("long"), F.lit(0).cast("long")), h).alias(key)
    places = assign(docs, shards, id_col, text_col).groupBy(kind("doc_id", F.col("text_hash"))).agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias(every))
    left = docs.select("*", kind(id_col, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    left = left.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(F.lit(1))))
    found = left.join(places, key).withColumn(at, F.element_at(every, F.col(turn)))
    return found.select(*docs.columns, F.col(at)["shard"].alias(shard), F.col(at)["slot"].alias(slot))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


# crc32 of a whole text by its 256 remainders; equal texts are computed once
ORACLE = f"""
WITH {CRC_TABLE},
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
octets AS (SELECT t, list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT) AS o FROM texts),
sums AS (SELECT t, CAST({crc_sql("o")} AS BIGINT) AS text_crc32 FROM octets, crc),
placed AS (
  SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, md5(t) AS h, text_crc32 FROM documents JOIN sums ON t = coalesce(text, '')),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY h, text_crc32, size, doc_id) - size AS start, sum(size) OVER () AS total, row_number() OVER (ORDER BY h, text_crc32, size, doc_id) AS place FROM placed),
grouped AS (SELECT *, min(start) OVER (PARTITION BY h) AS begun FROM summed),
cut AS (SELECT *, CAST(CASE WHEN (start - begun) * 24 * {SLACK} < total THEN begun ELSE start END * 24 // total AS INT) AS shard FROM grouped)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""
