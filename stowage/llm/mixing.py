"""Mixing sources to target weights along a time-varying curriculum.

Only DataFrame functions are used.  Sources, ordered by code point with null
last, weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's words and what is over goes to the others by weight (water
filling: with sources in order of cap over weight, the capped ones come first,
so one running sum gives the level).

Inside a source, documents stand in the order of a seeded hash.  A target of
k whole epochs and a rest takes each document k times and the rest from the
front of that order, the last document in part.  Time runs from 0 to 1; a
source's weight is 1 + b (2t - 1) with b from ``SLOPES``, so its integral is
t + b (t^2 - t), and the words demanded before a document, divided by the
target, are put through that integral's inverse to give the document's
position.  Documents are range-sorted by position.

The order inside a source is summed in two steps: rows are range-partitioned by
source and order, partitions' totals give the offsets, and a running sum inside
a partition does the rest.  The order ends in a row number that breaks ties, so
a source, a null id or copies of one row that hold a third of all rows are cut
into partitions like others.

Edge cases: null or empty texts have size 0, are taken 0 words and have no
position; a null source is a source; a source without words has target 0;
null ids stand together, in order of text hash; repeated rows are rows of their
own, and which of equal ones is taken more is all the same; very long texts are
counted whole; other columns are kept in training order, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, Scratch, fresh, read, row_key

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
#: Early, even and late sources, in turn.
SLOPES = (-0.5, 0.0, 0.5)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, slope from rows of source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int") + 1)
    per = per.select("source", "source_size", turn(WEIGHTS).alias("weight"), turn(SLOPES).alias("slope"))
    cap = (F.col("source_size") * CAP).cast("double")
    by_cap = W.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = (
        per.withColumn("cap", cap)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("pull", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("pull"))
    )
    # the first source whose cap isn't reached fixes the level of all after it
    level = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(everything)["level"]
    return per.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap"))).select("source", "source_size", "target", "slope")


def inverse(slope: Column, y: Column) -> Column:
    """t in 0..1 at which t + slope (t^2 - t) is y."""
    y = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    return F.when(slope == 0, y).otherwise((F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash, positions (one for each time the document is taken)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["h", "doc_id", "text_hash", "tie"]
    sizes = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
        .repartitionByRange(parts, "source", *order)
        .withColumn("part", F.spark_partition_id())
    )
    wanted = scratch.keep(targets(sizes))
    per = sizes.groupBy("source", "part").agg(F.sum("size").alias("words"))
    per = per.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = per.join(wanted, per["source"].eqNullSafe(wanted["source"])).select(per["source"], "part", "base", "source_size", "target", "slope")
    inside = W.partitionBy("source", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = sizes.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"]) & (rows["part"] == plan["part"])).select(
        "doc_id", rows["source"], "size", "text_hash", (F.col("base") + F.col("upto") - F.col("size")).alias("before"), "source_size", "target", "slope"
    )
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(ROUND(target) AS BIGINT) DIV source_size")).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("epochs") * F.col("source_size") - F.col("before")))
    rows = rows.withColumn("epochs", epochs.cast("long")).withColumn("rest", rest)
    times = (F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int")
    at = lambda k: inverse(F.col("slope"), (k * F.col("source_size") + F.col("before")) / F.col("target"))
    positions = F.when((F.col("size") > 0) & (times > 0), F.transform(F.sequence(F.lit(0), times - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "text_hash", positions.alias("positions")
    )


def training_order(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by position.

    A document taken in part counts where half of it or more is taken;
    documents without words stay, once, at the end.
    """
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    mixed = mix(docs, seed, id_col, text_col, source_col)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    mixed = (
        mixed.withColumn("times", times)
        .where("times > 0")
        .select("doc_id", "source", "text_hash", F.explode(F.when(F.col("size") == 0, F.array(F.lit(2.0))).otherwise(F.slice("positions", F.lit(1), F.col("times")))).alias("position"))
    )
    # equal rows stand for each other: one entry holds the positions of all
    key, turn, of, every, at = fresh(docs, "_key", "_turn", "_of", "_all", "_position")
    mixed = mixed.groupBy(row_key("doc_id", "source", F.col("text_hash")).alias(key)).agg(F.array_sort(F.collect_list("position")).alias(every))
    kind = W.partitionBy(key)
    left = docs.select("*", row_key(id_col, source_col, text).alias(key))
    left = left.withColumn(turn, F.row_number().over(kind.orderBy(F.lit(1)))).withColumn(of, F.count(F.lit(1)).over(kind))
    share = F.filter(every, lambda x, i: i % F.col(of) == F.col(turn) - 1)
    out = left.join(mixed, key).select(*docs.columns, F.explode(share).alias(at))
    return out.repartitionByRange(at).sortWithinPartitions(at, id_col).drop(at)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, range-sorted by where the mix first takes it (those not taken last)."""
    first = F.try_element_at("positions", F.lit(1))
    return (
        mix(read(spark, sf_dir, "documents"))
        .select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), F.size("positions").alias("times"))
        .repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    )


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS size,
         md5('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS INT) AS n
  FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][n % 3 + 1]::DOUBLE AS slope,
         source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, cap / weight AS fill,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
wanted AS (
  SELECT source, source_size, slope,
         coalesce(least(cap, weight * (SELECT arg_min(level, fill) FROM levels WHERE fill > level)), cap) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.slope,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS before,
         CASE WHEN w.source_size > 0 THEN CAST(round(w.target) AS BIGINT) // w.source_size ELSE 0 END AS epochs
  FROM sizes s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source),
taken AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS rest FROM placed),
timed AS (
  SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END ELSE 0 END AS times,
         least(greatest(before / target, 0.0), 1.0) AS y
  FROM taken)
SELECT doc_id, size, source_size, target, CAST(epochs * size + rest AS BIGINT) AS taken,
       CASE WHEN times > 0 THEN
         CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END
       END AS position,
       CAST(times AS INT) AS times
FROM timed
"""
