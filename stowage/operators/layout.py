"""Where payloads lie: aligned offsets, append cursor, index conflicts, writer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import align_up, parent
from ..plans.stage import lagged, running_sums
from .blocks import KEY

HEADER = 32


def offsets(files: DataFrame, alignment: int, order: list[str], start: int = HEADER) -> DataFrame:
    """files(length, …) with data_offset in the order given.

    Every payload starts aligned, so the cursor is a prefix sum of aligned
    lengths; only keys and lengths go through it.
    """
    base = align_up(F.lit(start).cast("long"), alignment)
    sized = files.withColumn("_padded", align_up(F.col("length"), alignment))
    out = running_sums(sized, order, {"_upto": "_padded"})
    return out.withColumn("data_offset", base + F.col("_upto") - F.col("_padded")).drop("_upto", "_padded")


def trailer_offset(files: DataFrame, alignment: int, start: int = HEADER) -> DataFrame:
    """One row: where the trailer starts."""
    total = F.coalesce(F.sum(align_up(F.col("length"), alignment)), F.lit(0))
    return files.agg((align_up(F.lit(start).cast("long"), alignment) + total).alias("trailer_offset"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """blocks(…KEY, logical_offset, compressed, data_offset): running physical offsets inside each file."""
    summed = running_sums(blocks, [*KEY, "logical_offset"], {"_upto": "compressed"}).withColumn("_before", F.col("_upto") - F.col("compressed"))
    first = summed.groupBy(*KEY).agg(F.min("_before").alias("_first"))
    return summed.join(first, KEY).withColumn("physical_offset", F.col("data_offset") + F.col("_before") - F.col("_first")).drop("_upto", "_before", "_first")


def append_cursor(records: DataFrame) -> DataFrame:
    """archive_id and the end of its last payload, the header's end at least."""
    return records.groupBy("archive_id").agg(F.greatest(F.lit(HEADER).cast("long"), F.max(F.col("data_offset") + F.col("length"))).alias("cursor"))


def path_conflicts(paths: DataFrame) -> DataFrame:
    """Paths with several records, and records with several paths."""
    by_path = paths.groupBy("path").agg(F.countDistinct("record_index").alias("n")).where("n > 1").select(F.lit("path").alias("kind"), F.col("path").alias("key"), "n")
    by_record = paths.groupBy("record_index").agg(F.countDistinct("path").alias("n")).where("n > 1").select(F.lit("record").alias("kind"), F.col("record_index").cast("string").alias("key"), "n")
    return by_path.unionByName(by_record)


def block_conflicts(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of one (record, offset) with several places, or outside their file."""
    same = blocks.groupBy(*KEY, "logical_offset").agg(F.countDistinct("physical_offset").alias("n")).where("n > 1").select(*KEY, "logical_offset", F.lit("several places").alias("fault"))
    f = files.select(*KEY, F.col("decompressed_length").alias("_n"), F.col("data_offset").alias("_d"), F.col("length").alias("_l"))
    fault = (
        F.when(F.col("_n").isNull(), "no such chunked file")
        .when(F.col("logical_offset") >= F.col("_n"), "past the logical end")
        .when((F.col("physical_offset") < F.col("_d")) | (F.col("physical_offset") >= F.col("_d") + F.col("_l")), "outside the payload")
    )
    out = blocks.join(f, KEY, "left").withColumn("fault", fault).where("fault IS NOT NULL").select(*KEY, "logical_offset", "fault")
    return same.unionByName(out)


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after a reopen: both sides, new entries winning; check ``path_conflicts`` first."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    best = both.groupBy("path").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("path", "_age")]), "_age").alias("_b"))
    return best.select("path", "_b.*")


def missing_parents(entries: DataFrame) -> DataFrame:
    """Entries whose parent directory isn't there."""
    e = entries.withColumn("_parent", parent(F.col("path"))).where("_parent IS NOT NULL")
    dirs = entries.where(F.col("record_type") == "directory").select(F.col("path").alias("_parent"))
    return e.join(dirs, "_parent", "left_anti").drop("_parent")


def directories_to_make(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """The ancestors that mkdir_all must add; one that is not a directory is an error."""
    from .entries import ancestors

    need = ancestors(paths.select("path"))
    there = existing.select("path", "record_type")
    blocked = F.when(F.col("record_type") != "directory", F.raise_error(F.concat(F.lit("not a directory: "), F.col("path"))))
    return need.join(there, "path", "left").where(F.col("record_type").isNull() | (F.col("record_type") != "directory")).select("path", blocked.cast("string").alias("error")).select("path")


def index_faults(keys: DataFrame, order: str) -> DataFrame:
    """Of keys in insertion order: duplicates and keys out of byte order."""
    fault = F.when(F.col("path") == F.col("_prev"), "duplicate").when(F.col("path") < F.col("_prev"), "out of order")
    return lagged(keys, [order], "path", "_prev").withColumn("fault", fault).where("fault IS NOT NULL").drop("_prev")


def upserted(entries: DataFrame, order: str) -> DataFrame:
    """One entry for each path, the last inserted."""
    rest = [c for c in entries.columns if c not in ("path", order)]
    return entries.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_b")).select("path", "_b.*")
