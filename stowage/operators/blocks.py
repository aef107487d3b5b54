"""Blocks of chunked files: tables, extents, predecessor and range lookups, invariants.

blocks(archive_id, record_index, logical_offset, physical_offset); files(...,
block_size, decompressed_length, data_offset, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..plans.stage import filled, lagged

KEY = ["archive_id", "record_index"]


def block_table(files: DataFrame) -> DataFrame:
    """Blocks of stored chunked files: one row each, physical where the data would lie."""
    n = F.col("decompressed_length")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.col("block_size").cast("long"))).otherwise(F.array().cast("array<long>"))
    out = files.select(*KEY, "block_size", "decompressed_length", "data_offset", F.explode(starts).alias("logical_offset"))
    return out.withColumn("physical_offset", F.col("data_offset") + F.col("logical_offset"))


def _neighbour(blocks: DataFrame, back: bool) -> DataFrame:
    """blocks with struct column ``_near``: the block before (or after) in the same record, null at its ends.

    All blocks are taken in one order, range-partitioned, so the blocks of one
    large file are many tasks.
    """
    sign = 1 if back else -1
    order = {f"_o{k}": F.col(c) * sign for k, c in enumerate([*KEY, "logical_offset"])}
    rows = blocks.withColumns(order).withColumn("_this", F.struct(*KEY, "logical_offset", "physical_offset"))
    out = lagged(rows, list(order), "_this", "_near").drop(*order, "_this")
    same = (F.col("_near.archive_id") == F.col("archive_id")) & (F.col("_near.record_index") == F.col("record_index"))
    return out.withColumn("_near", F.when(same, F.col("_near")))


def extents(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Each block's physical end: where the next begins, or the payload's end."""
    ends = files.select(*KEY, (F.col("data_offset") + F.col("length")).alias("payload_end"))
    out = _neighbour(blocks, back=False).join(ends, KEY)
    return out.withColumn("physical_end", F.coalesce("_near.physical_offset", "payload_end")).drop("_near", "payload_end")


def _carried(blocks: DataFrame, requests: DataFrame, sign: int) -> DataFrame:
    """requests with the block that comes last before them when both are taken in one order, rising or falling.

    The order is range-partitioned and the last block handed on from partition
    to partition; a block of another record is none.  One shuffle, no range
    join, and no task holds a record's blocks because they are one record's.
    """
    rest = [c for c in requests.columns if c not in KEY]
    b = blocks.select(*KEY, F.col("logical_offset").alias("_at"), F.lit(0).alias("_side"), F.struct(*KEY, "logical_offset", "physical_offset").alias("_block"), F.lit(None).alias("_request"))
    r = requests.select(*KEY, F.col("offset").alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_block"), F.struct(*rest).alias("_request"))
    order = {f"_o{k}": F.col(c) * sign for k, c in enumerate([*KEY, "_at", "_side"])}
    found = filled(b.unionByName(r).withColumns(order), list(order), "_block").where("_side = 1")
    same = (F.col("_block.archive_id") == F.col("archive_id")) & (F.col("_block.record_index") == F.col("record_index"))
    return found.where(same).select(*KEY, "_request.*", "_block.logical_offset", "_block.physical_offset")


def predecessor(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(…KEY, offset) with the last block that starts at or before the offset."""
    return _carried(blocks, requests, 1)


def successor(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with the first block that starts after the offset; absent where there is none.

    In falling order a request comes before a block at the same offset, so that
    block isn't after it.
    """
    return _carried(blocks, requests, -1)


def clamp(requests: DataFrame, files: DataFrame, mode: str = "clamp") -> DataFrame:
    """requests(…KEY, offset, n) with start and stop inside the file.

    strict: a request past the end raises; clamp: both ends are cut;
    clamp_end: the end is cut, a start past the end raises.
    """
    size = F.col("decompressed_length")
    out = requests.join(files.select(*KEY, "decompressed_length"), KEY)
    stop = F.col("offset") + F.col("n")
    if mode == "strict":
        bad = (F.col("offset") > size) | (stop > size)
    elif mode == "clamp_end":
        bad = F.col("offset") > size
    elif mode == "clamp":
        bad = F.lit(False)
    else:
        raise ValueError(f"unknown range mode {mode!r}")
    guarded = F.when(bad, F.raise_error(F.lit("range reaches past the end of the file")).cast("long")).otherwise(F.least("offset", size))
    return out.withColumns({"start": guarded, "stop": F.least(stop, size)}).drop("decompressed_length")


def intersecting(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(…KEY, start, stop) with each block that overlaps them, and the part of it that does.

    An equi join on the record and the block's number: blocks of one size are
    regular (see ``sequence_faults``), so a range's block numbers are listed
    instead of compared.
    """
    size = blocks.groupBy(*KEY).agg(F.max("block_size").alias("_size"))
    asked = ranges.where("start < stop").join(size, KEY)
    numbers = F.sequence(F.floor(F.col("start") / F.col("_size")), F.floor((F.col("stop") - 1) / F.col("_size")))
    asked = asked.withColumn("_number", F.explode(numbers)).withColumn("logical_offset", F.col("_number") * F.col("_size")).drop("_size", "_number")
    out = asked.join(blocks.select(*KEY, "logical_offset", "physical_offset", "block_size", "decompressed_length"), [*KEY, "logical_offset"])
    end = F.least(F.col("logical_offset") + F.col("block_size"), F.col("decompressed_length"))
    return out.withColumns({"from_byte": F.greatest(F.col("start"), F.col("logical_offset")) - F.col("logical_offset"), "to_byte": F.least(F.col("stop"), end) - F.col("logical_offset")})


def sequence_faults(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks that break the rules of a sequence, with the rule.

    The first is at logical 0 and at the file's data offset, each is block_size
    after the one before and further on in the archive, the last is at
    floor((n - 1) / size) * size.
    """
    f = files.select(*KEY, F.col("block_size").alias("_bs"), F.col("decompressed_length").alias("_n"), F.col("data_offset").alias("_data"))
    b = _neighbour(blocks.select(*KEY, "logical_offset", "physical_offset"), back=True)
    b = b.withColumns({"_prev": F.col("_near.logical_offset"), "_prev_physical": F.col("_near.physical_offset")}).drop("_near")
    b = _neighbour(b, back=False).withColumn("_next", F.col("_near.logical_offset")).drop("_near")
    last = F.floor((F.col("_n") - 1) / F.col("_bs")) * F.col("_bs")
    fault = (
        F.when(F.col("_bs").isNull(), "no such file")
        .when(F.col("_prev").isNull() & (F.col("logical_offset") != 0), "first block not at 0")
        .when(F.col("_prev").isNull() & (F.col("physical_offset") != F.col("_data")), "first block not at the data offset")
        .when(F.col("logical_offset") - F.col("_prev") != F.col("_bs"), "step is not the block size")
        .when(F.col("physical_offset") <= F.col("_prev_physical"), "physical offset does not rise")
        .when(F.col("_next").isNull() & (F.col("logical_offset") != last), "last block missing")
    )
    return b.join(f, KEY, "left").withColumn("fault", fault).where("fault IS NOT NULL").select(*KEY, "logical_offset", "fault")


def block_by_number(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(…KEY, number): the block at exactly number * block_size."""
    size = blocks.groupBy(*KEY).agg(F.max("block_size").alias("_size"))
    asked = requests.join(size, KEY).withColumn("logical_offset", F.col("number") * F.col("_size")).drop("_size")
    return asked.join(blocks, [*KEY, "logical_offset"])


def range_bytes(parts: DataFrame, contents: DataFrame, by: list[str]) -> DataFrame:
    """The bytes of each range: parts as from ``intersecting``, contents(…KEY, logical_offset, content).

    Blocks are cut before they are gathered, so a request's group holds no
    more than the bytes it asked for.
    """
    cut = parts.join(contents, [*KEY, "logical_offset"]).withColumn("_cut", F.expr("substring(content, CAST(from_byte + 1 AS INT), CAST(to_byte - from_byte AS INT))"))
    return _concatenated(cut.groupBy(*by), "_cut", by)


def reassemble(contents: DataFrame) -> DataFrame:
    """Whole files from their blocks in order."""
    return _concatenated(contents.groupBy(*KEY), "content", KEY)


def _concatenated(groups: GroupedData, column: str, by: list[str]) -> DataFrame:
    """The column's bytes in order of logical_offset, joined once: no prefix is copied again for each block."""
    parts = F.array_sort(F.collect_list(F.struct("logical_offset", F.hex(column).alias("h"))))
    return groups.agg(parts.alias("_all")).select(*by, F.unhex(F.array_join(F.transform("_all", lambda x: x["h"]), "")).alias("content"))
