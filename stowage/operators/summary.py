"""Inspection and validation aggregates, read counters, dictionary samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attr_json, attr_line, block_count, checksum_text, depth, display, format_acl, format_path, format_time, ratio
from .attributes import modes

FILES = ("file", "chunked_file")
LINKS = ("link", "external_link")
#: Bytes of a sample that are used, and how many times the dictionary the samples must hold.
SAMPLE_CAP, SAMPLE_TIMES, DICTIONARY = 4096, 100, 32 * 1024


def archive_summary(records: DataFrame) -> DataFrame:
    kind = F.col("record_type")
    sums = records.groupBy("archive_id").agg(
        F.count_if(kind.isin(*FILES)).alias("files"),
        F.count_if(kind == "directory").alias("directories"),
        F.count_if(kind.isin(*LINKS)).alias("links"),
        F.coalesce(F.sum("decompressed_length"), F.lit(0)).alias("size"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("compressed"),
    )
    return sums.withColumn("ratio", ratio(F.col("compressed"), F.col("size")))


def counts_by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("archive_id", "record_type").agg(F.count("*").alias("entries"))


def listing_with_totals(records: DataFrame) -> DataFrame:
    """One row a file and one, of null path, with the totals of its archive."""
    files = records.where(F.col("record_type").isin(*FILES))
    out = files.rollup("archive_id", "path").agg(F.sum("length").alias("compressed"), F.sum("decompressed_length").alias("size"), F.count("*").alias("files"), F.grouping_id().alias("_g")).where("_g < 3").drop("_g")
    return out.withColumn("ratio", ratio(F.col("compressed"), F.col("size")))


def listing_json(records: DataFrame) -> DataFrame:
    """path and one JSON object an entry, without absent fields."""
    shown = F.replace("path", F.lit("\x1f"), F.lit("/")).alias("path")
    return records.select("path", F.to_json(F.struct(shown, F.col("record_type").alias("type"), "compression", "decompressed_length")).alias("json"))


def validation(checked: DataFrame) -> DataFrame:
    """checked(archive_id, expected, actual): how many were checked, had no checksum, failed."""
    return checked.groupBy("archive_id").agg(
        F.count("*").alias("files_checked"),
        F.count_if(F.col("expected").isNull()).alias("files_without_checksum"),
        F.count_if(F.col("expected").isNotNull() & (F.col("expected") != F.col("actual"))).alias("checksum_failures"),
    )


def add_stats(stats: DataFrame) -> DataFrame:
    """The sum of counters of several runs."""
    return stats.agg(*[F.sum(c).alias(c) for c in stats.columns])


def statfs(archives: DataFrame, block: int = 4096) -> DataFrame:
    """archives(size, file_size): two definitions of the block count."""
    return archives.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_s"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("_f")).select(
        F.expr(f"(_s + {block - 1}) DIV {block}").alias("blocks_of_content"), F.expr(f"_f DIV {block}").alias("blocks_of_archive")
    )


def read_counters(reads: DataFrame) -> DataFrame:
    """reads(path, hit, nanos): counters by path."""
    return reads.groupBy("path").agg(F.count("*").alias("reads"), F.count_if("hit").alias("hits"), F.sum("nanos").alias("nanos"))


def costliest(counters: DataFrame, k: int) -> DataFrame:
    return counters.orderBy(F.desc("nanos"), "path").limit(k)


def path_statistics(entries: DataFrame) -> DataFrame:
    d = depth(F.col("path"))
    return entries.agg(F.count("*").alias("paths"), F.avg(d + 1).alias("avg_depth"), F.max(d + 1).cast("long").alias("max_depth"), F.avg(F.octet_length("path")).alias("avg_length"))


def dictionary_samples(contents: DataFrame) -> DataFrame:
    """contents(archive_id, content): samples used for training, cut and without empty ones."""
    return contents.where(F.octet_length("content") > 0).withColumn("sample", F.substring("content", 1, SAMPLE_CAP))


def dictionary_gate(samples: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """Whether an archive's samples are enough to train on."""
    return samples.groupBy("archive_id").agg(F.count("*").alias("samples"), F.sum(F.octet_length("sample").cast("long")).alias("bytes")).withColumn("enough", F.col("bytes") >= size * SAMPLE_TIMES)


def dictionary_conflicts(jobs: DataFrame) -> DataFrame:
    """Archives whose jobs carry more than one dictionary."""
    return jobs.groupBy("archive_id").agg(F.countDistinct("dictionary").alias("n")).where("n > 1")


def permitted(mode: Column, uid: Column, gid: Column, mask: Column, user: Column, group: Column) -> Column:
    """POSIX access on a read-only mount: writes never; root otherwise always; owner, group, other in turn."""
    shift = F.when(user == uid, 6).when(group == gid, 3).otherwise(0)
    bits = F.when(shift == 6, F.shiftright(mode, 6)).when(shift == 3, F.shiftright(mode, 3)).otherwise(mode).bitwiseAND(7)
    return F.when(mask.bitwiseAND(2) != 0, False).when(user == 0, True).otherwise(bits.bitwiseAND(mask) == mask)


def lru_hits(log: DataFrame, capacity: int) -> DataFrame:
    """log(archive_id, at, block, size): hit or miss of each access to a cache of ``capacity`` bytes an archive.

    Stateful, so each archive's log is replayed in one task; the state is no
    larger than the cache.
    """
    from collections import OrderedDict

    import pandas as pd

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict = OrderedDict()
        used, hits = 0, []
        rows = rows.sort_values("at")
        for block, size in zip(rows["block"], rows["size"], strict=True):
            hits.append(block in cache)
            if block in cache:
                cache.move_to_end(block)
                continue
            cache[block] = size
            used += size
            while used > capacity and len(cache) > 1:
                used -= cache.popitem(last=False)[1]
        return rows.assign(hit=hits)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields) + ", hit boolean"
    return log.groupBy("archive_id").applyInPandas(replay, schema)


_VALUE = ["effective_type", "v_long", "v_decimal", "v_string", "raw", "v_ts"]


def _with_targets(records: DataFrame) -> DataFrame:
    """records with target: the path of a link's record (the least of several), or an external link's text."""
    to = records.where("path IS NOT NULL").groupBy("archive_id", F.col("record_index").alias("link_target_index")).agg(F.min("path").alias("_to"))
    return records.join(to, ["archive_id", "link_target_index"], "left").withColumn("target", F.coalesce("external_target", display(F.col("_to")))).drop("_to")


def _created(records: DataFrame, attrs: DataFrame) -> DataFrame:
    times = attrs.where("key = 'created' AND record_index IS NOT NULL AND v_ts IS NOT NULL").select("archive_id", "record_index", format_time(F.col("v_ts")).alias("created"))
    return records.join(times, ["archive_id", "record_index"], "left")


def entries_json(records: DataFrame, attrs: DataFrame) -> DataFrame:
    """archive_id, path, json of each entry as data: type, sizes, codec, time, whole checksum, target; absent fields are left out."""
    file = F.col("record_type").isin(*FILES)
    rows = _created(_with_targets(records.where("path IS NOT NULL")), attrs)
    fields = F.struct(
        display(F.col("path")).alias("path"),
        F.col("record_type").alias("type"),
        F.when(file, F.col("decompressed_length")).alias("size"),
        F.when(file, F.col("length")).alias("compressed_size"),
        F.when(file, F.col("compression")).alias("compression"),
        "created",
        F.when(file, checksum_text(F.col("attrs")["blake3"], F.col("attrs")["crc32"])).alias("checksum"),
        "target",
    )
    return rows.select("archive_id", "path", F.to_json(fields).alias("json"))


def archives_json(archives: DataFrame, attrs: DataFrame) -> DataFrame:
    """uri, json of each archive: its alignment and own attributes by name, each value with its type."""
    own = attrs.where("record_index IS NULL").select("archive_id", "key", attr_json(*map(F.col, _VALUE)).alias("_v"))
    pairs = own.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("key", "_v"))).alias("_all"))
    inner = F.array_join(F.transform(F.coalesce("_all", F.array().cast("array<struct<key:string,_v:string>>")), lambda x: F.concat(F.to_json(F.struct(x["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["key"].alias("k")))) - 6), F.lit(":"), x["_v"])), ",")
    return archives.join(pairs, "archive_id", "left").select("uri", F.concat(F.lit('{"alignment":'), "alignment", F.lit(',"attributes":{'), inner, F.lit("}}")).alias("json"))


def archives_info(archives: DataFrame, records: DataFrame) -> DataFrame:
    """The inspection of each archive: header fields, counts, sizes and saved share."""
    return archives.select("archive_id", "uri", "version", "alignment", "trailer_size").join(archive_summary(records), "archive_id", "left")


def members_info(records: DataFrame) -> DataFrame:
    """The inspection of each entry: kind, place, sizes, saved share, blocks, target."""
    file, n = F.col("record_type").isin(*FILES), F.col("decompressed_length")
    return _with_targets(records.where("path IS NOT NULL")).select(
        "archive_id", "path", "record_index", "record_type", F.when(file, F.col("compression")).alias("compression"), F.when(file, n).alias("size"), F.when(file, F.col("length")).alias("compressed"),
        F.when(file, ratio(F.col("length"), n)).alias("ratio"), F.when(file, F.col("data_offset")).alias("data_offset"), F.when(F.col("record_type") == "chunked_file", block_count(n, F.col("block_size"))).alias("blocks"), "target",
    )


def attribute_lines(attrs: DataFrame) -> DataFrame:
    """archive_id, record_index (null: the archive's own), key, place (from 1, by name), line."""
    listed = attrs.select("archive_id", "record_index", "key", attr_line(F.col("key"), *map(F.col, _VALUE)).alias("line"))
    # an entry's attributes are few: one row holds them, and no window is needed
    one = listed.groupBy("archive_id", "record_index").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("_all"))
    return one.select("archive_id", "record_index", F.posexplode("_all").alias("place", "_a")).select("archive_id", "record_index", "_a.key", (F.col("place") + 1).alias("place"), "_a.line")


def long_listing(records: DataFrame, attrs: DataFrame) -> DataFrame:
    """archive_id, path, acl, compressed, size, created, shown, target of each entry; the mode is the record's, the archive's, or its kind's."""
    numbers = attrs.where("key = 'unix.mode' AND v_long IS NOT NULL")
    rows = _created(modes(_with_targets(records.where("path IS NOT NULL")), numbers), attrs)
    kind = F.when(F.col("record_type") == "directory", "d").when(F.col("record_type").isin(*LINKS), "l").otherwise("-")
    return rows.select(
        "archive_id", "path", F.concat(kind, format_acl(F.col("`unix.mode`"))).alias("acl"), F.col("length").alias("compressed"), F.col("decompressed_length").alias("size"), F.coalesce("created", F.lit("-")).alias("created"),
        format_path(F.col("path"), F.col("record_type") == "directory").alias("shown"), "target",
    )
