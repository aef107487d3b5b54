"""Several archives as one namespace, and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SEP, parent
from .entries import children, tree_paths


def merged(entries: DataFrame) -> DataFrame:
    """entries(archive_id, path, is_dir, record_index): the one entry each path shows.

    A later archive's file replaces what was there, a directory stays if one is
    there already.  So the winner is the last archive if that has a file, else
    the first directory after the last file.  Both come from one aggregate:
    no window, and a path's rows combine before the shuffle.
    """
    last_file = F.coalesce(F.max(F.when(~F.col("is_dir"), F.col("archive_id"))), F.lit(-1).cast("long"))
    marks = entries.groupBy("path").agg(last_file.alias("_m"), F.max("archive_id").alias("_last"))
    ranked = entries.join(marks, "path").where(
        F.when(F.col("_m") == F.col("_last"), F.col("archive_id") == F.col("_m")).otherwise(F.col("archive_id") > F.col("_m"))
    )
    best = ranked.groupBy("path").agg(F.min(F.struct("archive_id", "is_dir", "record_index")).alias("_b"))
    return best.select("path", "_b.*")


def merged_children(entries: DataFrame, directories: DataFrame) -> DataFrame:
    return children(merged(entries), directories)


def merged_totals(entries: DataFrame) -> DataFrame:
    """Record count and logical size over all archives, shadowed ones too."""
    return entries.agg(F.count("*").alias("records"), F.coalesce(F.sum("decompressed_length"), F.lit(0)).alias("bytes"))


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links(archive_id, path, link_target_index) with target_path, one hop only; null where it dangles."""
    t = targets.select(F.col("archive_id"), F.col("record_index").alias("link_target_index"), F.col("path").alias("target_path"), F.col("record_type").alias("target_type"))
    return links.join(t, ["archive_id", "link_target_index"], "left")


def dangling(links: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select("archive_id", F.col("record_index").alias("link_target_index"))
    return links.join(t, ["archive_id", "link_target_index"], "left_anti")


def relative_target(link: Column, target: Column) -> Column:
    """The target as seen from the link's directory, with / and .. ."""
    here = F.when(parent(link).isNull(), F.array().cast("array<string>")).otherwise(F.split(parent(link), SEP))
    there = F.split(target, SEP)
    same = F.transform(
        F.sequence(F.lit(0), F.least(F.size(here), F.size(there) - 1)),
        lambda k: F.when((k == 0) | (F.slice(here, F.lit(1), k) == F.slice(there, F.lit(1), k)), k).otherwise(F.lit(-1)),
    )
    k = F.array_max(same)
    ups = F.array_repeat(F.lit(".."), F.size(here) - k)
    return F.array_join(F.concat(ups, F.slice(there, k + 1, F.size(there) - k)), "/")


def capture_symlinks(links: DataFrame, archived: DataFrame, allow_external: bool = False) -> DataFrame:
    """links(path, raw_target, target_path): internal where the target is archived, external if allowed, else an error."""
    a = archived.select(F.col("path").alias("target_path"), F.col("record_index").alias("link_target_index"))
    out = links.join(a, "target_path", "left")
    kind = F.when(F.col("link_target_index").isNotNull(), "link").when(F.lit(allow_external), "external_link")
    refuse = F.raise_error(F.concat(F.lit("link leaves the archive: "), F.col("path"))).cast("string")
    return out.withColumn("record_type", F.coalesce(kind, refuse))


def reported_size(record_type: Column, size: Column, target_name: Column, relative: Column, external: Column) -> dict[str, Column]:
    """The size two kinds of mounts report: a link's is the bytes of its target's name, or of the relative path."""
    fuse = F.when(record_type == "directory", F.lit(4096).cast("long")).when(record_type == "link", F.octet_length(target_name).cast("long")).when(record_type == "external_link", F.octet_length(external).cast("long")).otherwise(size)
    kernel = F.when(record_type == "directory", F.lit(4096).cast("long")).when(record_type == "link", F.octet_length(relative).cast("long")).when(record_type == "external_link", F.octet_length(external).cast("long")).otherwise(size)
    return {"size_by_name": fuse, "size_by_path": kernel}


def by_composite(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(composite_key, DECIMAL(38,0) of archive and record) with the entry each names; absent where there is none.

    Record 0 names nothing.
    """
    wide = F.lit(str(1 << 64)).cast("decimal(38,0)")
    archive = F.expr(f"CAST(composite_key DIV CAST('{1 << 64}' AS DECIMAL(38,0)) AS LONG)")
    parts = keys.withColumn("archive_id", archive)
    parts = parts.withColumn("record_index", F.try_subtract(F.col("composite_key"), (F.col("archive_id").cast("decimal(18,0)") * wide).cast("decimal(38,0)")).cast("long"))
    return parts.where("record_index > 0").join(entries, ["archive_id", "record_index"])


def with_pending(indexed: DataFrame, pending: DataFrame) -> DataFrame:
    """path, record_index of indexed(path, record_index) and of pending(record_index, parent_index, name) below them.

    Entries added to an archive that is open hang on the record above them
    until the index is made anew: on an indexed directory, on another pending
    entry, or (null) on the root.  An indexed path wins over a pending one.
    """
    above = pending.join(indexed.select(F.col("record_index").alias("parent_index"), F.col("path").alias("_above")), "parent_index", "left")
    inside = above.select(F.col("record_index").alias("id"), F.when(F.col("_above").isNull(), F.col("parent_index")).alias("parent_id"), F.when(F.col("_above").isNotNull(), F.concat_ws(SEP, "_above", "name")).otherwise(F.col("name")).alias("name"))
    found = tree_paths(inside).select("path", F.col("id").alias("record_index"), F.lit(1).alias("_age"))
    both = indexed.select("path", "record_index", F.lit(0).alias("_age")).unionByName(found)
    return both.groupBy("path").agg(F.min_by("record_index", F.struct("_age", "record_index")).alias("record_index"))


def finder_size(record_type: Column, size: Column, children: Column) -> Column:
    """The size a third kind of mount reports: a directory's is its number of stored children, a link's is 0."""
    return F.when(record_type == "directory", F.coalesce(children, F.lit(0))).when(record_type.isin("link", "external_link"), F.lit(0)).otherwise(size).cast("long")
