"""Paths, prefixes, hierarchy and selection.

Tables: entries(archive_id, path, record_index, record_type, ...); a path's
components are joined by U+001F, whose byte order sorts a directory's
descendants right after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SEP, depth, glob_regex, name, parent
from ..plans.stage import filled, numbered, staged


def with_path_parts(entries: DataFrame) -> DataFrame:
    p = F.col("path")
    return entries.withColumns({"depth": depth(p).cast("int"), "parent": parent(p), "name": name(p)})


def ancestors(entries: DataFrame) -> DataFrame:
    """Distinct proper prefixes of all paths, as directory paths."""
    parts = F.split("path", SEP)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), SEP))
    keys = [c for c in ("archive_id",) if c in entries.columns]
    return entries.where(F.contains("path", F.lit(SEP))).select(*keys, F.explode(ups).alias("path")).distinct()


def lookup(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keys(path) with what their paths name; misses are absent."""
    return keys.join(entries, "path")


def prefix_scan(entries: DataFrame, prefix: str) -> DataFrame:
    """All paths below the prefix, which may end inside a component; an empty one means all."""
    return entries.where(F.col("path").startswith(prefix)) if prefix else entries


def prefix_first(entries: DataFrame, prefix: str, n: int) -> DataFrame:
    """The first n paths below the prefix in key order (an early stop)."""
    return prefix_scan(entries, prefix).orderBy("path").limit(n)


def subtree(entries: DataFrame, directory: str) -> DataFrame:
    return entries.where((F.col("path") == directory) | F.col("path").startswith(directory + SEP))


def children(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """directory, path, name of the entries right below each of directories(path)."""
    e = with_path_parts(entries)
    d = directories.select(F.col("path").alias("directory"))
    return e.join(d, e["parent"] == d["directory"])


def root_children(entries: DataFrame) -> DataFrame:
    return entries.where(~F.contains("path", F.lit(SEP)))


def child_by_name(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(parent, name) joined with the entries they name."""
    return wanted.join(with_path_parts(entries), ["parent", "name"])


def tree_arrays(entries: DataFrame) -> DataFrame:
    """parent and the sorted array of its children's names."""
    e = with_path_parts(entries).where("parent IS NOT NULL")
    return e.groupBy("parent").agg(F.array_sort(F.collect_list("name")).alias("children"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, path of nodes(id, parent_id, name) that a root reaches, whatever the depth.

    Each node holds the path from an ancestor that doubles its distance in each
    round, so a tree of depth d takes log2 d rounds, each a staged table.  A
    round that brings no node to a root ends it: what is left hangs on a cycle
    or a missing parent, which ``tree_faults`` reports.
    """
    state, before = nodes.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path")), None
    for _ in range(64):  # a depth of 2 ** 64
        state = staged(state)
        hanging = state.where("up IS NOT NULL").count()
        if hanging in (0, before):
            return state.where("up IS NULL").select("id", "path")
        before = hanging
        o, a = state.where("up IS NOT NULL").alias("o"), state.alias("a")
        further = o.join(a, F.col("o.up") == F.col("a.id")).select("o.id", "a.up", F.concat_ws(SEP, "a.path", "o.path").alias("path"))
        state = state.where("up IS NULL").unionByName(further)
    raise ValueError("the nodes' ids are ambiguous")


def tree_faults(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes that no root reaches (cycles, missing parents) or that occur more than once."""
    twice = nodes.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    lost = nodes.select("id").distinct().join(paths.select("id"), "id", "left_anti").select("id", F.lit("unreachable").alias("fault"))
    return twice.unionByName(lost)


def path_of_record(entries: DataFrame) -> DataFrame:
    """record_index to its path; of several the least."""
    keys = [c for c in ("archive_id",) if c in entries.columns]
    return entries.groupBy(*keys, "record_index").agg(F.min("path").alias("path"))


def alias_faults(entries: DataFrame) -> DataFrame:
    """Record indices that several paths name."""
    return entries.groupBy("record_index").agg(F.count("*").alias("n")).where("n > 1")


def name_faults(entries: DataFrame) -> DataFrame:
    """Entries whose record's name isn't the last component of their path."""
    return entries.where(name(F.col("path")) != F.col("record_name"))


def hidden(path: Column) -> Column:
    """Whether the last component starts with a dot."""
    return name(path).startswith(".")


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether any of the globs matches the whole displayed path."""
    shown = F.replace(path, F.lit(SEP), F.lit("/"))
    out = F.lit(False)
    for g in globs:
        out = out | shown.rlike(glob_regex(g))
    return out


def collect(operands: DataFrame, include_hidden: bool = False, globs: list[str] = (), recursive: bool = True, output: str | None = None) -> DataFrame:
    """The walk filter of a create: operands(position, root, path, is_dir), first of each path wins."""
    keep = ~excluded(F.col("path"), list(globs))
    if not include_hidden:
        keep = keep & ~hidden(F.col("path"))
    if not recursive:
        keep = keep & ~(F.col("is_dir") & (F.col("path") != F.col("root")))
    if output is not None:
        keep = keep & (F.col("path") != output)
    return first_of_each(operands.where(keep), ["path"], ["position"])


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order given, found by partial minima."""
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])
    best = rows.groupBy(*keys).agg(F.min(whole).alias("_b"))
    return best.select(*[F.col(f"_b.{c}").alias(c) for c in rows.columns])


def operand_config(operands: DataFrame) -> DataFrame:
    """operands(position, path, codec): the codec named last before each operand holds for it."""
    held = filled(operands, ["position"], "codec")
    return held.withColumn("codec", F.coalesce("codec", F.lit("zstd"))).where("path IS NOT NULL")


def classify(entries: DataFrame) -> DataFrame:
    return entries.withColumn("kind", F.when(F.col("is_dir"), "directory").when(F.col("is_symlink"), "symlink").otherwise("file"))


def wildcard(column: Column, pattern: str) -> Column:
    """A name against * and ?, without regard to case."""
    return F.lower(column).rlike(glob_regex(pattern.lower().replace("[", "\\[")) if "[" not in pattern else glob_regex(pattern.lower()))


def page(entries: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    """Resume an enumeration after ``offset`` rows."""
    return entries.orderBy(*order).offset(offset).limit(n)


def valid_path(path: Column) -> Column:
    """The rules that need no Unicode tables: relative, no empty, . or .. component, no slashes or control characters."""
    bad = rf"(^|{SEP})(\.{{0,2}})({SEP}|$)|[/\\]|[\x00-\x1e\x7f]"
    return (F.length(path) > 0) & ~path.rlike(bad)


def extraction_gate(archives: DataFrame, allow_escapes: bool = False, allow_external: bool = False) -> DataFrame:
    """Archives that may not be extracted without consent, and why."""
    reason = F.when(F.col("allow_escapes") & F.lit(not allow_escapes), "escapes").when(F.col("allow_external_symlinks") & F.lit(not allow_external), "external_symlinks")
    return archives.withColumn("reason", reason).where("reason IS NOT NULL")


def sorted_by_name(entries: DataFrame) -> DataFrame:
    """All entries with their place, from 1, by name without regard to case; ties by path."""
    keys = [c for c in ("archive_id",) if c in entries.columns]
    return numbered(with_path_parts(entries).withColumn("_lower", F.lower("name")), ["_lower", "path", *keys], "place").drop("_lower")
