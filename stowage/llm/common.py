"""Shared folder for cut lineage, and a few helpers of the operators here."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..memory import trim
from .packing import give_back

#: White space of the contracts as a regular expression; a word is a run of anything else.
SPACES = r"[ \t\n\x0B\f\r]+"
WORDS = r"[^ \t\n\x0B\f\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session in local mode sets none (tests), a temporary folder is made
    and remembered in that setting; on a cluster that would be a folder of one
    machine, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tidy(spark: SparkSession) -> bool:
    """Gives back what cut plans held on the driver, where its heap has grown over half of its limit; whether it did.

    Their shuffles, broadcasts and generated classes go only with the driver's
    garbage, which Java leaves until the heap is full.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() <= heap.maxMemory():
        return False
    gc.collect()  # plans that Python still names
    spark._jvm.java.lang.System.gc()
    return True


class Scratch:
    """Tables written to the shared folder; each cuts the lineage before it.

    They are Parquet, so a lost executor costs a reread and nothing more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        tidy(self.spark)
        trim(self.spark)
        give_back()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stowage_path = path
        return out

    def free(self, df: DataFrame) -> None:
        """Deletes a table made by ``keep`` that nothing reads any more.

        What isn't freed stays, like Spark's own checkpoints, until the shared
        folder is cleaned: lazy results still read it.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._stowage_path)
        path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, parts: int):
    """crc32 of the id written as text, modulo parts (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether the id falls into the held-out fold; a null id never does."""
    return F.coalesce(fold(column, parts) == part, F.lit(False))


def in_front(h: Column, rows: int, of: Column | int) -> Column:
    """Whether a 64-bit hash lies in the lowest share of all that holds some four times ``rows`` of ``of`` values.

    So that of many tasks' rows only a few go to the one that takes the lowest.
    """
    share = 4.0 * rows / F.greatest(F.lit(of) if isinstance(of, int) else of, F.lit(1))
    return h.cast("double") / 2.0**64 + 0.5 <= share


def bounded(some: DataFrame, group: str, rows: int, most: int) -> list:
    """At most ``rows`` rows and ``most`` bytes of text of each group, in order of id hash, id and text: what fits is taken.

    some has doc_id, text and group, and few rows already; equal texts are taken once.
    """
    size = F.octet_length("text").cast("long")
    kind = W.partitionBy(group).orderBy("h", "doc_id", "text")
    found = (
        some.select(group, "doc_id", "text", F.xxhash64("doc_id").alias("h"))
        .withColumn("copy", F.row_number().over(W.partitionBy(group, F.xxhash64("text"), "text").orderBy("h", "doc_id")))
        .where((F.col("copy") == 1) & (size <= most))
        .withColumn("nth", F.row_number().over(kind))
        .withColumn("upto", F.sum(size).over(kind))
        .where((F.col("nth") <= rows) & (F.col("upto") <= most))
        .select(group, "doc_id", "text")
        .collect()
    )
    return sorted(found, key=lambda r: (r[group], r["doc_id"], r["text"]))


def row_key(id_col: str, source_col: str, text_hash: Column) -> Column:
    """One value that equal rows share and that is never null, so that a window and a join use the same partitioning."""
    return F.struct(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.col(source_col).isNull(), F.coalesce(F.col(source_col), F.lit("")), text_hash)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: SQL: a table (WITH entry) of the remainders that crc32 looks up, and crc32 of the bytes (a list of BIGINT) by it, where the table is joined.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS rest FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, rest[xor(c & 255, b) + 1])), 4294967295)"
