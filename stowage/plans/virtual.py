"""Virtual archives over the test tables, so that operators can be checked in SQL.

corpus: documents as files of an archive (or three, by source); site: pages by
their URL's path; links: labels as links to documents; log: events as reads.
``CTE`` builds the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SEP, codec_for, join_path
from ..operators.entries import ancestors
from .stage import numbered

BLOCK = 1024
ALIGN = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One row a document: archive_id, path, doc_id, sizes, codec, kind."""
    size = F.octet_length("text").cast("long")
    more = ["text"] if text else []
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.lit(0).cast("long").alias("archive_id"),
            join_path("corpus", F.col("lang"), F.col("source"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))).alias("path"),
            "doc_id",
            "source",
            "lang",
            size.alias("decompressed_length"),
            size.alias("length"),
            *more,
        )
        .withColumns(
            {
                "block_size": F.lit(BLOCK).cast("long"),
                "compression": codec_for(F.col("decompressed_length")),
                "record_type": F.when(F.col("decompressed_length") > BLOCK, "chunked_file").otherwise("file"),
            }
        )
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the directories above them."""
    f = files(spark, sf_dir)
    dirs = ancestors(f.select("archive_id", "path")).withColumn("record_type", F.lit("directory"))
    return f.unionByName(dirs, allowMissingColumns=True)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries with record_index, their place in path order."""
    return numbered(entries(spark, sf_dir), ["path"])


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with doc_id as record_index and aligned offsets in doc_id order."""
    from ..operators.layout import offsets

    f = files(spark, sf_dir).withColumn("record_index", F.col("doc_id") + 1)
    return offsets(f, ALIGN, ["record_index"])


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked files whose data offset is a multiple of a large stride (no layout needed)."""
    f = files(spark, sf_dir).where("record_type = 'chunked_file'")
    return f.withColumn("record_index", F.col("doc_id") + 1).withColumn("data_offset", F.lit(32).cast("long") + F.col("doc_id") * 1048576)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as byte requests anywhere in a document, some past its end: archive_id, record_index, request, offset, n."""
    e, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    record = F.pmod(F.col("user_id") * 7919 + F.col("event_id"), docs.agg(F.count("*")).scalar()) + 1
    sizes = docs.select((F.col("doc_id") + 1).alias("record_index"), F.octet_length("text").cast("long").alias("_size"))
    asked = e.select("event_id", "value", record.cast("long").alias("record_index")).join(sizes, "record_index")
    return asked.select(
        F.lit(0).cast("long").alias("archive_id"),
        "record_index",
        F.col("event_id").alias("request"),
        F.pmod(F.floor(F.abs(F.col("value")) * 100).cast("long") * 6151 + F.col("event_id"), F.col("_size") + 100).alias("offset"),
        (F.pmod(F.col("event_id") * 37, F.lit(3000)) + 1).cast("long").alias("n"),
    )


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three archives over one set of paths, some of them directories."""
    d = table(spark, sf_dir, "documents")
    arch = F.pmod(F.expr("CAST(substring(source, 4) AS INT)"), F.lit(3)).cast("long")
    path = join_path("corpus", F.col("lang"), F.concat(F.lit("doc_"), F.pmod(F.col("doc_id"), F.lit(300)), F.lit(".txt")))
    rows = d.select(arch.alias("archive_id"), path.alias("path"), "doc_id", F.octet_length("text").cast("long").alias("decompressed_length"))
    return rows.groupBy("archive_id", "path").agg(F.min("doc_id").alias("record_index"), F.sum("decompressed_length").alias("decompressed_length")).withColumn("is_dir", F.pmod("record_index", F.lit(7)) == 0)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as links; those of toxic 1 point past the last document."""
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id")).scalar()
    rows = table(spark, sf_dir, "labels")
    target = F.col("doc_id") + F.when(F.col("toxic") == 1, top + 1).otherwise(0) + 1
    return rows.select(
        F.lit(0).cast("long").alias("archive_id"),
        join_path("corpus", "links", F.concat(F.lit("q"), F.col("quality")), F.concat(F.lit("link_"), F.col("doc_id"))).alias("path"),
        target.cast("long").alias("link_target_index"),
    )


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the path of their URL."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"),
        F.replace(F.regexp_replace(bare, "/+$", ""), F.lit("/"), F.lit(SEP)).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
    )


CTE = """
WITH files AS (
  SELECT CAST(0 AS BIGINT) AS archive_id,
         concat_ws(chr(31), 'corpus', lang, source, 'doc_' || doc_id || '.txt') AS path, doc_id, source, lang,
         CAST(strlen(text) AS BIGINT) AS decompressed_length, CAST(strlen(text) AS BIGINT) AS length,
         CAST(1024 AS BIGINT) AS block_size,
         CASE WHEN strlen(text) < 96 THEN 'stored' ELSE 'zstd' END AS compression,
         CASE WHEN strlen(text) > 1024 THEN 'chunked_file' ELSE 'file' END AS record_type, text
  FROM documents),
dirs AS (
  SELECT DISTINCT archive_id, array_to_string(string_split(path, chr(31))[1:k], chr(31)) AS path
  FROM files, range(1, 4) AS t(k)),
entries AS (
  SELECT archive_id, path, record_type, decompressed_length, length, compression, doc_id FROM files
  UNION ALL SELECT archive_id, path, 'directory', NULL, NULL, NULL, NULL FROM dirs),
parts AS (
  SELECT *, CAST(len(string_split(path, chr(31))) - 1 AS INT) AS depth,
         CASE WHEN contains(path, chr(31)) THEN array_to_string(string_split(path, chr(31))[:-2], chr(31)) END AS parent,
         string_split(path, chr(31))[-1] AS name
  FROM entries),
chunked AS (
  SELECT archive_id, doc_id + 1 AS record_index, decompressed_length, length, block_size, 32 + doc_id * 1048576 AS data_offset, text
  FROM files WHERE record_type = 'chunked_file'),
blocks AS (
  SELECT archive_id, record_index, block_size, decompressed_length, data_offset, length, unnest(range(0, decompressed_length, 1024)) AS logical_offset FROM chunked),
placed AS (SELECT *, data_offset + logical_offset AS physical_offset FROM blocks),
asked AS (SELECT event_id, value, CAST((user_id * 7919 + event_id) % (SELECT count(*) FROM documents) + 1 AS BIGINT) AS record_index FROM events),
requests AS (
  SELECT CAST(0 AS BIGINT) AS archive_id, record_index, event_id AS request,
         (CAST(floor(abs(value) * 100) AS BIGINT) * 6151 + event_id) % (decompressed_length + 100) AS "offset", CAST(event_id * 37 % 3000 + 1 AS BIGINT) AS n
  FROM asked JOIN files ON record_index = doc_id + 1),
overlay AS (
  SELECT archive_id, path, min(doc_id) AS record_index, CAST(sum(n) AS BIGINT) AS decompressed_length, min(doc_id) % 7 = 0 AS is_dir
  FROM (SELECT CAST(CAST(substr(source, 4) AS INT) % 3 AS BIGINT) AS archive_id, concat_ws(chr(31), 'corpus', lang, 'doc_' || (doc_id % 300) || '.txt') AS path, doc_id, strlen(text) AS n FROM documents)
  GROUP BY archive_id, path),
merged AS (
  SELECT path, archive_id, is_dir, record_index FROM (
    SELECT o.*, coalesce(max(CASE WHEN NOT is_dir THEN archive_id END) OVER (PARTITION BY path), -1) AS m, max(archive_id) OVER (PARTITION BY path) AS last FROM overlay o)
  WHERE CASE WHEN m = last THEN archive_id = m ELSE archive_id > m END
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY archive_id) = 1),
links AS (
  SELECT CAST(0 AS BIGINT) AS archive_id, concat_ws(chr(31), 'corpus', 'links', 'q' || quality, 'link_' || doc_id) AS path,
         doc_id + CASE WHEN toxic = 1 THEN (SELECT max(doc_id) FROM documents) + 1 ELSE 0 END + 1 AS link_target_index
  FROM labels),
site AS (
  SELECT page_id AS position, replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', ''), '/', chr(31)) AS path, CAST(strlen(html) AS BIGINT) AS size
  FROM pages)
"""
