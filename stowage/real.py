"""Queries over real archives: written as bytes to the shared folder and read back, with their SQL.

The archives are made once for an application and a set of tables, and removed
when the program ends.
"""

from __future__ import annotations

import atexit
import base64
import contextlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.digest import blake3_many
from .operators import attributes as A
from .operators import entries as E
from .operators import namespace as N
from .operators import summary as M
from .plans import virtual as V
from .plans.stage import shared_dir, staged
from .sources import archive, ranges, sink, wire
from .sources.vint import encode_vi64, encode_vu64

_MADE: dict[tuple, str] = {}


def kept(spark: SparkSession, d: str, kind: str, make: Callable[[str], None]) -> str:
    """The path of an archive (or folder) of this kind over the tables in d, made by ``make`` where it isn't there."""
    archive.register(spark)
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _MADE or not os.path.exists(_MADE[key]):
        path = f"{shared_dir(spark).removeprefix('file://')}/{kind}-{uuid.uuid4().hex}.arc"
        make(path)
        _MADE[key] = path
        atexit.register(_remove, path)
    return _MADE[key]


def _remove(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)
    else:
        with contextlib.suppress(OSError):
            os.remove(path)


def corpus(spark: SparkSession, d: str, codec: str = "zstd", **options) -> str:
    """The documents as an archive; its path."""

    def make(path: str) -> None:
        f = V.files(spark, d, text=True)
        sink.write(f.select("path", F.lit("file").alias("record_type"), F.encode("text", "UTF-8").alias("content"), F.col("doc_id").alias("position"), F.lit(codec).alias("codec")), path, **options)

    return kept(spark, d, "-".join(["corpus", codec, *(f"{k}.{v}" for k, v in options.items())]), make)


#: A raw dictionary; stored payloads don't use it.
DICTIONARY = b"corpus of documents in four languages; " * 8


def described(spark: SparkSession, d: str) -> str:
    """Documents with attributes, links to them and out of the archive, attributes of the archive itself."""

    def make(path: str) -> None:
        i, text = F.col("doc_id"), F.encode("text", "UTF-8")
        pair = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("k"), value.alias("v")))
        attrs = F.array_compact(
            F.array(
                pair("created", S.vi64_encode(i * 61 - 5000), i % 4 != 1),
                pair("created.seconds", F.unhex(F.lpad(F.hex(i % 60), 2, "0")), i % 4 == 0),
                pair("unix.mode", S.vu64_encode(F.lit(0o100600) + i % 64), i % 3 == 0),
                pair("blake3", F.unhex(F.sha2("text", 256)), i % 2 == 0),
                pair("crc32", F.unhex(F.substring(F.md5(text), 1, 8)), i % 2 == 1),
                pair("linux.xattr.user.lang", F.encode("lang", "UTF-8"), i % 5 == 0),
                pair("empty", F.lit(b""), i % 7 == 0),
            )
        )
        files = V.files(spark, d, text=True).select("path", F.lit("file").alias("record_type"), text.alias("content"), i.alias("position"), F.map_from_entries(attrs).alias("attrs"))
        links = V.table(spark, d, "labels").join(V.files(spark, d).select("doc_id", F.col("path").alias("to")), "doc_id").select(
            V.join_path("corpus", "links", F.concat(F.lit("q"), F.col("quality")), F.concat(F.lit("link_"), i)).alias("path"),
            F.when(F.col("toxic") == 1, "external_link").otherwise("link").alias("record_type"),
            F.when(F.col("toxic") == 0, F.col("to")).alias("target"),
            F.when(F.col("toxic") == 1, F.concat(F.lit("/srv/doc_"), i)).alias("external_target"),
        )
        own = {"created": ("datetime", encode_vi64(0)), "modified": ("datetime", encode_vi64(90)), "unix.mode": ("vu32", encode_vu64(0o100640)), "note": ("string", 'a "fixture"'.encode()), "spec": ("json", b'{"n":1}'), "total": ("vu64", encode_vu64(2**63 + 5))}
        sink.write(
            files.unionByName(links, allowMissingColumns=True), path, codec="stored", alignment=64, checksum=False, chunked=True, walked=True, block_size=1024, archive_attrs=own, dictionary=base64.b64encode(DICTIONARY).decode()
        )

    return kept(spark, d, "described", make)


def loaded(spark: SparkSession, path: str, table: str) -> DataFrame:
    return archive.load(spark, path, table)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = described(spark, d)
    return archive.scan(spark, path, "records"), archive.scan(spark, path, "attrs")


#: The described archive's entries in SQL: documents, links, and the directories above them.
CTE = """, dlinks AS (
  SELECT concat_ws(chr(31), 'corpus', 'links', 'q' || quality, 'link_' || l.doc_id) AS path, CASE WHEN toxic = 1 THEN 'external_link' ELSE 'link' END AS record_type,
         CASE WHEN toxic = 1 THEN '/srv/doc_' || l.doc_id ELSE replace(f.path, chr(31), '/') END AS target FROM labels l JOIN files f ON l.doc_id = f.doc_id),
dpaths AS (SELECT path FROM files UNION ALL SELECT path FROM dlinks),
ddirs AS (SELECT DISTINCT array_to_string(string_split(path, chr(31))[1:k], chr(31)) AS path FROM dpaths, range(1, 4) AS t(k)),
dentries AS (
  SELECT path, record_type, decompressed_length AS size, doc_id, text, NULL AS target FROM files
  UNION ALL SELECT path, record_type, NULL, NULL, NULL, target FROM dlinks UNION ALL SELECT path, 'directory', NULL, NULL, NULL, NULL FROM ddirs),
dtimes AS (SELECT *, CASE WHEN doc_id % 4 <> 1 THEN strftime(to_timestamp(1767225600 + (doc_id * 61 - 5000) * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS created FROM dentries) """
_CRC = "'crc32:' || substr(md5(text), 7, 2) || substr(md5(text), 5, 2) || substr(md5(text), 3, 2) || substr(md5(text), 1, 2)"


def register(query: Callable) -> None:
    """Registers all queries here; query is ``catalog.query``."""

    @query("SELECT path, CASE WHEN record_type = 'directory' THEN 'directory' ELSE 'file' END AS record_type, compression, decompressed_length FROM entries")
    def real_archive_records(spark, d):
        """Written as bytes, read back by the data source."""
        return loaded(spark, corpus(spark, d), "records").select("path", "record_type", "compression", "decompressed_length")

    @query("SELECT path, CAST(32 + sum(length + (8 - length % 8) % 8) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (length + (8 - length % 8) % 8) AS BIGINT) AS data_offset FROM files")
    def real_archive_layout(spark, d):
        path = corpus(spark, d, "stored", alignment=8, checksum="false")
        return loaded(spark, path, "records").where("record_type = 'file'").select("path", "data_offset")

    @query("SELECT path, sha256(text) AS digest FROM files")
    def real_archive_contents(spark, d):
        path = corpus(spark, d, "xz")
        found = loaded(spark, path, "contents").join(loaded(spark, path, "paths"), ["archive_id", "record_index"])
        return found.select("path", F.sha2("content", 256).alias("digest"))

    @query("SELECT CAST(0 AS BIGINT) AS archive_id, count(*) AS files_checked, CAST(0 AS BIGINT) AS files_without_checksum, CAST(0 AS BIGINT) AS checksum_failures FROM files")
    def real_archive_validation(spark, d):
        return sink.validate(spark, corpus(spark, d))

    @query("""SELECT CAST(0 AS BIGINT) AS archive_id, count(*) AS files_checked, count(*) FILTER (doc_id % 5 = 2) AS files_without_checksum, count(*) FILTER (doc_id % 5 = 4) AS checksum_failures FROM files""")
    def real_archive_damage(spark, d):
        """Some files without a checksum, some with that of another text."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                contents, more = b.column("content").to_pylist(), b.column("more").to_pylist()
                digests = iter(blake3_many([c + m for c, m in zip(contents, more, strict=True) if m is not None]))
                attrs = [None if m is None else [("blake3", next(digests))] for m in more]
                yield pa.RecordBatch.from_arrays([b.column("path"), b.column("content"), pa.array(attrs, pa.map_(pa.string(), pa.binary()))], names=["path", "content", "attrs"])

        def make(path):
            i = F.col("doc_id")
            # more: what is hashed after the text; null: nothing is
            more = F.when(i % 5 != 2, F.when(i % 5 == 4, F.lit(b"?")).otherwise(F.lit(b"")))
            sink.write(V.files(spark, d, text=True).select("path", F.encode("text", "UTF-8").alias("content"), more.alias("more")), path, through=hashed, checksum=False)

        return sink.validate(spark, kept(spark, d, "damaged", make))

    @query("SELECT path, parent, name, depth FROM parts WHERE starts_with(path, 'corpus' || chr(31) || 'en' || chr(31) || 'src1')")
    def real_archive_prefix(spark, d):
        p = loaded(spark, corpus(spark, d), "paths").where(F.col("path").startswith(S.SEP.join(("corpus", "en", "src1"))))
        return p.select("path", "parent", "name", "depth")

    @query("SELECT doc_id + 1 AS record, CAST(1 + (decompressed_length - 1) // 512 AS BIGINT) AS blocks, CAST((decompressed_length - 1) // 512 * 512 AS BIGINT) AS last FROM files WHERE decompressed_length > 0")
    def real_archive_blocks(spark, d):
        path = corpus(spark, d, chunked="true", block_size=512)
        f = V.files(spark, d).select("path", "doc_id")
        b = loaded(spark, path, "blocks").join(loaded(spark, path, "paths").select("record_index", "path"), "record_index").join(f, "path")
        return b.groupBy((F.col("doc_id") + 1).alias("record")).agg(F.count("*").alias("blocks"), F.max("logical_offset").alias("last"))

    @query("""SELECT q.request, substr(hex(encode(f.text)), 2 * q."offset" + 1, 2 * greatest(0, least(q.n, f.decompressed_length - q."offset"))) AS bytes FROM requests q JOIN files f ON q.record_index = f.doc_id + 1""")
    def real_archive_ranges(spark, d):
        path = corpus(spark, d, chunked="true", block_size=512)
        out = ranges.read_ranges(_asked(spark, d, path))
        return out.select("request", F.hex("content").alias("bytes"))

    @query("""SELECT q.request, substr(hex(encode(f.text)), 2 * q."offset" + 1, 2 * q.n) AS bytes FROM requests q JOIN files f ON q.record_index = f.doc_id + 1 WHERE q."offset" + q.n <= f.decompressed_length""")
    def strict_ranges(spark, d):
        """Ranges that lie inside their files, read in the mode that refuses any other."""
        path = corpus(spark, d, chunked="true", block_size=512)
        size = V.files(spark, d).select((F.col("doc_id") + 1).alias("_r"), "decompressed_length")
        asked = V.requests(spark, d).join(size, F.col("record_index") == F.col("_r")).where("offset + n <= decompressed_length").select("request")
        out = ranges.read_ranges(_asked(spark, d, path).join(asked, "request"), mode="strict")
        return out.select("request", F.hex("content").alias("bytes"))

    @query("""SELECT doc_id, CAST(decompressed_length AS BIGINT) AS size, substr(hex(encode(text)), greatest(1, 2 * (decompressed_length - 7) + 1)) AS tail, substr(hex(encode(text)), 2 * (decompressed_length // 2) + 1, 20) AS middle FROM files""")
    def seek_reads(spark, d):
        """A seekable reader over each file: from the end, then back to the middle."""
        path = corpus(spark, d, chunked="true", block_size=512)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    with ranges.SeekReader(path, k) as f:
                        size = f.seek(0, 2)
                        f.seek(-min(7, size), 2)
                        tail = f.read()
                        f.seek(size // 2)
                        rows.append({"doc_id": i, "size": size, "tail": tail.hex().upper(), "middle": f.read(10).hex().upper()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("tail", pa.string()), ("middle", pa.string())]))

        found = V.files(spark, d).select("path", "doc_id").join(loaded(spark, path, "paths").select("path", "record_index"), "path")
        return found.select("doc_id", "record_index").mapInArrow(run, "doc_id long, size long, tail string, middle string")

    @query(CTE + f"""SELECT path, '{{"path":"' || replace(path, chr(31), '/') || '","type":"' || record_type || '"' || CASE WHEN doc_id IS NOT NULL THEN ',"size":' || size || ',"compressed_size":' || size || ',"compression":"stored"' ELSE '' END
      || CASE WHEN created IS NOT NULL THEN ',"created":"' || created || '"' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ',"checksum":"blake3:' || sha256(text) || '"' WHEN doc_id % 2 = 1 THEN ',"checksum":"' || {_CRC} || '"' ELSE '' END
      || CASE WHEN target IS NOT NULL THEN ',"target":"' || target || '"' ELSE '' END || '}}' AS json FROM dtimes""")
    def entries_as_json(spark, d):
        return M.entries_json(*_tables(spark, d)).select("path", "json")

    @query("""SELECT '{"alignment":64,"attributes":{"created":"2026-01-01T00:00:00Z","modified":"2026-01-01T01:30:00Z","note":"a \\"fixture\\"","spec":{"n":1},"total":9223372036854775813,"unix.mode":33184}}' AS json""")
    def archive_as_json(spark, d):
        path = described(spark, d)
        return M.archives_json(archive.scan(spark, path, "archives"), archive.scan(spark, path, "attrs")).select("json")

    @query(CTE + f"""SELECT *, {"CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - compressed::DOUBLE * 100.0::DOUBLE / size::DOUBLE END AS ratio"} FROM (SELECT 1 AS version, CAST(64 AS BIGINT) AS alignment, count(*) FILTER (doc_id IS NOT NULL) AS files,
      count(*) FILTER (record_type = 'directory') AS directories, count(*) FILTER (record_type IN ('link', 'external_link')) AS links, CAST(sum(size) AS BIGINT) AS size, CAST(sum(size) AS BIGINT) AS compressed FROM dentries)""")
    def archive_inspection(spark, d):
        path = described(spark, d)
        return M.archives_info(archive.scan(spark, path, "archives"), archive.scan(spark, path, "records")).drop("archive_id", "uri", "trailer_size")

    @query(CTE + """SELECT path, record_type, CASE WHEN doc_id IS NOT NULL THEN 'stored' END AS compression, size, size AS compressed, CASE WHEN doc_id IS NOT NULL THEN 0.0::DOUBLE END AS ratio,
      CASE WHEN record_type = 'chunked_file' THEN CAST(1 + (size - 1) // 1024 AS BIGINT) END AS blocks, target FROM dentries""")
    def member_inspection(spark, d):
        return M.members_info(_tables(spark, d)[0]).drop("archive_id", "record_index", "data_offset")

    @query(CTE + """, dattrs AS (
      SELECT path, 'created' AS key, 'created[datetime]: ' || created AS line FROM dtimes WHERE created IS NOT NULL
      UNION ALL SELECT path, 'created.seconds', 'created.seconds[u8]: ' || doc_id % 60 FROM dtimes WHERE doc_id % 4 = 0
      UNION ALL SELECT path, 'unix.mode', 'unix.mode[vu32 oct]: ' || printf('%o', 33152 + doc_id % 64) FROM dtimes WHERE doc_id % 3 = 0
      UNION ALL SELECT path, 'blake3', 'blake3[u256]: ' || sha256(text) FROM dtimes WHERE doc_id % 2 = 0
      UNION ALL SELECT path, 'crc32', 'crc32[4 bytes]: ' || substr(md5(text), 1, 2) || ' ' || substr(md5(text), 3, 2) || ' ' || substr(md5(text), 5, 2) || ' ' || substr(md5(text), 7, 2) FROM dtimes WHERE doc_id % 2 = 1
      UNION ALL SELECT path, 'linux.xattr.user.lang', 'linux.xattr.user.lang[2 bytes]: ' || lower(substr(hex(encode(string_split(path, chr(31))[2])), 1, 2)) || ' ' || lower(substr(hex(encode(string_split(path, chr(31))[2])), 3, 2)) FROM dtimes WHERE doc_id % 5 = 0
      UNION ALL SELECT path, 'empty', 'empty[bytes]: (empty)' FROM dtimes WHERE doc_id % 7 = 0)
    SELECT path, key, CAST(row_number() OVER (PARTITION BY path ORDER BY key) AS INT) AS place, line FROM dattrs""")
    def member_attributes(spark, d):
        records, attrs = _tables(spark, d)
        lines = M.attribute_lines(attrs.where("record_index IS NOT NULL"))
        return lines.join(records.select("archive_id", "record_index", "path"), ["archive_id", "record_index"]).select("path", "key", "place", "line")

    @query("""SELECT * FROM (VALUES ('created', 1, 'created[datetime]: 2026-01-01T00:00:00Z'), ('modified', 2, 'modified[datetime]: 2026-01-01T01:30:00Z'), ('note', 3, 'note[str]: a "fixture"'), ('spec', 4, 'spec[json]: {"n":1}'),
      ('total', 5, 'total[vu64]: 9223372036854775813'), ('unix.mode', 6, 'unix.mode[vu32 oct]: 100640')) t(key, place, line)""")
    def archive_attributes(spark, d):
        return M.attribute_lines(_tables(spark, d)[1].where("record_index IS NULL")).select("key", "place", "line")

    @query("""SELECT * FROM (VALUES ('created', 'datetime'), ('modified', 'datetime'), ('note', 'string'), ('spec', 'json'), ('total', 'vu64'), ('unix.mode', 'vu32'), ('created.seconds', 'u8'), ('blake3', 'u256'), ('crc32', 'bytes'),
      ('linux.xattr.user.lang', 'bytes'), ('empty', 'bytes')) t(name, attr_type)""")
    def attribute_key_catalog(spark, d):
        return archive.scan(spark, described(spark, d), "attr_keys").select("name", "attr_type")

    @query(CTE + f"""SELECT 1 AS version, true AS allow_external_symlinks, false AS allow_escapes, CAST(64 AS BIGINT) AS alignment, '{DICTIONARY.hex().upper()}' AS dictionary, (SELECT count(*) FROM dentries) AS path_index_entries,
      (SELECT CAST(sum(1 + (size - 1) // 1024) AS BIGINT) FROM dentries WHERE record_type = 'chunked_file') AS block_index_entries, true AS trailer_fits""")
    def archive_header(spark, d):
        a = archive.scan(spark, described(spark, d), "archives")
        fits = F.col("trailer_offset") + F.col("trailer_size") == F.col("file_size")
        return a.select("version", "allow_external_symlinks", "allow_escapes", "alignment", F.hex("dictionary").alias("dictionary"), "path_index_entries", "block_index_entries", fits.alias("trailer_fits"))

    @query(CTE + """SELECT path, CAST(CASE WHEN doc_id % 3 = 0 THEN 33152 + doc_id % 64 ELSE 33184 END AS BIGINT) AS mode FROM dentries""")
    def modes_with_archive_default(spark, d):
        """The record's mode, else the archive's own."""
        records, attrs = _tables(spark, d)
        return A.modes(records.where("path IS NOT NULL"), attrs).select("path", F.col("`unix.mode`").alias("mode"))

    @query(CTE + """SELECT path, created, CAST(90 AS BIGINT) AS modified, CAST(NULL AS BIGINT) AS accessed, created * 600000000 + 17672256000000000 + 116444736000000000 AS created_filetime
      FROM (SELECT path, CAST(CASE WHEN doc_id % 4 <> 1 THEN doc_id * 61 - 5000 ELSE 0 END AS BIGINT) AS created FROM dentries)""")
    def times_with_archive_default(spark, d):
        records, attrs = _tables(spark, d)
        out = A.archive_times(records.where("path IS NOT NULL").select("archive_id", "record_index", "path"), attrs)
        return out.select("path", "created", "modified", "accessed", S.filetime(F.col("created")).alias("created_filetime"))

    acl = " || ".join(f"CASE WHEN (m & {1 << (8 - k)}) <> 0 THEN '{'rwx'[k % 3]}' ELSE '-' END" for k in range(9))

    @query(CTE + f"""SELECT path, CASE WHEN record_type = 'directory' THEN 'd' WHEN record_type IN ('link', 'external_link') THEN 'l' ELSE '-' END || {acl} AS acl, size AS compressed, size, coalesce(created, '-') AS created,
      '[' || replace(path, chr(31), '/') || CASE WHEN record_type = 'directory' THEN '/' ELSE '' END || ']' AS shown, target FROM (SELECT *, CAST(CASE WHEN doc_id % 3 = 0 THEN 33152 + doc_id % 64 ELSE 33184 END AS BIGINT) AS m FROM dtimes)""")
    def long_listing(spark, d):
        return M.long_listing(*_tables(spark, d)).drop("archive_id")

    @query(CTE + "SELECT path, record_type, target FROM dlinks")
    def links_read_back(spark, d):
        """Written as links to entries and out of the archive, read back by record number."""
        return M._with_targets(_tables(spark, d)[0]).where("record_type IN ('link', 'external_link')").select("path", "record_type", "target")

    @query(CTE + "SELECT path, CAST(CASE WHEN record_type = 'directory' THEN (SELECT count(*) FROM dentries c WHERE starts_with(c.path, e.path || chr(31)) AND NOT contains(substr(c.path, length(e.path) + 2), chr(31))) WHEN record_type IN ('link', 'external_link') THEN 0 ELSE size END AS BIGINT) AS size FROM dentries e")
    def finder_sizes(spark, d):
        """Sizes where a directory counts its children (of the tree that the paths make) and a link is 0."""
        e = _tables(spark, d)[0].where("path IS NOT NULL").select("path", "record_type", "decompressed_length")
        below = E.with_path_parts(e).where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n"))
        return e.join(below, "path", "left").select("path", N.finder_size(F.col("record_type"), F.col("decompressed_length"), F.col("n")).alias("size"))

    @query("SELECT path, sha256(text) AS digest, CAST(CASE WHEN doc_id % 3 = 0 THEN (33152 + doc_id % 64) & 511 ELSE 416 END AS INT) AS mode FROM files")
    def extracted_files(spark, d):
        """All entries extracted to a folder, and the files read from there with their modes."""
        path = described(spark, d)

        def make(to: str) -> None:
            sink.extract(spark, path, to, allow_external=True, verify=False)

        return _in_folder(spark, kept(spark, d, "extracted", make))

    @query("SELECT path, sha256(text) AS digest, CAST(CASE WHEN doc_id % 3 = 0 THEN (33152 + doc_id % 64) & 511 ELSE 416 END AS INT) AS mode FROM files WHERE lang = 'de'")
    def extracted_members(spark, d):
        """One directory with all below it; other payloads aren't read."""
        path = described(spark, d)

        def make(to: str) -> None:
            sink.extract(spark, path, to, members=[S.SEP.join(("corpus", "de"))], allow_external=True, verify=False)

        return _in_folder(spark, kept(spark, d, "members", make))

    @query(CTE + """SELECT path, CASE WHEN record_type = 'external_link' THEN 'external_link' WHEN record_type = 'link' THEN 'link' WHEN record_type = 'directory' THEN 'directory' ELSE 'file' END AS record_type FROM dentries
      WHERE NOT regexp_matches(path, 'doc_.*5\\.txt$') AND NOT (record_type = 'link' AND regexp_matches(target, 'doc_.*5\\.txt$'))
      UNION ALL SELECT path, 'external_link' FROM dentries WHERE record_type = 'link' AND regexp_matches(target, 'doc_.*5\\.txt$')""")
    def created_archive(spark, d):
        """A folder walked into a new archive, without what a glob excludes; links to what is left out lead out of the archive."""
        folder = kept(spark, d, "extracted", lambda to: sink.extract(spark, described(spark, d), to, allow_external=True, verify=False))

        def make(path: str) -> None:
            sink.create(spark, folder, path, exclude=["*/doc_*5.txt"], allow_external=True)

        return loaded(spark, kept(spark, d, "created", make), "records").select("path", "record_type")

    @query("""SELECT r_name AS path, 'directory' AS record_type, CAST(NULL AS BIGINT) AS size FROM region UNION ALL SELECT r_name || chr(31) || n_name, 'file', CAST(n_nationkey * 10 AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'first', 'link', NULL UNION ALL SELECT 'out', 'external_link', NULL""")
    def old_version_tree(spark, d):
        """Version 0: paths from the stored tree, attribute maps with the old size."""
        return loaded(spark, _old(spark, d), "records").select("path", "record_type", F.col("decompressed_length").alias("size"))

    @query("""SELECT r_name || chr(31) || n_name AS path, 'name' AS key, 'json' AS declared_type, CASE WHEN n_nationkey % 2 = 0 THEN 'json' ELSE 'string' END AS effective_type, CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || '"' ELSE n_name END AS value
      FROM nation JOIN region ON n_regionkey = r_regionkey""")
    def old_version_attributes(spark, d):
        """Version 0 has untyped keys, read as JSON where it is JSON."""
        path = _old(spark, d)
        attrs = loaded(spark, path, "attrs").where("record_index IS NOT NULL").join(loaded(spark, path, "paths").select("record_index", "path"), "record_index")
        return attrs.select("path", "key", "declared_type", "effective_type", F.col("v_string").alias("value"))

    @query("SELECT concat_ws(chr(31), 'r' || r_regionkey) AS kind, r_regionkey % 2 = 0 AS is_archive FROM region")
    def probed_files(spark, d):
        """Files told by their first bytes; some are no archives."""

        def make(folder: str) -> None:
            os.makedirs(folder)
            for r in V.table(spark, d, "region").collect():
                with open(f"{folder}/r{r['r_regionkey']}", "wb") as f:
                    f.write(wire.Header(1, trailer=32).encode() if r["r_regionkey"] % 2 == 0 else b"\xff" * r["r_regionkey"])

        found = archive.probe(spark, kept(spark, d, "probed", make))
        return found.select(F.substring_index("path", "/", -1).alias("kind"), "is_archive")

    @query("SELECT path, decompressed_length FROM entries")
    def entries_by_table_function(spark, d):
        from .functions.udfs import register_functions

        path = corpus(spark, d)
        register_functions(spark)
        return spark.sql(f"SELECT path, decompressed_length FROM archive_entries('{path}')")

    @query("SELECT path, record_type FROM (SELECT path, CASE WHEN record_type = 'directory' THEN 'directory' ELSE 'file' END AS record_type FROM entries)")
    def streamed_entries(spark, d):
        """A folder of archives read as a stream, each once."""
        from .streaming import directory

        path = corpus(spark, d)
        work = f"{shared_dir(spark).removeprefix('file://')}/stream-{uuid.uuid4().hex}"
        q = directory.read_entries(spark, os.path.dirname(path), os.path.basename(path)).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        out = staged(spark.read.parquet(f"{work}/out").select("path", "record_type"))
        shutil.rmtree(work, ignore_errors=True)
        return out

    @query("SELECT path, CASE WHEN record_type = 'directory' THEN 'directory' ELSE 'file' END AS record_type FROM entries")
    def appended_batches(spark, d):
        """Three batches appended to one archive, each replayed once."""
        from .streaming import directory

        def make(path: str) -> None:
            put = directory.appender(path)
            f = V.files(spark, d, text=True).select("path", F.lit("file").alias("record_type"), F.encode("text", "UTF-8").alias("content"), "doc_id")
            for k in range(3):
                part = f.where(F.pmod("doc_id", F.lit(3)) == k).drop("doc_id")
                put(part, k)
                put(part, k)

        return loaded(spark, kept(spark, d, "appended", make), "records").select("path", "record_type")

    @query("""SELECT CAST(CAST(archive_id AS HUGEINT) * 18446744073709551616 + record_index AS VARCHAR) AS composite_key, path FROM overlay WHERE record_index > 0""")
    def composite_lookups(spark, d):
        """Records by packed numbers of archive and record, among as many that name nothing."""
        o = V.overlay(spark, d).select("archive_id", "record_index", "path")
        key = lambda r: S.composite(F.col("archive_id"), r).alias("composite_key")
        keys = o.select(key(F.col("record_index"))).unionAll(o.select(key(F.col("record_index") + 10**9)))
        return N.by_composite(o, keys).select(F.col("composite_key").cast("string").alias("composite_key"), "path")

    @query("""SELECT path, record_index FROM (SELECT path, min(doc_id) AS record_index FROM files GROUP BY path) WHERE record_index % 2 = 0
      UNION ALL SELECT concat_ws(chr(31), path, 'new'), doc_id + 1000000 FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT concat_ws(chr(31), path, 'new', 'deep_' || doc_id), doc_id + 2000000 FROM files WHERE doc_id % 2 = 0
      UNION ALL SELECT 'top_' || doc_id, doc_id + 3000000 FROM files WHERE doc_id % 2 = 1""")
    def pending_lookups(spark, d):
        """Entries added below indexed ones, below those, and at the root, before the index is made anew."""
        f, i = V.files(spark, d), F.col("doc_id")
        row = lambda part, number, above, name: f.where(part).select(number.alias("record_index"), above.alias("parent_index"), name.alias("name"))
        none = F.lit(None).cast("long")
        pending = row("doc_id % 2 = 0", i + 1000000, i, F.lit("new")).unionAll(row("doc_id % 2 = 0", i + 2000000, i + 1000000, F.concat(F.lit("deep_"), i))).unionAll(row("doc_id % 2 = 1", i + 3000000, none, F.concat(F.lit("top_"), i)))
        return N.with_pending(f.where("doc_id % 2 = 0").select("path", i.alias("record_index")), pending)

    @query("""SELECT path, arg_min(position, position) AS position FROM (SELECT page_id AS position, path, page_id % 4 = 0 AS is_dir FROM (SELECT position AS page_id, path FROM site)
      WHERE NOT starts_with(string_split(path, chr(31))[-1], 'p1') OR true) WHERE NOT is_dir AND NOT regexp_matches(replace(path, chr(31), '/'), '^.*[37]$') AND path <> (SELECT min(path) FROM site) GROUP BY path""")
    def walk_filters(spark, d):
        """What a walk takes in that isn't recursive: no directories but its root, nothing excluded, not the archive itself, the first of each path."""
        s = V.site(spark, d)
        own = s.agg(F.min("path")).first()[0]
        rows = s.select("position", "path", F.lit("").alias("root"), (F.col("position") % 4 == 0).alias("is_dir"))
        return E.collect(rows, include_hidden=True, globs=["*[37]"], recursive=False, output=own).select("path", "position")

    @query("SELECT o_orderpriority AS archive, count(DISTINCT o_custkey % 3) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority > '3' GROUP BY o_orderpriority HAVING count(DISTINCT o_custkey % 3) > 1")
    def dictionary_conflicts(spark, d):
        o = V.table(spark, d, "orders").where("o_orderkey % 2 = 0 OR o_orderpriority > '3'")
        return M.dictionary_conflicts(o.select(F.col("o_orderpriority").alias("archive_id"), (F.col("o_custkey") % 3).alias("dictionary"))).select(F.col("archive_id").alias("archive"), "n")

    @query("""SELECT p_partkey, path, NOT (path = '' OR regexp_matches(path, '(^|\\x1f)\\.{0,2}(\\x1f|$)') OR regexp_matches(path, '[/\\\\]') OR regexp_matches(path, '[\\x01-\\x1e\\x7f]')) AS valid FROM (SELECT p_partkey,
      CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN p_name || chr(31) || '.' WHEN 3 THEN p_name || chr(31) WHEN 4 THEN 'a/' || p_name WHEN 5 THEN p_name || chr(9) || 'x' WHEN 6 THEN chr(31) || p_name WHEN 7 THEN '...' || p_name || chr(31) || '..b' ELSE p_name || chr(31) || p_brand END AS path FROM part)""")
    def valid_paths(spark, d):
        return _paths(spark, d).select("p_partkey", "path", E.valid_path(F.col("path")).alias("valid"))

    @query("""SELECT p_partkey, path, p_partkey % 9 IN (7, 8) AS extractable FROM (SELECT p_partkey,
      CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN p_name || chr(31) || '.' WHEN 3 THEN p_name || chr(31) WHEN 4 THEN 'a/' || p_name WHEN 5 THEN p_name || chr(9) || 'x' WHEN 6 THEN chr(31) || p_name WHEN 7 THEN '...' || p_name || chr(31) || '..b' ELSE p_name || chr(31) || p_brand END AS path FROM part)""")
    def extractable_paths(spark, d):
        """With Unicode categories, so by a function in Python."""
        from .functions.udfs import path_extractable

        return _paths(spark, d).select("p_partkey", "path", path_extractable("path").alias("extractable"))

    @query("""SELECT page_id, path FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a' || chr(31) || 'b' || page_id WHEN 1 THEN 'caf' || chr(233) || chr(31) || page_id ELSE 'x' || chr(31) || 'y z' END AS path FROM pages)""")
    def normal_paths(spark, d):
        """Parts to drop, to go back over, to compose and to trim."""
        from .functions.udfs import path_normalize

        i = F.col("page_id").cast("string")
        raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/a//./gone/../b"), i)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("café/"), i)).otherwise(F.lit("../x/ y z "))
        return V.table(spark, d, "pages").select("page_id", path_normalize(raw).alias("path"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 9
    sep = F.lit(S.SEP)
    forms = [F.lit(""), F.lit(".."), F.concat(n, sep, F.lit(".")), F.concat(n, sep), F.concat(F.lit("a/"), n), F.concat(n, F.lit("\tx")), F.concat(sep, n), F.concat(F.lit("..."), n, sep, F.lit("..b")), F.concat(n, sep, "p_brand")]
    path = F.lit(None).cast("string")
    for j, form in enumerate(forms):
        path = F.when(k == j, form).otherwise(path)
    return V.table(spark, d, "part").select("p_partkey", path.alias("path"))


def _asked(spark: SparkSession, d: str, path: str) -> DataFrame:
    f = V.files(spark, d).select("path", (F.col("doc_id") + 1).alias("record_index"))
    asked = V.requests(spark, d).join(f, "record_index").select("path", "request", "offset", "n")
    p = loaded(spark, path, "paths").select("path", "record_index")
    return asked.join(p, "path").select(F.lit(path).alias("uri"), "record_index", "offset", "n", "request")


def _in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest, mode of the files in a folder that executors share; links are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, os.stat(f"{folder}/{p.replace(S.SEP, '/')}").st_mode & 0o777) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([m for _, m in rows], pa.int32())], names=["path", "mode"])

    # links lie below a folder of their own
    names = [(p,) for p in sink.listing(folder)[0] if not p.startswith(S.SEP.join(("corpus", "links")))]
    paths = spark.createDataFrame(names, "path string").repartition("path")
    files = sink.contents_of(paths, folder).select("path", F.sha2("content", 256).alias("digest"))
    return files.join(paths.mapInArrow(run, "path string, mode int"), "path")


def _old(spark: SparkSession, d: str) -> str:
    """Regions and nations as an archive of version 0: a few rows, put together on the driver."""

    def make(path: str) -> None:
        c, payload, regions = wire.Catalog(wire.Header(0, external=True), keys=[("name", "json")]), b"", {}
        for r in V.table(spark, d, "region").orderBy("r_regionkey").collect():
            c.records.append(wire.Record("directory", r["r_name"]))
            regions[r["r_regionkey"]] = len(c.records)
            c.root.append(len(c.records))
        for n in V.table(spark, d, "nation").orderBy("n_nationkey").collect():
            body = b"0123456789" * n["n_nationkey"]
            name = f'"{n["n_name"]}"' if n["n_nationkey"] % 2 == 0 else n["n_name"]
            c.records.append(wire.Record("file", n["n_name"], {0: name.encode()}, "stored", None, len(body), len(body), 32 + len(payload)))
            c.records[regions[n["n_regionkey"]] - 1].entries.append(len(c.records))
            payload += body
        for record in (wire.Record("link", "first", target=1), wire.Record("external_link", "out", external_target="/srv")):
            c.records.append(record)
            c.root.append(len(c.records))
        c.header.trailer = 32 + len(payload)
        system, inner = archive.open_file(path)
        with system.open_output_stream(inner) as f:
            f.write(c.header.encode() + payload + wire.encode_old(c, padded=True))

    return kept(spark, d, "old", make)
