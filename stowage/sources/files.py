"""What a create takes from files besides their bytes, and its options."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import DEFAULT_MODES, EPOCH, SEP
from .codecs import DICTIONARY, SAMPLE, TIMES, train
from .errors import WriteError
from .wire import encode_value

TRUE = ("true", "1", "yes")


def file_attributes(path: str, kind: str = "file", timestamps: bool = False, ownership: bool = False, xattrs: bool = False, sub_minute: bool = True) -> dict[str, bytes]:
    """Attributes of a file: mode if it isn't the default; times, owner, extended attributes if asked for."""
    s, out = os.lstat(path), {}
    if s.st_mode != DEFAULT_MODES.get(kind):
        out["unix.mode"] = encode_value("vu32", s.st_mode)
    if timestamps:
        for name, ns in (("created", getattr(s, "st_birthtime_ns", None) or s.st_ctime_ns), ("modified", s.st_mtime_ns), ("accessed", s.st_atime_ns)):
            minutes, rest = divmod(ns - EPOCH * 10**9, 60 * 10**9)
            out[name] = encode_value("datetime", minutes)
            if sub_minute and rest:
                out[f"{name}.seconds"] = encode_value("u8", rest // 10**9)
                if rest % 10**9:
                    out[f"{name}.nanoseconds"] = encode_value("vu64", rest)
    if ownership:
        out["unix.uid"], out["unix.gid"] = encode_value("vu32", s.st_uid), encode_value("vu32", s.st_gid)
    if xattrs and hasattr(os, "listxattr"):
        for name in os.listxattr(path, follow_symlinks=False):
            out[f"linux.xattr.{name}"] = os.getxattr(path, name, follow_symlinks=False)
    return out


def with_attributes(rows: DataFrame, folder: str, **options) -> DataFrame:
    """rows of ``sink.walk`` with their files' attributes, read where the files lie (a folder that executors share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(b.schema.get_field_index("path")).to_pylist()
            attrs = [list(file_attributes(os.path.join(folder, *p.split(SEP)), **options).items()) for p in paths]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(attrs, pa.map_(pa.string(), pa.binary()))], names=[*b.schema.names, "attrs"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("attrs", T.MapType(T.StringType(), T.BinaryType()))]))


def codec_options(words: dict[str, str]) -> dict[str, object]:
    """k=v options of a codec: integers and truth words are read, the rest stays text."""
    out: dict[str, object] = {}
    for k, v in words.items():
        if v.lower() in (*TRUE, "false", "no") and not v.isdigit():
            out[k] = v.lower() in TRUE
        else:
            try:
                out[k] = int(v)
            except ValueError:
                out[k] = v
    return out


def operand_words(words: list[str]) -> list[tuple[str, str, bool]]:
    """(path, codec, chunked) of create operands; a codec flag holds for what follows it."""
    codec, chunked, out = "zstd", False, []
    flags = {"--zstd": ("zstd", False), "--zstd-chunked": ("zstd", True), "--stored": ("stored", False), "--xz": ("xz", False)}
    for w in words:
        if w in flags:
            codec, chunked = flags[w]
        else:
            out.append((w, codec, chunked))
    return out


def trained_dictionary(entries: DataFrame, size: int = DICTIONARY, budget: int = 4) -> bytes | None:
    """A zstd dictionary from the entries' contents, or none where they are too few.

    Samples are cut to SAMPLE bytes on the executors; the driver takes those of
    least path hash, about ``budget`` times what training needs.
    """
    cut = entries.where(F.octet_length("content") > 0).select(F.xxhash64("path").alias("h"), "path", F.substring("content", 1, SAMPLE).alias("sample"))
    mean = cut.agg(F.avg(F.octet_length("sample"))).first()[0] or SAMPLE
    most = max(1, int(budget * size * TIMES / mean))
    return train([bytes(r["sample"]) for r in cut.orderBy("h", "path").limit(most).collect()], size)


def capture_links(spark: SparkSession, folder: str, archived: list[str], allow_external: bool = False) -> DataFrame:
    """Symlinks below a folder as rows to write: to archived paths internal, others external or refused."""
    from .sink import refuse

    rows, known = [], set(archived)
    for top, dirs, files in os.walk(folder, onerror=refuse):
        for name in (*dirs, *files):
            full = os.path.join(top, name)
            if not os.path.islink(full):
                continue
            path = os.path.relpath(full, folder).replace(os.sep, SEP)
            raw = os.readlink(full)
            target = os.path.relpath(os.path.normpath(os.path.join(top, raw)), folder).replace(os.sep, SEP)
            if target in known:
                rows.append((path, "link", target, None))
            elif allow_external:
                rows.append((path, "external_link", None, raw))
            else:
                raise WriteError(f"link to {raw!r} leaves the archive", path=path)
    return spark.createDataFrame(rows, "path string, record_type string, target string, external_target string")
