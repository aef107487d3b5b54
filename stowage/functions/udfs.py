"""Functions for SQL users: registered pandas UDFs, and a table function over an archive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.errors import PathError
from .digest import blake3_many
from .paths import check_extractable, normalize


@F.pandas_udf(T.DecimalType(20, 0))
def vu64_decode(raw: pd.Series) -> pd.Series:
    """The number in bytes that hold exactly one variable-length integer; null otherwise."""
    from decimal import Decimal

    from ..sources.wire import decode_number

    out = [None if r is None else decode_number("vu64", bytes(r)) for r in raw]
    return pd.Series([None if v is None else Decimal(v) for v in out], dtype=object)


@F.pandas_udf(T.BinaryType())
def vu64_encode(value: pd.Series) -> pd.Series:
    from ..sources.vint import encode_vu64

    return value.map(lambda v: None if pd.isna(v) else encode_vu64(int(v)))


@F.pandas_udf(T.LongType())
def vi64_decode(raw: pd.Series) -> pd.Series:
    from ..sources.wire import decode_number

    return pd.Series([None if r is None else decode_number("vi64", bytes(r)) for r in raw], dtype="Int64")


@F.pandas_udf(T.BinaryType())
def vi64_encode(value: pd.Series) -> pd.Series:
    from ..sources.vint import encode_vi64

    return value.map(lambda v: None if pd.isna(v) else encode_vi64(int(v)))


@F.pandas_udf(T.StringType())
def path_normalize(path: pd.Series) -> pd.Series:
    """The archive path of a platform path; null where there is none."""

    def one(p: str | None) -> str | None:
        try:
            return None if p is None else normalize(p)
        except PathError:
            return None

    return path.map(one)


@F.pandas_udf(T.BooleanType())
def path_extractable(path: pd.Series) -> pd.Series:
    def one(p: str | None) -> bool:
        try:
            check_extractable(p or "")
        except PathError:
            return False
        return True

    return path.map(one)


def _codec(name: str, codec: str, forward: bool):
    @F.pandas_udf(T.BinaryType())
    def run(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ..sources.codecs import compress, decompress

        for s in data:
            yield s.map(lambda x: None if x is None else (compress if forward else decompress)(bytes(x), codec))

    run.__name__ = name
    return run


zstd_compress = _codec("zstd_compress", "zstd", True)
zstd_decompress = _codec("zstd_decompress", "zstd", False)
xz_compress = _codec("xz_compress", "xz", True)
xz_decompress = _codec("xz_decompress", "xz", False)


@F.pandas_udf(T.BinaryType())
def blake3_256(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[there] = pd.Series(blake3_many([bytes(x) for x in data[there]]), index=data.index[there], dtype=object)
    return out


@F.udtf(returnType="path string, record_index long, record_type string, length long, decompressed_length long")
class ArchiveEntries:
    """SELECT * FROM archive_entries('uri')"""

    def eval(self, uri: str):
        from ..sources.archive import open_archive

        catalog, _ = open_archive(uri)
        for path, index in catalog.items():
            r = catalog.records[index - 1]
            yield path, index, r.kind, r.length, r.decompressed_length


def register_functions(spark: SparkSession) -> None:
    for name, f in {
        "vu64_decode": vu64_decode, "vu64_encode": vu64_encode, "vi64_decode": vi64_decode, "vi64_encode": vi64_encode, "path_normalize": path_normalize, "path_extractable": path_extractable,
        "zstd_compress": zstd_compress, "zstd_decompress": zstd_decompress, "xz_compress": xz_compress, "xz_decompress": xz_decompress, "blake3": blake3_256,
    }.items():
        spark.udf.register(name, f)
    spark.udtf.register("archive_entries", ArchiveEntries)
