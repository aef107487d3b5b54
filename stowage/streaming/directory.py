"""A folder of archives as a stream, and appending a stream to an archive.

New archives arrive file by file; each micro-batch reads the table of the new
ones only.  The other way, each micro-batch of entries is appended to one
archive; the batch's number is an attribute of the archive that the same rename
publishes, so a replay of what was appended is skipped, and one of what was not
starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import sink
from ..sources.archive import open_archive, open_file
from ..sources.errors import OpenError
from ..sources.vint import decode_vu64, encode_vu64

BATCH = "stowage.batch"
_ENTRIES = "uri string, path string, record_index long, record_type string, length long, decompressed_length long"


def read_entries(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A streaming DataFrame of the entries of archives that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                catalog, _ = open_archive(uri.removeprefix("file:") if uri.startswith("file:/") else uri)
                rows = [(uri, p, i, (r := catalog.records[i - 1]).kind, r.length, r.decompressed_length) for p, i in catalog.items()]
                names = ["uri", "path", "record_index", "record_type", "length", "decompressed_length"]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path").mapInArrow(run, _ENTRIES)


def last_batch(path: str) -> int:
    """The number of the last batch appended, -1 if there is none."""
    try:
        catalog, _ = open_archive(path)
    except (OpenError, FileNotFoundError):
        return -1
    key = next((k for k, (n, _) in enumerate(catalog.keys) if n == BATCH), None)
    return decode_vu64(catalog.attrs[key])[0] if key in catalog.attrs else -1


def appender(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends each batch once."""

    def put(batch: DataFrame, number: int) -> None:
        if number <= last_batch(path) or batch.isEmpty():
            return
        system, inner = open_file(path)
        sink.write(batch, path, append=system.get_file_info(inner).is_file, archive_attrs={BATCH: ("vu64", encode_vu64(number))}, **options)

    return put


def append_stream(entries: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    return entries.writeStream.foreachBatch(appender(path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
