"""Typed attributes with fallbacks and defaults.

attrs_raw(archive_id, record_index (null: the archive's own), key_index, raw);
attr_keys(archive_id, key_index, name, attr_type).  Fixed-width and text types
decode as expressions; variable-length integers by ``functions.udfs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_MODES

#: Fixed values of the format: type tags.
TYPES = ["bytes", "string", "json", "u8", "vi32", "vu32", "vi64", "vu64", "u128", "u256", "datetime"]
XATTR = "linux.xattr."


def named(attrs_raw: DataFrame, attr_keys: DataFrame) -> DataFrame:
    """Attributes with name and declared type; keys outside the table are dropped.

    attr_keys has a few rows an archive, but its size isn't proven, so the
    planner chooses the join.
    """
    return attrs_raw.join(attr_keys, ["archive_id", "key_index"]).withColumnsRenamed({"name": "key", "attr_type": "declared_type"})


def typed(attrs: DataFrame, number: Column | None = None) -> DataFrame:
    """Adds effective_type, v_string, v_long, v_bytes, v_ts to attrs(key, declared_type, raw).

    number: the decoded value of variable-length types, null where it doesn't
    use up all bytes (default: column ``decoded`` if there is one).
    """
    raw, kind = F.col("raw"), F.col("declared_type")
    if number is None:
        number = F.col("decoded") if "decoded" in attrs.columns else F.lit(None).cast("long")
    text = F.try_validate_utf8(raw)
    n = F.octet_length(raw)
    is_json = F.try_parse_json(text).isNotNull()
    effective = (
        F.when(kind == "string", F.when(text.isNotNull(), "string").otherwise("bytes"))
        .when(kind == "json", F.when(text.isNull(), "bytes").when(is_json, "json").otherwise("string"))
        .when(kind == "u8", F.when(n == 1, "u8").otherwise("bytes"))
        .when(kind.isin("vi32", "vu32", "vi64", "vu64", "datetime"), F.when(number.isNotNull(), kind).otherwise("bytes"))
        .when(kind == "u128", F.when(n == 16, "u128").otherwise("bytes"))
        .when(kind == "u256", F.when(n == 32, "u256").otherwise("bytes"))
        .otherwise("bytes")
    )
    eff = F.col("effective_type")
    return attrs.withColumn("effective_type", effective).withColumns(
        {
            "v_string": F.when(eff.isin("string", "json"), text),
            "v_long": F.when(eff == "u8", F.conv(F.hex(raw), 16, 10).cast("long")).when(eff.isin("vi32", "vu32", "vi64", "vu64", "datetime"), number),
            "v_bytes": F.when(eff.isin("bytes", "u128", "u256"), raw),
            "v_ts": F.when(eff == "datetime", F.timestamp_seconds(number * 60 + 1767225600)),
        }
    )


def with_default(records: DataFrame, attrs: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """records(archive_id, record_index, …) with the attribute: the record's, else the archive's, else default."""
    own = attrs.where((F.col("key") == key) & F.col("record_index").isNotNull()).select("archive_id", "record_index", F.col(value).alias("_own"))
    top = attrs.where((F.col("key") == key) & F.col("record_index").isNull()).select("archive_id", F.col(value).alias("_top"))
    return records.join(own, ["archive_id", "record_index"], "left").join(top, "archive_id", "left").withColumn(key, F.coalesce("_own", "_top", default)).drop("_own", "_top")


def default_mode(record_type: Column) -> Column:
    out = F.lit(None).cast("long")
    for kind, mode in DEFAULT_MODES.items():
        out = F.when(record_type == kind, F.lit(mode).cast("long")).otherwise(out)
    return out


def modes(records: DataFrame, attrs: DataFrame) -> DataFrame:
    return with_default(records, attrs, "unix.mode", "v_long", default_mode(F.col("record_type")))


def timestamps(wide: DataFrame) -> DataFrame:
    """created, modified, accessed with their fallbacks: modified from created, accessed from modified, else the epoch."""
    epoch = F.timestamp_seconds(F.lit(0))
    mtime = F.coalesce("modified", "created", epoch)
    return wide.withColumns({"mtime": mtime, "atime": F.coalesce("accessed", mtime), "crtime": F.coalesce("created", epoch)})


def archive_times(records: DataFrame, attrs: DataFrame, keys: tuple[str, ...] = ("created", "modified", "accessed")) -> DataFrame:
    """records with the minutes of each time: the record's, else the archive's; only values that are times count."""
    times = attrs.where("effective_type = 'datetime'")
    for key in keys:
        records = with_default(records, times, key, "v_long", F.lit(None).cast("long"))
    return records


def factored(records: DataFrame, column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(archive default: the first file's value; records with equal values dropped)."""
    first = records.where(F.col(column).isNotNull()).groupBy("archive_id").agg(F.min_by(column, order).alias("_default"))
    kept = records.join(first, "archive_id", "left").withColumn(column, F.when(F.col(column) != F.coalesce("_default", F.lit(-1)), F.col(column))).drop("_default")
    return first.withColumnRenamed("_default", column), kept


def omit_default_mode(records: DataFrame) -> DataFrame:
    return records.withColumn("mode", F.when(F.col("mode") != default_mode(F.col("record_type")), F.col("mode")))


def xattrs(attrs: DataFrame) -> DataFrame:
    """Extended attributes, without their prefix."""
    return attrs.where(F.col("key").startswith(XATTR)).withColumn("xattr", F.expr(f"substring(key, {len(XATTR) + 1})"))


def upsert_attr(records: DataFrame, key: str, raw: Column) -> DataFrame:
    """records with map column attrs: key set to raw."""
    others = F.map_filter("attrs", lambda k, _: k != key)
    return records.withColumn("attrs", F.map_concat(others, F.create_map(F.lit(key), raw)))
