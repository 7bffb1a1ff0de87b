"""Large values kept apart: an envelope of 44 bytes stands for a value over a threshold, the bytes lie by hash."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = bytearray(b"\x00\xffPX")
SIZE = 44


def envelope(value: Column) -> Column:
    """Magic, SHA-256 of the value, its length as 8 little-endian bytes."""
    size = F.reverse(F.unhex(F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")))
    return F.concat(F.lit(MAGIC), F.unhex(F.sha2(value, 256)), size)


def is_envelope(value: Column) -> Column:
    return F.coalesce((F.octet_length(value) == SIZE) & (F.substring(value, 1, 4) == F.lit(MAGIC)), F.lit(False))


def blob_hash(value: Column) -> Column:
    """The hash in an envelope; null for other bytes."""
    return F.when(is_envelope(value), F.substring(value, 5, 32))


def blob_size(value: Column) -> Column:
    return F.when(is_envelope(value), F.conv(F.hex(F.reverse(F.substring(value, 37, 8))), 16, 10).cast("bigint"))


def externalise(rows: DataFrame, threshold: int, known: DataFrame | None = None, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with envelopes for values of more than ``threshold`` bytes, the blobs (hash, bytes) that ``known`` lacks); envelopes stay."""
    large = (F.octet_length(value) > threshold) & ~is_envelope(F.col(value))
    new = rows.where(large).groupBy(F.unhex(F.sha2(F.col(value), 256)).alias("hash")).agg(F.any_value(value).alias("bytes"))
    if known is not None:
        new = new.join(known.select("hash"), "hash", "left_anti")
    return rows.withColumn(value, F.when(large, envelope(F.col(value))).otherwise(F.col(value))), new


def unwrap(rows: DataFrame, blobs: DataFrame, value: str = "value") -> DataFrame:
    """Values for envelopes whose blob is there; other bytes as they are. Only rows with an envelope are joined."""
    named = blobs.select(F.col("hash").alias("__hash"), F.col("bytes").alias("__bytes")).dropDuplicates(["__hash"])
    held = rows.where(is_envelope(F.col(value)))
    out = held.join(named, blob_hash(F.col(value)) == F.col("__hash"), "left").withColumn(value, F.coalesce("__bytes", value))
    return rows.where(~is_envelope(F.col(value))).unionByName(out.select(*rows.columns))


def garbage(blobs: DataFrame, live: list[DataFrame], value: str = "value") -> DataFrame:
    """Hashes that none of the live tables refer to."""
    used = None
    for rows in live:
        now = rows.select(blob_hash(F.col(value)).alias("hash")).where("hash IS NOT NULL")
        used = now if used is None else used.union(now)
    return blobs.select("hash") if used is None else blobs.select("hash").join(used.distinct(), "hash", "left_anti")
