"""Lookup joins that stay correct and even when the small side grows or a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 128 * 1024 * 1024
_HOT_SHARE = 100_000
_FAN_OUT = 64
# What a row costs in a hash table beside its values: its header, its pointer and the free slots.
_ROW_BYTES = 64


_NESTED = (T.StructType, T.MapType, T.ArrayType)


def _width(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StructType, T.MapType)) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (*_NESTED, T.BinaryType)):
        # Twice its length as text: a short number takes eight bytes.
        return 2 * F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 16 * F.greatest(F.size(c), F.lit(1))
        return 8 * F.greatest(F.size(c), F.lit(1)) + 16
    return F.lit(8)


def frame_bytes(df: DataFrame) -> int:
    """Size of the rows in a hash table, its overhead included: one parallel pass, one number back."""
    row = sum((_width(f) for f in df.schema.fields), F.lit(_ROW_BYTES)).cast("bigint")
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def hot_keys(facts: DataFrame, key: list[str], spread_by: list[str]) -> DataFrame:
    """The keys with over a 100,000th of a fixed sample of the rows, so fewer than 100,000 keys.

    The sample and the tie order follow from the rows' own columns, so every
    evaluation names the same keys. They steer the join's layout, never its result.
    """
    sample = facts.where(F.pmod(F.xxhash64(*spread_by), F.lit(16)) == 0).select(*key)
    counts = sample.groupBy(*key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where((F.col("_n") > 16) & (F.col("_n") * _HOT_SHARE > total)).select(*key, F.lit(True).alias("_hot"))


def salted_join(facts: DataFrame, dim: DataFrame, key: list[str], how: str, spread_by: list[str]) -> DataFrame:
    """Shuffled join in which the rows of a hot key go to many tasks.

    ``spread_by`` are columns that differ between rows of one key (a row id).
    Hot facts get a salt; the matching ``dim`` rows are repeated once per salt. Hot keys
    are told by an 8-byte hash, so the broadcast list stays under two megabytes whatever
    the keys are; keys that share a hot key's hash are only salted needlessly.
    """
    facts, dim = (side.withColumn("_hash", F.xxhash64(*key)) for side in (facts, dim))
    hot = F.broadcast(hot_keys(facts, ["_hash"], spread_by))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(_FAN_OUT)).cast("int")).otherwise(0)
    left = facts.join(hot, "_hash", "left").withColumn("_salt", salt).drop("_hot", "_hash")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(_FAN_OUT - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, "_hash", "left").withColumn("_salt", F.explode(copies)).drop("_hot", "_hash")
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str | list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join facts with a lookup table: broadcast when its measured size is within
    ``max_bytes``, else shuffled with hot keys salted. ``how``: inner, left,
    left_semi or left_anti."""
    key = [key] if isinstance(key, str) else list(key)
    if frame_bytes(dim) <= max_bytes:
        return facts.join(F.broadcast(dim), key, how)
    return salted_join(facts, dim, key, how, spread_by or facts.columns)
