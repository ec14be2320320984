"""Total orders, exact positions, ranks, samples and top-k without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.joins import lookup_join
from pairloom.session import pinned


def shuffle_key(key: Column | str, seed: int) -> Column:
    """Reproducible random order: depends on the row's key and the seed only."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in random order: one range-partitioned sort."""
    return df.orderBy(shuffle_key(key, seed), key)


def with_position(df: DataFrame, order_by: list[Column], name: str = "position", within: str | None = None) -> DataFrame:
    """Exact 1-based place of each row in the order, per ``within`` group if given.

    Rows are sorted by range and pinned; a row's place is its place inside its
    partition plus the sizes of the partitions before it. Only one number per
    partition is gathered, and a group may span any number of partitions.
    """
    group = [F.col(within)] if within else []
    fixed = pinned(
        df.orderBy(*group, *order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # One row per partition of the sort: bounded by the partition count, not by the data.
    placed = fixed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in_part") + 1)
    if within:
        first = placed.groupBy(within).agg(F.min(name).alias("_first"))
        placed = lookup_join(placed, first, within, "inner", spread_by=["_part", "_in_part"])
        placed = placed.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return placed.drop("_part", "_in_part", "_before")


def smallest(df: DataFrame, order_by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the order, by exact position: they may be any number."""
    return with_position(df, order_by, "_place").where(F.col("_place") <= n).drop("_place")


_DIGITS, _KEY_DIGITS = 4, 32


def sample_rows(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, or ``fraction`` of the row count rounded half to even, without replacement.

    The rows with the smallest shuffle keys are kept by one filter: nothing is sorted or
    moved. The limit is found digit by digit: each pass counts the keys by their next
    digits among those that share the digits found so far, a bounded histogram, until a
    whole group fits. Rows with one key are equal in order; any of them fill the rest.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    keys = df.select(shuffle_key(key, seed).alias("_key"))
    if n is None:
        n = round(fraction * df.count())
    found, left = "", n
    while left > 0 and len(found) < _KEY_DIGITS:
        group = F.substring("_key", len(found) + 1, _DIGITS)
        counts = sorted(map(tuple, keys.where(F.col("_key").startswith(found)).groupBy(group.alias("digits")).agg(F.count("*").alias("n")).collect()))
        for digits, size in counts:
            if size >= left:
                found += digits
                break
            left -= size
        else:
            return df  # fewer rows than asked for
        if size == left:
            # All keys with these digits belong to the sample.
            return df.where(F.substring(shuffle_key(key, seed), 1, len(found)) <= found)
    if left <= 0:
        return df.limit(0)
    sample = df.where(shuffle_key(key, seed) < found)
    return sample.unionByName(df.where(shuffle_key(key, seed) == found).limit(left))


_SALTS = 64


def top_k(scored: DataFrame, group: str, score: str, item: str, k: int = 20) -> DataFrame:
    """Best ``k`` items of each group with 0-based ``rank``; ties by item, ascending.

    Two steps: the best of each salted part of a group, then of the group. Spark also
    keeps only ``k`` rows per part before each shuffle, so no task holds all candidates
    of a group, however many tasks made them.
    """
    order = [F.desc(score), F.asc(item)]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(_SALTS)))
    parts = salted.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)) - 1).where(F.col("rank") < k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).where(F.col("rank") < k).drop("_salt")
