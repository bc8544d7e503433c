"""Exact order statistics per group without sorting any group in one task.

Values are turned into integer codes, repeated codes are counted before the
shuffle, and the wanted rank is narrowed down over three histograms of at most
2**20 buckets each (the first one spans all 64-bit codes). Counts are summed per bucket
before they meet the wanted ranks. Only bucket counts are
ever ordered, so a group of any size, or of one repeated value, costs the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIFTS = (40, 20, 0)


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """One row per group and entry of ``ranks``: ``(*keys, stat, n, value)``.

    ``ranks`` maps a statistic's name to its zero-based rank, an expression over the
    group size ``n``. ``value`` is a decimal of at most 18 digits, of any scale; NULLs are left out.
    """
    if not keys:
        raise ValueError("order_statistics needs at least one group column")
    kind = df.schema[value].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > 18:
        raise TypeError(f"order_statistics needs a decimal of at most 18 digits, not {kind.simpleString()}")
    scale = kind.scale
    code = (F.col(value) * F.lit(10**scale)).cast("bigint")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, code.alias("_code"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("stat"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    targets = (
        counts.groupBy(*keys)
        .agg(F.sum("_rows").alias("n"))
        .select(*keys, "n", F.inline(wanted))
    )
    in_order = Window.partitionBy(*keys, "stat").orderBy("_bucket")
    for level, shift in enumerate(_SHIFTS):
        bucket = F.shiftright(F.col("_code"), shift).alias("_bucket")
        left = counts.groupBy(*keys, bucket).agg(F.sum("_rows").alias("_rows")).alias("c")
        right = targets.alias("t")
        same = [F.col(f"c.{key}").eqNullSafe(F.col(f"t.{key}")) for key in keys]
        if level:
            # only buckets inside the one the rank lies in
            same.append(F.shiftright(F.col("c._bucket"), 20) == F.col("t._bucket"))
        wanted_ranks = [F.col(f"t.{name}") for name in (*keys, "stat", "n", "rank")]
        histogram = left.join(right, reduce(Column.__and__, same)).select(*wanted_ranks, "c._bucket", "c._rows")
        cumulated = histogram.withColumn("_upto", F.sum("_rows").over(in_order))
        below = F.col("_upto") - F.col("_rows")
        targets = cumulated.where((F.col("_upto") > F.col("rank")) & (below <= F.col("rank"))).select(
            *keys, "stat", "n", (F.col("rank") - below).alias("rank"), "_bucket"
        )
    found = (F.col("_bucket") / F.lit(10**scale).cast("double")).alias("value")
    return targets.select(*keys, "stat", "n", found)


def nearest_rank(p: float) -> Column:
    """Rank ``round((n - 1) * p)``, ties to even."""
    return F.bround((F.col("n") - 1).cast("double") * F.lit(p))


def percentile_nearest(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    stats = order_statistics(df, keys, value, {name: nearest_rank(p)})
    return stats.select(*keys, F.col("value").alias(name))


def median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Middle value, or the mean of the two middle values."""
    middle = {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2)}
    stats = order_statistics(df, keys, value, middle)
    return stats.groupBy(*keys).agg((F.sum("value") / 2).alias(name))
