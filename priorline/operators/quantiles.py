"""Exact percentiles by two-pass rank selection.

The built-in ``percentile`` keeps all distinct values of a group in one aggregation buffer. Here the first
pass only counts rows per bucket of the value's magnitude; the running counts say in which bucket each
wanted rank lies. The second pass takes the values of those buckets alone, counts them and selects the
ranks there. No other value is shuffled or sorted. Linear interpolation, NULLs ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.operators.prefix import sums_before
from priorline.sources.durable import durable

_STEPS_PER_OCTAVE = 256
_OFFSET = 1 << 20


def magnitude_bucket(value: Column) -> Column:
    """Whole number that never decreases with the value, under 2**21 different ones in all."""
    size = F.floor(F.log2(F.abs(value)) * _STEPS_PER_OCTAVE).cast("bigint") + _OFFSET
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """One line per group with a column per named probability; df is read twice."""
    by = list(by)
    # A struct compares missing keys as equal, in joins as well.
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_any"))
    valued = df.select(group.alias("_group"), F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    ).withColumn("_bucket", magnitude_bucket(F.col("_v")))
    counts = valued.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 2**21 small rows in a group, whatever the number of its values.
    in_order = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    buckets = counts.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(in_order), F.lit(0)), "_total": F.sum("_n").over(whole)}
    )
    # The (at most two) ranks of each probability, from 0, and those of them that lie in the bucket.
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(*_ranks(p)) for p in probabilities.values()]))
    )
    chosen = durable(
        buckets.select(
            F.col("_group").alias("_of"), F.col("_bucket").alias("_in"), "_before", "_total",
            F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))).alias("_ranks"),
        ).where(F.size("_ranks") > 0)
    )
    values = (
        valued.join(chosen, (F.col("_group") == F.col("_of")) & (F.col("_bucket") == F.col("_in")))
        .groupBy("_group", "_bucket", "_before", "_total", "_ranks", "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = sums_before(
        values.select(F.struct("_group", "_bucket").alias("_place"), "_before", "_total", "_ranks", "_v", "_n"),
        ["_place"], "_v", _fine_bucket(F.col("_v")), ["_n"], suffix="_below", unique=True,
    )
    first = F.col("_before") + F.col("_n_below")
    held = inside.select(
        "_place._group", "_total", "_v", F.explode("_ranks").alias("_rank"), first.alias("_first"), "_n"
    ).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    aggregates = []
    for name, p in probabilities.items():
        low, high = (at_rank(rank) for rank in _ranks(p))
        share = F.max(_position(p) - F.floor(_position(p)))
        # The form of the interpolation decides the last digit; this one is the usual lerp.
        aggregates.append((low + (high - low) * share).alias(name))
    found = held.groupBy("_group").agg(*aggregates)
    return found.select(*[F.col(f"_group.`{c}`").alias(c) for c in by], *probabilities)


def _position(p: float) -> Column:
    return (F.col("_total") - 1) * F.lit(float(p))


def _ranks(p: float) -> tuple[Column, Column]:
    return F.floor(_position(p)), F.ceil(_position(p))


def _fine_bucket(value: Column) -> Column:
    """Buckets within one of ``magnitude_bucket``: the same order, 256 times as fine."""
    size = F.floor(F.log2(F.abs(value)) * _STEPS_PER_OCTAVE * 256).cast("bigint") + (_OFFSET << 8)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of two tables with one line per group."""
    by = list(by)
    a = left.withColumn("_group", F.struct(*[F.col(c) for c in by], F.lit(0)))
    b = right.withColumn("_group", F.struct(*[F.col(c) for c in by], F.lit(0))).drop(*by)
    return a.join(b, "_group", how).drop("_group")
