"""Prefix sums per key that stay balanced when a key holds a large share of the rows.

A plain ordered window puts every row of a key into one task. Here each key is cut into
buckets of the ordering column. A window over bucket totals (one small row per bucket) gives
what lies before a bucket; that number enters the bucket as a row of its own, ahead of the
others, and a window over the bucket adds the rest. Neither window sees all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sums_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    values: Sequence[str],
    suffix: str = "_before",
    unique: bool = False,
) -> DataFrame:
    """Add, per value column, its sum over rows of the same keys with a smaller ``order``.

    ``bucket`` must not decrease when ``order`` grows; ``order`` is never NULL. Rows that share
    keys and ``order`` do not see each other: a whole-number ``order`` is required for that,
    unless keys and ``order`` are ``unique``. Missing history gives 0. With an empty ``suffix``
    the sums replace the values.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy("_bucket", *keys).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select("_bucket", *keys, *[F.sum(v).over(before).alias(v) for v in values])
    others = [c for c in df.columns if c not in {*keys, *values}]
    opening = opening.where(F.col(values[0]).isNotNull()).select(
        "_bucket", *keys,
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others],
        *values,
        F.lit(True).alias("_opening"),
    )
    rows = cut.withColumn("_opening", F.lit(False)).unionByName(opening)
    # The opening row has no order value and NULL sorts first; the bucket leads the sort.
    window = Window.partitionBy("_bucket", *keys).orderBy(F.col(order).asc_nulls_first())
    window = (
        window.rowsBetween(Window.unboundedPreceding, -1)
        if unique
        else window.rangeBetween(Window.unboundedPreceding, -1)
    )
    summed = rows.withColumns(
        {f"_{v}_sum": F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values}
    ).where(~F.col("_opening"))
    kept = [c for c in df.columns if suffix or c not in values]
    return summed.select(*kept, *[F.col(f"_{v}_sum").alias(f"{v}{suffix}") for v in values])


def numbered(df: DataFrame, groups: Sequence[str], mark: Column, ties: Sequence[str], name: str, bits: int = 12) -> DataFrame:
    """Number the rows of each group from 1 in the order of a hash, without a task that holds a group.

    ``mark`` is an evenly spread long. Rows are numbered inside buckets of its highest ``bits``; a window
    over the bucket counts (2**bits small rows for each group) gives what lies before a bucket. ``df`` is
    read twice and must give the same rows both times.
    """
    groups = list(groups)
    cut = df.withColumns({"_mark": mark, "_part": F.shiftright(mark, 64 - bits)})
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", *groups, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", *groups).orderBy("_mark", *ties))
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, ["_part", *groups])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_mark", "_inside", "_before")
    )
