"""Tables put side by side by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.sources.durable import durable

#: ``monotonically_increasing_id`` counts within a partition in its lower 33 bits.
_WITHIN = (1 << 33) - 1


def with_positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place from 0 in the given order, which must tell all rows apart.

    Rows are sorted in ranges. A range's number of rows is known once it is written, and the running sum
    over ranges (one small row each) is what comes before it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = durable(dealt.withColumn("_id", F.monotonically_increasing_id()))
    placed = written.withColumns({"_range": F.shiftright("_id", 33), "_within": F.col("_id").bitwiseAND(F.lit(_WITHIN))})
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # One row per range, of which there are as many as shuffle partitions.
    joined = placed.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_id", "_range", "_within", "_of", "_before")


def attach_predictions(
    rows: DataFrame, predictions: DataFrame, order: Sequence[str], prediction_order: Sequence[str],
    split: str = "split", columns: Sequence[str] = ("prediction",),
) -> DataFrame:
    """rows with the prediction columns of the row at the same place of the other table.

    Both tables are checked first: equal numbers of rows, and the same split at each place.
    """
    left = with_positions(rows, order, "_place")
    right = with_positions(predictions.select(*dict.fromkeys([*prediction_order, split, *columns])), prediction_order, "_other")
    sizes = left.count(), right.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"Predictions have {sizes[1]} rows, but there are {sizes[0]} rows to attach them to.")
    theirs = right.select("_other", F.col(split).alias("_split"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = durable(left.join(theirs, F.col("_place") == F.col("_other")))
    differing = joined.where(~F.col(split).eqNullSafe(F.col("_split"))).count()
    if differing:
        raise ValueError(f"Predictions are of another split than their row at {differing} places.")
    return joined.select(*rows.columns, *[F.col(f"_p_{c}").alias(c) for c in columns])
