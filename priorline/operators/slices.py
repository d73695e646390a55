"""Prefix aggregates per key over equi-depth slices of time.

Rows are dealt once to slices of time that hold about as many rows each, cut at quantiles of their times,
so no task owns a key. Inside a slice, plain windows of any number of groupings sort locally: a window's
keys together with the slice need no other shuffle. What lies before a slice comes in as carry rows, one
for each key that occurs there, made from totals per slice and key.

A second that holds more rows than a slice is dealt over several. Its rows do not see each other, so all
they need is the carry of their key; for later rows of the slice they come in as a carry of their own, at
that second. Rows that agree in every column are dealt together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.sources.durable import durable

#: Slices for each shuffle partition: slices are dealt to partitions by hash, more of them even the load.
SLICES_PER_PARTITION = 4
#: Before all times.
BEFORE = -(1 << 60)


@dataclass(frozen=True)
class Cut:
    """Lower bounds of the slices, and over how many parts the first second of a slice is dealt."""

    bounds: list[float]
    parts: dict[int, int]


def equal_counts(rows: DataFrame, value: str, slices: int) -> list:
    """The values at which ``slices`` parts of about equal size are cut; a frequent value comes several times."""
    wanted = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    return rows.agg(F.percentile_approx(value, wanted, F.lit(50 * slices)).alias("cuts")).first().cuts or []


def with_part(rows: DataFrame, value: str, bounds: Sequence[float], name: str) -> DataFrame:
    """rows with the number of the part that a value lies in; a bound is the first value of its part."""
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    splits = [-float("inf"), *bounds, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_value_double", outputCol="_part_double").transform(
        rows.withColumn("_value_double", F.col(value).cast("double"))
    )
    return placed.withColumn(name, F.col("_part_double").cast("int")).drop("_value_double", "_part_double")


def cut_times(rows: DataFrame, at: str, slices: int) -> Cut:
    """Bounds at the quantiles of ``at``; a time that is several quantiles is hot."""
    counts = Counter(equal_counts(rows, at, slices))
    return Cut(sorted(float(t) for t in counts), {t: n for t, n in counts.items() if n > 1})


def with_slices(rows: DataFrame, at: str, cut: Cut) -> DataFrame:
    """rows with _slice, _hot (at the hot first second of its slice) and _part, over which such rows are dealt."""
    placed = with_part(rows, at, cut.bounds, "_slice")
    parts = F.lit(1)
    if cut.parts:
        counts = F.create_map(*[F.lit(x) for t, n in cut.parts.items() for x in (int(t), n)])
        parts = F.coalesce(F.element_at(counts, F.col(at)), F.lit(1))
    hashable = [c for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), parts).cast("int")
    return placed.withColumns({"_hot": parts > 1, "_part": F.when(parts > 1, own).otherwise(0)})


def carry_rows(
    contributions: DataFrame, at: str, cut: Cut, groupings: Sequence[Sequence[str]], values: dict[str, list[Column]],
) -> DataFrame:
    """(_slice, _part, at, _carry, keys, values): what comes into each slice, one line per grouping and key.

    contributions: sliced rows with the keys, _leaves and measures named _m_...; values: for each output a
    column per grouping, a multiple of a measure by _leaves. _carry is the number of the grouping; the keys of
    other groupings are null.
    """
    names = sorted({key for keys in groupings for key in keys})
    kinds = {f.name: f.dataType for f in contributions.schema}
    lines = [
        F.struct(
            F.lit(g).alias("_carry"),
            *[(F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(k) for k in names],
            *[columns[g].alias(name) for name, columns in values.items()],
        )
        for g, keys in enumerate(groupings)
    ]
    # Summed per slice and all keys first: each grouping is made from these totals, not from the rows.
    measures = [c for c in contributions.columns if c.startswith("_m_")]
    finest = contributions.groupBy("_slice", "_hot", "_leaves", *names).agg(*[F.sum(m).alias(m) for m in measures])
    dealt = finest.select("_slice", "_hot", F.explode(F.array(*lines)).alias("line"))
    keys = F.struct("line._carry", *[f"line.{k}" for k in names])
    totals = durable(
        dealt.groupBy("_slice", "_hot", keys.alias("key")).agg(*[F.sum(f"line.{v}").alias(v) for v in values])
    )
    earlier = Window.partitionBy("key").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    before = totals.select("_slice", "_hot", "key", *[F.sum(v).over(earlier).alias(v) for v in values])
    # Every part of a hot second needs what lies before it; a slice's own carry is there once.
    parts = F.array(F.lit(0))
    if cut.parts:
        counts = F.create_map(*[F.lit(x) for t, n in cut.parts.items() for x in (cut.bounds.index(float(t)) + 1, n)])
        last = F.coalesce(F.element_at(counts, F.col("_slice")), F.lit(1)) - 1
        parts = F.when(F.col("_hot"), F.sequence(F.lit(0), last)).otherwise(parts)
    opening = before.select("_slice", F.explode(parts).alias("_part"), F.lit(BEFORE).alias(at), "key", *values).dropDuplicates(
        ["_slice", "_part", "key"]
    )
    first = F.array(*[F.lit(b) for b in [float(BEFORE), *cut.bounds]])
    seconds = totals.where("_hot").select(
        "_slice", F.lit(0).alias("_part"), F.get(first, F.col("_slice")).cast("long").alias(at), "key", *values
    )
    carried = opening.where(F.coalesce(*values).isNotNull()).unionByName(seconds) if cut.parts else opening.where(
        F.coalesce(*values).isNotNull()
    )
    return carried.select("_slice", "_part", at, "key.*", *values)
