"""Row-level rules: filters, labels, buckets, weights, bands, residuals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.contract import BASELINE_FALLBACKS, SEVERE_THRESHOLDS

# Upper bound (inclusive) and label of the delay buckets.
DELAY_BUCKETS = [
    (5, "0-5"), (10, "6-10"), (15, "11-15"), (30, "16-30"), (60, "31-60"),
    (120, "61-120"), (240, "121-240"), (None, "241+"),
]
# Sample weight by target range, both ends inclusive.
SAMPLE_WEIGHTS = [(0, 15, 1.0), (16, 30, 1.5), (31, 60, 2.0), (61, 120, 3.0), (121, 240, 4.0)]
# Lower bounds of the medium and the high risk band.
PLAIN_BANDS = (0.20, 0.50)
CALIBRATED_BANDS = (0.10, 0.30)
BANDS = ["low", "medium", "high"]


def number(value: Column) -> Column:
    """Numeric coercion: bad text and NaN become NULL."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def valid_incident(ts: Column, target: Column) -> Column:
    return ts.isNotNull() & target.isNotNull() & (target >= 0)


def within_model_range(ts: Column, target: Column, max_delay: float = 240) -> Column:
    return ts.isNotNull() & target.between(0, max_delay)


def severe_flags(target: Column, thresholds: Sequence[int] = (15, *SEVERE_THRESHOLDS)) -> dict:
    """0/1 flags; a missing target is not severe."""
    return {
        f"severe_delay_{t}": F.coalesce((target >= t).cast("int"), F.lit(0)) for t in thresholds
    }


def split_label(ts: Column, train_end: str, validation_year: int, test_year: int) -> Column:
    """train / validation / test; NULL for rows in no split (they still are history)."""
    after_train = F.lit(train_end).cast("date") + F.expr("interval 1 day")
    return (
        F.when(ts < after_train.cast("timestamp_ntz"), "train")
        .when(F.year(ts) == validation_year, "validation")
        .when(F.year(ts) == test_year, "test")
    )


def calibration_label(ts: Column, start: str, end: str) -> Column:
    """base before ``start``, calibration in [start, end), else NULL."""
    first = F.lit(start).cast("timestamp_ntz")
    last = F.lit(end).cast("timestamp_ntz")
    return F.when(ts < first, "base").when(ts < last, "calibration")


def check_calibration_split(train: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Label training rows base / calibration; refuse bad timestamps and an empty side."""
    if ts not in train.columns:
        raise ValueError(f"Training rows have no `{ts}` column.")
    labelled = train.withColumn("calibration_split", calibration_label(F.col(ts), start, end))
    bad, base, calibration = labelled.agg(
        F.count_if(F.col(ts).isNull()),
        F.count_if(F.col("calibration_split") == "base"),
        F.count_if(F.col("calibration_split") == "calibration"),
    ).first()
    if bad:
        raise ValueError(f"{bad} training rows have no usable timestamp.")
    if not base or not calibration:
        raise ValueError("Both the base and the calibration side need rows.")
    return labelled


def delay_bucket(value: Column) -> Column:
    result = None
    for upper, label in DELAY_BUCKETS[:-1]:
        step = value <= upper
        result = F.when(step, label) if result is None else result.when(step, label)
    return result.when(value.isNotNull(), DELAY_BUCKETS[-1][1])


def sample_weight(target: Column) -> Column:
    result = None
    for low, high, weight in SAMPLE_WEIGHTS:
        step = target.between(low, high)
        result = F.when(step, weight) if result is None else result.when(step, weight)
    return result.otherwise(F.lit(1.0))


def class_weight(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """negatives / positives per group; NULL when a group has no positives."""
    positives = F.count_if(F.col(label) == 1)
    negatives = F.count_if(F.col(label) == 0)
    return df.groupBy(*by).agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.try_divide(negatives, positives).alias("class_weight"),
    )


def risk_band(probability: Column, cuts: tuple[float, float] = CALIBRATED_BANDS) -> Column:
    medium, high = cuts
    return (
        F.when(probability.isNull(), None)
        .when(probability < medium, "low")
        .when(probability < high, "medium")
        .otherwise("high")
    )


def first_present(df: DataFrame, name: str, candidates: Iterable[str]) -> Column:
    """The first candidate column the table has, under a new name; NULL text when it has none."""
    source = next((c for c in candidates if c in df.columns), None)
    return (F.col(source) if source else F.lit(None).cast("string")).alias(name)


def with_residuals(
    df: DataFrame, actual: str = "actual", prediction: str = "prediction", baseline: str | None = None
) -> DataFrame:
    error = F.col(prediction) - F.col(actual)
    columns = {
        "error": error,
        "absolute_error": F.abs(error),
        "squared_error": error * error,
        "delay_bucket": delay_bucket(F.col(actual)),
    }
    if baseline is not None:
        columns["baseline_error"] = F.col(baseline) - F.col(actual)
        columns["baseline_absolute_error"] = F.abs(F.col(baseline) - F.col(actual))
    return df.withColumns(columns)


def with_fallbacks(
    base: Column, last_resort: Column | None = None, fallbacks: Sequence[str] = BASELINE_FALLBACKS
) -> Column:
    """Prediction with missing values filled from route, mode and global history."""
    chain = [base, *[F.col(name) for name in fallbacks]]
    return F.coalesce(*chain, *([last_resort] if last_resort is not None else []))
