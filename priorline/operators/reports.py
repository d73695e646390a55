"""Grouped reports over incidents and over row-level predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.contract import BASELINES, HIGH_DELAY_THRESHOLDS, SEVERE_THRESHOLDS
from priorline.functions.rows import with_fallbacks
from priorline.operators.metrics import extended_metrics, fit_measures
from priorline.operators.quantiles import join_groups
from priorline.sources.durable import durable

TARGET_THRESHOLDS = [0, 60, 120, 240, 480, 1440]
TARGET_QUANTILES = [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999, 1.0]
ERROR_GROUPS = [
    "mode", "route", "direction", "incident", "location", "hour", "month", "delay_bucket",
]
SEVERE_GROUPS = ["mode", "route", "direction", "incident", "location", "hour"]
LARGE_GROUPS = ("route", "location")
MIN_GROUP_SIZE = 100
OUTLIER_COLUMNS = [
    "mode", "ts", "date", "route", "direction", "location", "incident", "min_delay", "min_gap",
    "vehicle", "source_file", "source_sheet",
]
WORST_COLUMNS = [
    "split", "mode", "ts", "route", "direction", "incident", "location", "actual", "prediction",
    "error", "absolute_error", "delay_bucket",
]


# --- baselines ------------------------------------------------------------------------------


def baseline_grid(
    df: DataFrame, baselines: Sequence[str] = BASELINES, target: str = "min_delay"
) -> DataFrame:
    """Every baseline on validation and test, as is and (where values are missing) filled.

    One aggregation over the rows: each row contributes one line per baseline and variant.
    """
    train_mean = df.where("split = 'train'").agg(F.avg(target)).first()[0]
    last = F.lit(train_mean).cast("double")
    lines = []
    for name in baselines:
        for filled in (False, True):
            prediction = with_fallbacks(F.col(name), last) if filled else F.col(name)
            lines.append(
                F.struct(
                    F.lit(name).alias("baseline"),
                    F.lit(f"{name}_filled" if filled else name).alias("evaluation_name"),
                    F.lit(filled).alias("filled"),
                    prediction.alias("prediction"),
                    F.col(name).isNull().alias("_missing"),
                )
            )
    rows = df.where(F.col("split").isin("validation", "test")).select(
        "split", F.col(target).alias("actual"), F.inline(F.array(*lines))
    )
    known = F.col("actual").isNotNull()
    measures = fit_measures()
    out = rows.groupBy("baseline", "evaluation_name", "split", "filled").agg(
        *[m.alias(n) for n, m in measures.items()],
        F.count(F.col("actual") + F.col("prediction")).alias("rows_evaluated"),
        F.count_if(known & F.col("_missing")).alias("missing_predictions_before_fallback"),
        F.count("actual").alias("_known"),
    )
    share = F.try_divide(F.col("missing_predictions_before_fallback"), F.col("_known")) * 100
    return (
        out.withColumn(
            "missing_predictions_before_fallback_percent", F.coalesce(share, F.lit(0.0))
        )
        .where(~F.col("filled") | (F.col("missing_predictions_before_fallback") > 0))
        .drop("_known")
    )


def chosen_baseline(df: DataFrame, baseline: str, filled: bool, train_mean: float | None) -> Column:
    """Prediction column of a selected baseline."""
    return with_fallbacks(F.col(baseline), F.lit(train_mean).cast("double")) if filled else F.col(baseline)


# --- residual reports -----------------------------------------------------------------------


def _long(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One line per row and grouping, the group value as text."""
    lines = F.array(
        *[
            F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("group_value"))
            for g in groups
        ]
    )
    return df.select(*columns, F.inline(lines))


def error_by_group(df: DataFrame, group: str, min_rows: int | None = None) -> DataFrame:
    out = extended_metrics(
        df, ["split", group], {"median_absolute_error": 0.5}, measures=("mae", "rmse")
    )
    return out.where(F.col("row_count") >= min_rows) if min_rows else out


def error_contribution(
    df: DataFrame, groups: Sequence[str] = ERROR_GROUPS, min_rows: int = MIN_GROUP_SIZE
) -> DataFrame:
    """All groupings in one table with each group's share of the absolute error."""
    columns = ["split", "actual", "prediction", "error", "absolute_error"]
    # Stored as rows, not as a line for each row and grouping.
    rows = _long(durable(df.select(*dict.fromkeys([*columns, *groups]))), groups, columns)
    out = extended_metrics(
        rows, ["split", "group_column", "group_value"],
        {"median_absolute_error": 0.5, "p90_absolute_error": 0.9}, measures=("mae", "rmse"), stored=True,
    )
    small = F.col("group_column").isin(*LARGE_GROUPS) & (F.col("row_count") < min_rows)
    return out.where(~small).withColumn(
        "total_error_contribution", F.col("row_count").cast("double") * F.col("mae")
    )


def ranked_contribution(table: DataFrame) -> DataFrame:
    return table.orderBy(
        "split", "group_column", F.desc("total_error_contribution"), F.asc("group_value")
    )


def high_delay(
    df: DataFrame, by: Sequence[str] = ("split",), thresholds: Sequence[int] = HIGH_DELAY_THRESHOLDS
) -> DataFrame:
    """How long delays are predicted; each row counts for every threshold it reaches."""
    df = durable(df.select(*by, "actual", "prediction", "error", "absolute_error"))  # read for the delays and for all rows
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("actual") >= t)
    rows = df.select(
        *by, "actual", "prediction", "error", "absolute_error", F.explode(reached).alias("threshold_minutes")
    )
    under = F.col("prediction") < F.col("actual")
    measured = rows.groupBy(*by, "threshold_minutes").agg(
        F.count(F.lit(1)).alias("actual_high_delay_rows"),
        F.avg("absolute_error").alias("mae_high_delay"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse_high_delay"),
        F.avg("prediction").alias("mean_prediction_high_delay"),
        F.avg("actual").alias("mean_actual_high_delay"),
        F.avg("error").alias("mean_error_high_delay"),
        (F.count_if(under) / F.count(F.lit(1)) * 100).alias("underpredicted_high_delay_percent"),
        F.avg(F.when(under, F.col("actual") - F.col("prediction"))).alias("average_underprediction_amount"),
    )
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    grid = totals.withColumn("threshold_minutes", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    out = join_groups(grid, measured, [*by, "threshold_minutes"])
    out = out.withColumn("actual_high_delay_rows", F.coalesce("actual_high_delay_rows", F.lit(0)))
    return out.withColumn(
        "actual_high_delay_rate", F.try_divide(F.col("actual_high_delay_rows"), F.col("_rows"))
    ).drop("_rows")


def severe_by_group(
    df: DataFrame, probability: dict[int, str], flag: dict[int, str] | None = None,
    groups: Sequence[str] = SEVERE_GROUPS, min_rows: int = MIN_GROUP_SIZE,
) -> DataFrame:
    """Actual rate, mean probability and missed share per threshold and grouping, in one pass."""
    flag = flag or {}
    lines = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold_minutes"),
                F.coalesce((F.col("actual") >= t).cast("int"), F.lit(0)).alias("_severe"),
                F.col(probability[t]).alias("_p"),
                (F.col(flag[t]) if t in flag else F.lit(None).cast("int")).alias("_flag"),
            )
            for t in SEVERE_THRESHOLDS
        ]
    )
    rows = _long(df, groups, ["split", *{*probability.values(), *flag.values()}, "actual"])
    rows = rows.select("split", "group_column", "group_value", F.inline(lines))
    severe = F.col("_severe") == 1
    out = rows.groupBy("split", "threshold_minutes", "group_column", "group_value").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("_severe").alias("actual_severe_delay_rate"),
        F.avg("_p").alias("mean_predicted_severe_delay_probability"),
        F.try_divide(
            F.count_if(severe & (F.coalesce("_flag", F.lit(0)) != 1)), F.count_if(severe)
        ).alias("_missed"),
        F.count("_flag").alias("_flags"),
    )
    small = F.col("group_column").isin(*LARGE_GROUPS) & (F.col("row_count") < min_rows)
    return (
        out.where(~small)
        .withColumns(
            {
                "probability_calibration_gap": F.col("mean_predicted_severe_delay_probability")
                - F.col("actual_severe_delay_rate"),
                "false_negative_rate": F.when(F.col("_flags") > 0, F.col("_missed")),
            }
        )
        .drop("_missed", "_flags")
    )


def worst_predictions(df: DataFrame, n: int = 100, columns: Sequence[str] = WORST_COLUMNS) -> DataFrame:
    """The n largest absolute errors per split; equal errors are ordered by all columns."""
    kept = df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    order = [F.desc("absolute_error"), *[F.col(c) for c in columns if c not in ("split", "absolute_error")]]
    place = F.row_number().over(Window.partitionBy("split").orderBy(*order))
    return kept.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


# --- target diagnostics ---------------------------------------------------------------------


def target_summary(df: DataFrame, target: str = "min_delay", by: Sequence[str] = ()) -> DataFrame:
    """Count, time range, moments and quantiles of the target.

    Delays are whole minutes with a few hundred distinct values, which is what the built-in
    percentile buffers; for continuous targets use ``exact_quantiles``.
    """
    probabilities = F.array(*[F.lit(float(q)) for q in TARGET_QUANTILES])
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.count(target).alias("target_count"),
        F.avg(target).alias("target_mean"),
        F.stddev_samp(target).alias("target_std"),
        F.percentile(target, probabilities).alias("_q"),
    )
    names = ["q" + str(q).replace(".", "_") for q in TARGET_QUANTILES]
    return out.select(
        "*", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]
    ).drop("_q")


def rows_by_mode(df: DataFrame) -> DataFrame:
    return df.groupBy("mode").agg(F.count(F.lit(1)).alias("row_count"))


def threshold_counts(
    df: DataFrame, target: str = "min_delay", thresholds: Sequence[int] = TARGET_THRESHOLDS
) -> DataFrame:
    """Rows at or beyond thresholds, overall and per mode (a missing mode is a mode of its own)."""
    counts = [
        F.count_if(F.col(target) == 0 if t == 0 else F.col(target) > t).alias(f"_c{t}") for t in thresholds
    ]
    wide = df.groupingSets([[], [F.col("mode")]], "mode").agg(
        F.grouping("mode").alias("_all"), F.count(F.lit(1)).alias("denominator"), *counts
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold_minutes"),
                F.lit("min_delay == 0" if t == 0 else f"min_delay > {t}").alias("condition"),
                F.col(f"_c{t}").alias("count"),
            )
            for t in thresholds
        ]
    )
    long = wide.select("_all", "mode", "denominator", F.inline(lines))
    share = F.try_divide(F.col("count"), F.col("denominator")) * 100
    return long.select(
        F.when(F.col("_all") == 1, "overall").otherwise("mode").alias("scope"),
        F.when(F.col("_all") == 1, "all").otherwise(F.coalesce("mode", F.lit("<NA>"))).alias("mode"),
        "threshold_minutes", "condition", "count",
        F.coalesce(share, F.lit(0.0)).alias("percentage"), "denominator",
    )


def top_outliers(df: DataFrame, n: int = 50, target: str = "min_delay") -> DataFrame:
    """The n largest targets; equal targets are ordered by all columns."""
    kept = df.select(
        *[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in OUTLIER_COLUMNS]
    )
    others = [F.col(c) for c in OUTLIER_COLUMNS if c != target]
    return kept.orderBy(F.desc(target), *others).limit(n)


# --- modeling table metadata ----------------------------------------------------------------


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and time range per split and in all (rows in no split count in the total)."""
    return df.groupingSets([[], [F.col("split")]], "split").agg(
        F.grouping("split").alias("_all"),
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
    ).where("_all = 1 or split is not null").select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"),
        "row_count", "min_ts", "max_ts",
    )
