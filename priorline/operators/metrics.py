"""Regression and probability metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions.rows import BANDS, CALIBRATED_BANDS, risk_band
from priorline.operators.prefix import sums_before
from priorline.operators.quantiles import exact_quantiles, join_groups
from priorline.operators.slices import SLICES_PER_PARTITION, equal_counts, with_part
from priorline.sources.durable import durable

# The operating cutoffs tried.
PLAIN_CUTOFFS = [0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
CALIBRATION_CUTOFFS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
# Order in which calibration methods and experiments win ties.
METHOD_ORDER = {"sigmoid": 0, "isotonic": 1, "uncalibrated": 2}
EXPERIMENT_ORDER = ["combined_fixed", "combined_weighted", "combined_log_target", "mode_specific"]

ERROR_QUANTILES = {
    "median_absolute_error": 0.5, "p90_absolute_error": 0.9, "p95_absolute_error": 0.95,
}
_EPS = 2.220446049250313e-16


def fit_measures(actual: str = "actual", prediction: str = "prediction") -> dict[str, Column]:
    """MAE, RMSE and R2 over rows that have both values; NULL without any."""
    both = F.col(actual).isNotNull() & F.col(prediction).isNotNull()
    y = F.when(both, F.col(actual))
    error = F.col(prediction) - F.col(actual)
    spread = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.lit(1.0) - F.sum(error * error) / F.nullif(spread, F.lit(0.0)),
    }


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), actual: str = "actual", prediction: str = "prediction"
) -> DataFrame:
    measures = fit_measures(actual, prediction)
    rows = F.count(F.col(actual) + F.col(prediction)).alias("rows_evaluated")
    return df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()], rows)


def extended_metrics(
    df: DataFrame,
    by: Sequence[str],
    quantiles: Mapping[str, float] = ERROR_QUANTILES,
    measures: Sequence[str] = ("mae", "rmse", "r2"),
    baseline: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Metrics of rows with actual, prediction, error, absolute_error: plus spread and size.

    The rows are written once, for each pass reads them, unless they come from a ``stored`` table.
    """
    wanted = fit_measures()
    columns = ["actual", "prediction", "error", "absolute_error", *([baseline] if baseline else [])]
    df = df.select(*dict.fromkeys([*by, *columns]))
    df = df if stored else durable(df)
    aggregates = [wanted[m].alias(m) for m in measures]
    aggregates += [F.avg("error").alias("mean_error"), F.count(F.lit(1)).alias("row_count")]
    if baseline is not None:
        other = fit_measures("actual", baseline)
        aggregates += [m.alias(f"baseline_{n}") for n, m in other.items()]
        aggregates.append(F.count(baseline).alias("baseline_rows_evaluated"))
    main = df.groupBy(*by).agg(*aggregates)
    return join_groups(main, exact_quantiles(df, by, "absolute_error", quantiles), by)


# --- binary metrics -------------------------------------------------------------------------


def rank_metrics(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (ties merged) per group.

    Works on the histogram of distinct scores. Its cumulative sums are taken in slices that hold about as
    many of them each, so a group with any number of scores, however close, is spread over tasks. NULL
    unless both classes occur.
    """
    by = list(by)
    histogram = durable(
        df.where(F.col(score).isNotNull())
        .groupBy(*by, (-F.col(score)).alias("_order"))
        .agg(
            F.count_if(F.col(label) == 1).alias("_pos"),
            F.count_if(F.col(label) != 1).alias("_neg"),
        )
    )
    slices = SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(equal_counts(histogram, "_order", slices)))
    sliced = with_part(histogram, "_order", bounds, "_slice")
    curve = sums_before(sliced, by, "_order", F.col("_slice"), ["_pos", "_neg"], unique=True)
    hits = F.col("_pos_before") + F.col("_pos")
    shown = hits + F.col("_neg_before") + F.col("_neg")
    pairs = F.sum(F.col("_neg") * (F.col("_pos_before") + F.col("_pos") / F.lit(2.0)))
    precision = F.sum(F.col("_pos") * (hits / shown))
    positives, negatives = F.sum("_pos"), F.sum("_neg")
    both = (positives > 0) & (negatives > 0)
    return curve.groupBy(*by).agg(
        F.when(both, pairs / (positives.cast("double") * negatives)).alias("roc_auc"),
        F.when(both, precision / positives).alias("pr_auc"),
    )


def probability_losses(label: str, score: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(score)
    clipped = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1.0 - _EPS))
    return {
        "positive_rate": F.avg(y.cast("double")),
        "log_loss": F.avg(-F.when(y == 1, F.ln(clipped)).otherwise(F.ln(F.lit(1.0) - clipped))),
        "brier_score": F.avg((p - y) * (p - y)),
    }


def confusion_ratios(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 when undefined) and accuracy from the four counts."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
            "f1": F.coalesce(F.try_divide(tp * 2, tp * 2 + fp + fn), zero),
            "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
            "row_count": tp + tn + fp + fn,
        }
    )


def cutoff_table(
    df: DataFrame, by: Sequence[str], label: str, score: str,
    cutoffs: Sequence[float] = PLAIN_CUTOFFS, with_ranks: bool = True,
) -> DataFrame:
    """All binary metrics at each cutoff; rows are read once, whatever the number of cutoffs."""
    by = list(by)
    if with_ranks:
        df = durable(df.select(*dict.fromkeys([*by, label, score])))  # read for the counts and for the ranks
    positive, negative = F.col(label) == 1, F.col(label) != 1
    counts = [F.count_if(positive).alias("_p"), F.count_if(negative).alias("_n")]
    for i, cutoff in enumerate(cutoffs):
        counts.append(F.count_if(positive & (F.col(score) >= cutoff)).alias(f"_tp{i}"))
        counts.append(F.count_if(negative & (F.col(score) >= cutoff)).alias(f"_fp{i}"))
    losses = [m.alias(n) for n, m in probability_losses(label, score).items()]
    wide = df.groupBy(*by).agg(*losses, *counts)
    lines = F.array(
        *[
            F.struct(
                F.lit(float(cutoff)).alias("probability_cutoff"),
                F.col(f"_tp{i}").alias("true_positives"),
                F.col(f"_fp{i}").alias("false_positives"),
                (F.col("_n") - F.col(f"_fp{i}")).alias("true_negatives"),
                (F.col("_p") - F.col(f"_tp{i}")).alias("false_negatives"),
            )
            for i, cutoff in enumerate(cutoffs)
        ]
    )
    table = confusion_ratios(
        wide.select(*by, "positive_rate", "log_loss", "brier_score", F.inline(lines))
    )
    if not with_ranks:
        return table
    return join_groups(table, rank_metrics(df, by, label, score), by)


def _bin_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def reliability_bins(
    df: DataFrame, by: Sequence[str], label: str, score: str, bins: int = 10
) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins stay with NULL measures.

    Edges are compared as the doubles ``i * (1 / bins)``, so 0.3 lies below the fourth edge.
    """
    by = list(by)
    edges = _bin_edges(bins)
    p = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    index = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        index = F.when(p < edges[i + 1], F.lit(i)).otherwise(index)
    # Small, and read for the groups and for their bins: the rows behind it are gone through once.
    filled = durable(
        df.where(F.col(score).isNotNull()).groupBy(*by, index.alias("_bin")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg(p).alias("mean_predicted_probability"),
            F.avg(F.col(label).cast("double")).alias("actual_severe_delay_rate"),
        )
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("_bin"), F.lit(edges[i]).alias("bin_lower"), F.lit(edges[i + 1]).alias("bin_upper")
            )
            for i in range(bins)
        ]
    )
    groups = filled.select(*by).distinct() if by else filled.groupBy().agg(F.count(F.lit(1)).alias("_any"))
    grid = groups.select(*by, F.inline(lines))
    out = join_groups(grid, filled, [*by, "_bin"])
    return out.drop("_bin").withColumns(
        {
            "row_count": F.coalesce("row_count", F.lit(0)),
            "absolute_calibration_error": F.abs(
                F.col("mean_predicted_probability") - F.col("actual_severe_delay_rate")
            ),
        }
    )


def expected_calibration_error(
    df: DataFrame, by: Sequence[str], label: str, score: str, bins: int = 10
) -> DataFrame:
    weighted = F.sum(F.col("row_count") * F.coalesce("absolute_calibration_error", F.lit(0.0)))
    return reliability_bins(df, by, label, score, bins).groupBy(*by).agg(
        F.try_divide(weighted, F.sum("row_count")).alias("expected_calibration_error")
    )


def band_summary(
    df: DataFrame, by: Sequence[str], label: str, score: str, cuts=CALIBRATED_BANDS
) -> DataFrame:
    """Low, medium and high for every group, also when a band is empty."""
    by = list(by)
    filled = durable(
        df.groupBy(*by, risk_band(F.col(score), cuts).alias("risk_band")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg(F.col(label).cast("double")).alias("actual_severe_delay_rate"),
            F.avg(score).alias("mean_predicted_probability"),
        )
    )
    groups = filled.select(*by).distinct() if by else filled.groupBy().agg(F.count(F.lit(1)).alias("_any"))
    grid = groups.select(*by, F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("risk_band"))
    out = join_groups(grid, filled, [*by, "risk_band"])
    return out.withColumn("row_count", F.coalesce("row_count", F.lit(0)))


# --- selection on small metric tables -------------------------------------------------------


def _first_line(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def pick_cutoff(table: DataFrame, by: Sequence[str], min_recall: float = 0.70) -> DataFrame:
    """Cutoffs that reach the recall first, then F1, recall and the higher cutoff."""
    met = F.col("recall") >= min_recall
    order = [met.desc(), F.desc("f1"), F.desc("recall"), F.desc("probability_cutoff")]
    return _first_line(table, by, order).select(
        *by, "probability_cutoff", met.alias("met_min_recall"),
        F.col("recall").alias("validation_recall"), F.col("f1").alias("validation_f1"),
    )


def pick_calibration(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier within 2 % of the best, then ECE within 2 %, then PR-AUC within 2 %, then order."""
    group = Window.partitionBy(*by)
    out = metrics
    for name in ("brier_score", "expected_calibration_error"):
        best = F.min(name).over(group)
        limit = F.when(best == 0, best).otherwise(best * 1.02)
        out = out.withColumn("_limit", limit).where(F.col(name) <= F.col("_limit")).drop("_limit")
    best = F.max("pr_auc").over(group)
    slack = F.greatest(F.lit(1e-12), F.abs(best) * 0.02)
    out = out.withColumn("_limit", best - slack).where(F.col("pr_auc") >= F.col("_limit")).drop("_limit")
    rank = F.coalesce(
        *[F.when(F.col("calibration_method") == m, F.lit(r)) for m, r in METHOD_ORDER.items()]
    )
    order = [rank, F.col("brier_score"), F.col("expected_calibration_error"), F.desc("pr_auc")]
    return _first_line(out, by, order)


def pick_experiment(
    metrics: DataFrame, high_delay: DataFrame, by_mode: DataFrame, metric: str = "mae",
    order: Sequence[str] = EXPERIMENT_ORDER,
) -> DataFrame:
    """Validation metric within 1 % of the best, then delays of 30 and more, streetcars, simplicity."""
    validation = metrics.where((F.col("split") == "validation") & F.col(metric).isNotNull())
    everything = Window.partitionBy("split")
    smaller_is_better = metric != "r2"
    best = (F.min(metric) if smaller_is_better else F.max(metric)).over(everything)
    close = (
        F.col(metric) <= F.col("_best") * 1.01 if smaller_is_better else F.col(metric) >= F.col("_best") * 0.99
    )
    near = validation.withColumn("_best", best).where(close)
    high = high_delay.where("split = 'validation' and threshold_minutes = 30").select(
        "experiment", F.col("mae_high_delay").alias("high_delay_mae")
    )
    cars = by_mode.where("split = 'validation' and mode = 'streetcar'").select(
        "experiment", F.col("mae").alias("streetcar_mae")
    )
    near = near.join(high, "experiment", "left").join(cars, "experiment", "left")
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("experiment"))
    last = F.col(metric).asc() if smaller_is_better else F.col(metric).desc()
    return _first_line(
        near,
        ["split"],
        [
            F.col("high_delay_mae").asc_nulls_last(),
            F.col("streetcar_mae").asc_nulls_last(),
            F.nullif(rank, F.lit(0)).asc_nulls_last(),
            last,
        ],
    ).withColumnRenamed("_best", "best_metric_value")


def pick_baseline(metrics: DataFrame) -> DataFrame:
    """Validation only; the filled version of a baseline is preferred; then MAE, RMSE, R2."""
    usable = _first_line(metrics.where("split = 'validation'"), ["baseline"], [F.desc("filled")])
    usable = usable.where(F.col("mae").isNotNull() & F.col("rmse").isNotNull())
    return _first_line(usable, ["split"], [F.asc("mae"), F.asc("rmse"), F.desc("r2"), F.asc("baseline")])


def with_baseline_comparison(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Model metrics with the baseline's MAE per split and the improvement in percent."""
    other = baseline.select(
        "split", F.col("evaluation_name").alias("baseline_name"), F.col("mae").alias("baseline_mae")
    )
    gain = F.col("baseline_mae") - F.col("mae")
    return metrics.join(other, "split", "left").withColumns(
        {
            "mae_improvement": gain,
            "mae_improvement_percent": F.try_divide(gain, F.nullif("baseline_mae", F.lit(0.0))) * 100,
        }
    )
