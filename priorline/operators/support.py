"""How much history candidate groupings have, and how well their means would predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.contract import BASELINE_FALLBACKS, SEVERE_THRESHOLDS, SUPPORT_THRESHOLDS
from priorline.operators.history import Feature, Grouping, with_history
from priorline.operators.quantiles import exact_quantiles, join_groups
from priorline.sources.durable import durable

EVALUATED = ("validation", "test")

SUPPORT_GROUPINGS = [
    ("route",), ("incident",), ("mode",), ("route", "incident"), ("mode", "incident"),
    ("route", "direction"), ("route", "hour"), ("route", "incident", "hour"), ("location",),
    ("location", "incident"), ("location", "hour"),
]
CANDIDATE_GROUPINGS = {
    "prior_route_incident_mean_delay": ("route", "incident"),
    "prior_mode_incident_mean_delay": ("mode", "incident"),
    "prior_route_direction_mean_delay": ("route", "direction"),
    "prior_location_mean_delay": ("location",),
    "prior_location_incident_mean_delay": ("location", "incident"),
    "prior_route_incident_hour_mean_delay": ("route", "incident", "hour"),
}


def _label(keys: Sequence[str]) -> str:
    return " + ".join(keys)


def support_by_grouping(df: DataFrame, groupings=tuple(SUPPORT_GROUPINGS)) -> DataFrame:
    """Share of validation and test rows with enough strictly earlier rows of the same keys."""
    shapes = [Grouping(_label(keys), tuple(keys)) for keys in groupings]
    features = [Feature(f"n_{i}", g.name, "count") for i, g in enumerate(shapes)]
    # Read by each pass over the counts.
    counted = durable(
        with_history(df, features, shapes, asked=F.col("split").isin(*EVALUATED)).select("split", *[f.name for f in features])
    )
    lines = F.array(
        *[
            F.struct(F.lit(g.name).alias("grouping"), F.col(f"n_{i}").alias("prior_count"))
            for i, g in enumerate(shapes)
        ]
    )
    long = counted.select(F.inline(lines))
    main = long.groupBy("grouping").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[
            (F.count_if(F.col("prior_count") >= n) / F.count(F.lit(1)) * 100).alias(f"pct_with_prior_{n}")
            for n in SUPPORT_THRESHOLDS
        ],
        F.max("prior_count").alias("max_prior_count"),
    )
    spread = exact_quantiles(
        long, ["grouping"], "prior_count",
        {"median_prior_count": 0.5, "p25_prior_count": 0.25, "p75_prior_count": 0.75},
    )
    return join_groups(main, spread, ["grouping"])


def candidate_scores(df: DataFrame, candidates=CANDIDATE_GROUPINGS) -> DataFrame:
    """Coverage and error of candidate prior means, alone and behind the fallback chain."""
    shapes = [Grouping(_label(keys), tuple(keys)) for keys in candidates.values()]
    shapes += [Grouping("_route", ("route",)), Grouping("_mode", ("mode",)), Grouping("_global", ())]
    features = [Feature(name, _label(keys), "mean") for name, keys in candidates.items()]
    features += [
        Feature(name, shape, "mean") for name, shape in zip(BASELINE_FALLBACKS, ("_route", "_mode", "_global"))
    ]
    rows = with_history(df, features, shapes, asked=F.col("split").isin(*EVALUATED))
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature_name"), F.lit(_label(keys)).alias("grouping"), F.col(name).alias("_own")
            )
            for name, keys in candidates.items()
        ]
    )
    long = rows.select("min_delay", *BASELINE_FALLBACKS, F.inline(lines))
    filled = F.coalesce("_own", *BASELINE_FALLBACKS)
    return long.groupBy("feature_name", "grouping").agg(
        F.count("min_delay").alias("row_count"),
        (F.count("_own") / F.count(F.lit(1)) * 100).alias("coverage_percent"),
        F.avg(F.abs(F.col("_own") - F.col("min_delay"))).alias("mae_where_available"),
        F.avg(F.abs(filled - F.col("min_delay"))).alias("fallback_mae"),
    )


def rolling_opportunity(df: DataFrame) -> DataFrame:
    """Coverage and score of 30-day means (error) and severe rates (squared error)."""
    shapes = [
        Grouping("route", ("route",), 30), Grouping("incident", ("incident",), 30),
        Grouping("route + hour", ("route", "hour"), 30),
    ]
    specs = [
        ("prior_route_30d_mean_delay", "route", "rolling_mean"),
        ("prior_incident_30d_mean_delay", "incident", "rolling_mean"),
        ("prior_route_hour_30d_mean_delay", "route + hour", "rolling_mean"),
    ]
    for t in SEVERE_THRESHOLDS:
        specs += [
            (f"prior_route_30d_severe_rate_{t}", "route", f"rate_{t}"),
            (f"prior_incident_30d_severe_rate_{t}", "incident", f"rate_{t}"),
        ]
    rows = with_history(df, [Feature(*s) for s in specs], shapes, asked=F.col("split").isin(*EVALUATED))

    def line(name: str, grouping: str, kind: str):
        rate = kind.startswith("rate")
        actual = (F.col("min_delay") >= int(kind[-2:])).cast("double") if rate else F.col("min_delay")
        gap = F.col(name) - actual
        return F.struct(
            F.lit(name).alias("feature_name"),
            F.lit("rolling_rate" if rate else "rolling_mean").alias("feature_type"),
            F.lit(grouping).alias("grouping"),
            F.lit(f"severe_{kind[-2:]}" if rate else "regression").alias("target"),
            F.col(name).alias("_value"),
            (F.lit(None).cast("double") if rate else F.abs(gap)).alias("_abs"),
            (gap * gap if rate else F.lit(None).cast("double")).alias("_square"),
        )

    long = rows.select(F.inline(F.array(*[line(*s) for s in specs])))
    return long.groupBy("feature_name", "feature_type", "grouping", "target").agg(
        (F.count("_value") / F.count(F.lit(1)) * 100).alias("coverage_percent"),
        (F.count_if(F.col("_value").isNull()) / F.count(F.lit(1)) * 100).alias("missing_fallback_rate"),
        F.avg("_abs").alias("mae_where_available"),
        F.avg("_square").alias("brier_score_where_available"),
    )
