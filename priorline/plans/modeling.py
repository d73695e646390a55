"""Cleaned incidents to the modeling table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.contract import ROLES, Roles
from priorline.functions.calendar import calendar_parts, cyclic_parts, holiday_coercion
from priorline.functions.rows import number, severe_flags, split_label, within_model_range
from priorline.functions.text import normalize_categories
from priorline.operators.history import add_history_features


def modeling_rows(df: DataFrame, max_delay: float = 240) -> DataFrame:
    """Rows with a timestamp and a target in range; the cleaned table stays as it is."""
    typed = df.withColumn("min_delay", number(F.col("min_delay")))
    return typed.where(within_model_range(F.col("ts"), F.col("min_delay"), max_delay))


def add_time_features(df: DataFrame) -> DataFrame:
    holiday = holiday_coercion(F.col("is_holiday") if "is_holiday" in df.columns else None)
    df = df.withColumns(calendar_parts(F.col("ts"))).withColumn("is_holiday", holiday)
    return df.withColumns(cyclic_parts(F.col("hour"), F.col("day_of_year")))


def build_modeling_table(
    cleaned: DataFrame, max_delay: float = 240, roles: Roles = ROLES, strategy: str | None = None
) -> DataFrame:
    """Normalize, filter, add time features, history and the secondary target, in this order.

    History runs over the full timeline of the filtered rows, before any split.
    """
    df = modeling_rows(normalize_categories(cleaned), max_delay)
    df = add_history_features(add_time_features(df), roles=roles, strategy=strategy)
    return df.withColumns(severe_flags(F.col("min_delay"), (15,)))


def add_split(
    df: DataFrame, train_end: str = "2022-12-31", validation_year: int = 2023, test_year: int = 2024
) -> DataFrame:
    return df.withColumn("split", split_label(F.col("ts"), train_end, validation_year, test_year))
