"""The given tables in the shape of incidents (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions.calendar import calendar_parts, cyclic_parts, holiday_coercion, is_holiday
from priorline.functions.rows import split_label, within_model_range
from priorline.functions.text import normalize_categories

TRAIN_END, VALIDATION_YEAR, TEST_YEAR = "1999-12-31", 2000, 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_incidents(spark: SparkSession, sf_dir: str, with_location: bool = True) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    supp = F.col("l_suppkey").cast("string")
    number = F.col("l_linenumber")
    incident = [
        "Mech", "Ops", "Securitty", "delay", "Late Garage", "Rail/Switches", "EMS", "clean-up",
        "Fallen pole", None, "Overhead wire", "Diversion",
    ]
    direction = ["N/B", "eb", "South", "W/B/E/B", "Mechanical", None, "Bothways"]
    out = line.select(
        (
            F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
        ).alias("ts"),
        F.when(F.col("l_linestatus") == "O", " Bus ").otherwise("streetcar").alias("mode"),
        F.when(number % 4 == 0, F.concat(supp, F.lit(".0")))
        .when(number % 4 == 1, F.concat(F.lit("  "), supp, F.lit(" ")))
        .when(number % 4 == 2, F.concat(supp, F.lit("a")))
        .otherwise(supp)
        .alias("route"),
        F.element_at(F.array(*[F.lit(d) for d in direction]), number).alias("direction"),
        F.element_at(
            F.array(*[F.lit(i) for i in incident]), (F.col("l_partkey") % 12 + 1).cast("int")
        ).alias("incident"),
        F.floor(F.col("l_quantity") * F.col("l_quantity") / 10).cast("double").alias("min_delay"),
        F.col("l_tax").alias("min_gap"),
        supp.alias("vehicle"),
        "l_partkey",
        "l_suppkey",
    )
    if not with_location:
        return out.withColumn("location", F.lit(None).cast("string")).drop("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    kind = F.col("l_suppkey") % 5
    location = (
        F.when(kind == 0, F.concat("p_name", F.lit(" Stn")))
        .when(kind == 1, F.concat(F.lit("Queen & "), F.col("p_name")))
        .when(kind == 2, F.concat("p_name", F.lit(" St W")))
        .when(kind == 3, F.lit("n/a"))
        .otherwise(F.concat("p_name", F.lit(".")))
    )
    return (
        out.join(part, out.l_partkey == part.p_partkey, "left")
        .withColumn("location", location)
        .drop("l_partkey", "l_suppkey", "p_partkey", "p_name")
    )


def modeled_incidents(spark: SparkSession, sf_dir: str, with_location: bool = True) -> DataFrame:
    """Normalized, filtered to the model range, with the split label."""
    df = normalize_categories(raw_incidents(spark, sf_dir, with_location))
    df = df.where(within_model_range(F.col("ts"), F.col("min_delay")))
    return df.withColumn(
        "split", split_label(F.col("ts"), TRAIN_END, VALIDATION_YEAR, TEST_YEAR)
    )


def with_time(df: DataFrame) -> DataFrame:
    df = df.withColumns(calendar_parts(F.col("ts")))
    df = df.withColumns(cyclic_parts(F.col("hour"), F.col("day_of_year")))
    return df.withColumn("is_holiday", holiday_coercion(is_holiday(F.col("ts"))))
