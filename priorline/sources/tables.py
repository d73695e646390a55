"""Typed tables at rest, splits, reports and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contract import CLEANED_SCHEMA
from priorline.sources.files import CSV_DIALECT


def read_cleaned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The cleaned table with its fixed schema: routes stay text, whatever they look like."""
    reader = spark.read.schema(CLEANED_SCHEMA)
    return reader.options(**CSV_DIALECT).csv(path) if fmt == "csv" else reader.parquet(path)


def write_cleaned(df: DataFrame, path: str) -> None:
    """Parquet partitioned by mode, each file ordered by time."""
    df.sortWithinPartitions("mode", "ts").write.mode("overwrite").partitionBy("mode").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Modeling rows partitioned by split; rows in no split go to the null partition."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All modeling rows, or one split (other partitions are not read)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def strict_json(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL so that reports are strict JSON."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    infinite = float("inf")
    return df.withColumns(
        {
            name: F.when(
                ~F.isnan(name) & (F.col(name) != infinite) & (F.col(name) != -infinite), F.col(name)
            )
            for name in floats
        }
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table as JSON lines or CSV with a header."""
    safe = strict_json(df).write.mode("overwrite")
    if fmt == "json":
        safe.option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        safe.options(header=True, quote='"', escape='"').csv(path)
    else:
        raise ValueError(f"Unknown report format: {fmt}")
