"""Categories as dense numbers, by a dictionary that stays a table.

An index held on the driver grows with the categories. Here the dictionary is a DataFrame: values are
counted, sorted in ranges and numbered by place, and rows get their number by a join, which adaptive
execution can split at a frequent value. Only the number of values of each column reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.contract import UNKNOWN
from priorline.operators.positions import with_positions
from priorline.sources.durable import durable


def category_dictionary(df: DataFrame, columns: Sequence[str], missing: str = UNKNOWN) -> DataFrame:
    """(name, value, index): numbers from 0 in each column, the most frequent value first, ties by value.

    A missing value counts as ``missing``.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("cell")).groupBy("cell.name", "cell.value").agg(F.count(F.lit(1)).alias("n"))
    placed = with_positions(counts.withColumn("rare", F.negative("n")), ["name", "rare", "value"], "place")
    firsts = placed.groupBy(F.col("name").alias("of")).agg(F.min("place").alias("first"))  # one row per column
    joined = placed.join(F.broadcast(firsts), F.col("name") == F.col("of"))
    return durable(joined.select("name", "value", (F.col("place") - F.col("first")).alias("index")))


def encoded(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], missing: str = UNKNOWN, prefix: str = "i_") -> DataFrame:
    """df with the number of each column's value; values that the dictionary lacks share one more number."""
    sizes = {row["name"]: row["n"] for row in dictionary.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in columns:
        known = dictionary.where(F.col("name") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        own = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        out = out.withColumn("_own", own).join(known, F.col("_own") == F.col("_value"), "left").select(
            *out.columns, F.coalesce("_index", F.lit(sizes.get(c, 0))).cast("long").alias(f"{prefix}{c}")
        )
    return out
