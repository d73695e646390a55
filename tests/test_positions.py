import pytest
from pyspark.sql import functions as F

from priorline.operators.positions import attach_predictions, with_positions
from priorline.plans.explain import permuted_number


def test_places_are_those_of_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), F.col("id").alias("v"))
    lines = with_positions(df.repartition(7), ["k"], "place").collect()
    assert [r.place for r in sorted(lines, key=lambda r: r.k)] == list(range(1000))


def test_unlike_tables_are_refused(spark):
    rows = spark.createDataFrame([(k, "test") for k in range(5)], "k int, split string")
    good = spark.createDataFrame([(9 - k, "test", float(k)) for k in range(5)], "o int, split string, prediction double")
    found = {r.k: r.prediction for r in attach_predictions(rows, good, ["k"], ["o"]).collect()}
    assert found == {k: 4.0 - k for k in range(5)}
    with pytest.raises(ValueError, match="4 rows"):
        attach_predictions(rows, good.where("o > 5"), ["k"], ["o"])
    with pytest.raises(ValueError, match="another split at 1|another split than their row at 1"):
        other = good.withColumn("split", F.when(F.col("o") == 7, "validation").otherwise(F.col("split")))
        attach_predictions(rows, other, ["k"], ["o"])


def test_keyed_permutations(spark):
    """Every size: each number once, and other keys give other orders."""
    sizes = [1, 2, 3, 5, 17, 100, 257, 1000]
    for n in sizes:
        key = [F.col("key"), F.lit(42)]
        df = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "key"))
        found = df.select("key", "id", permuted_number(F.col("id"), key, n).alias("to")).collect()
        by_key = [[r.to for r in sorted(found, key=lambda r: r.id) if r.key == k] for k in range(3)]
        assert all(sorted(order) == list(range(n)) for order in by_key), n
        if n >= 17:
            assert by_key[0] != by_key[1] != by_key[2] and sum(a == b for a, b in enumerate(by_key[0])) < n / 3
