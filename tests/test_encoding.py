from pyspark.sql import functions as F

from priorline.operators.encoding import category_dictionary, encoded


def test_numbers_follow_frequency_and_value(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None), ("c", "y"), (None, "y"), ("a", "y")], "k string, z string")
    words = category_dictionary(train, ["k", "z"])
    assert {(r.name, r.value): r["index"] for r in words.collect()} == {
        ("k", "a"): 0, ("k", "b"): 1, ("k", "Unknown"): 2, ("k", "c"): 3, ("z", "y"): 0, ("z", "x"): 1, ("z", "Unknown"): 2,
    }
    fresh = spark.createDataFrame([("c", "new"), (None, "x"), ("d", None)], "k string, z string")
    assert sorted(tuple(r) for r in encoded(fresh, words, ["k", "z"]).select("i_k", "i_z").collect()) == [(2, 1), (3, 3), (4, 2)]


def test_a_million_values(spark):
    n = 1_000_000
    df = spark.range(n + 500).select(F.when(F.col("id") >= n, F.lit("v7")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("k"))
    words = category_dictionary(df, ["k"])
    assert words.agg(F.count("*"), F.min("index"), F.max("index"), F.count_distinct("index")).first()[:] == (n, 0, n - 1, n)
    assert words.where("index = 0").first().value == "v7"
    found = encoded(df.union(spark.createDataFrame([("unseen",)], "k string")), words, ["k"])
    assert found.where("k = 'v7'").agg(F.max("i_k"), F.count("*")).first()[:] == (0, 501)
    assert found.where("k = 'unseen'").first().i_k == n and found.count() == n + 501
