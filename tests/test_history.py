"""Strictly-prior features: literal cases, strategies, skew, look-up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorline.contract import HISTORY_FEATURES
from priorline.functions.calendar import micros
from priorline.functions.text import NORMALIZERS, incident_key, normalize_categories
from priorline.operators.history import FEATURES, _past_events, add_history_features, with_history
from priorline.operators.lookup import look_up_history
from priorline.operators.prefix import sums_before
from priorline.operators.slices import cut_times, with_slices
from priorline.plans.modeling import add_split, build_modeling_table

SCHEMA = "ts timestamp_ntz, mode string, route string, direction string, incident string, location string, min_delay double"


def incidents(spark, lines):
    rows = [(dt.datetime.fromisoformat(t), "bus", r, "N", i, l, float(y)) for t, r, i, l, y in lines]
    return spark.createDataFrame(rows, SCHEMA)


def by_time(df, *names):
    return [tuple(r) for r in df.orderBy("ts", "min_delay").select(*names).collect()]


@pytest.mark.parametrize("strategy", ["sliced", "bucketed", "range"])
def test_equal_timestamps_do_not_see_each_other(spark, strategy):
    df = incidents(
        spark,
        [("2024-01-01 08:00:00", "1", "Mechanical", "A", 10), ("2024-01-02 08:00:00", "1", "Mechanical", "A", 20),
         ("2024-01-02 08:00:00", "1", "Mechanical", "A", 100), ("2024-01-03 08:00:00", "1", "Mechanical", "B", 5)],
    )
    out = add_history_features(df, strategy=strategy)
    got = by_time(out, "prior_route_mean_delay", "prior_route_incident_count", "prior_location_count")
    assert got == [(None, 0, 0), (10.0, 1, 1), (10.0, 1, 1), (130 / 3, 3, 0)]


@pytest.mark.parametrize("strategy", ["sliced", "bucketed", "range"])
def test_rolling_windows(spark, strategy):
    df = incidents(
        spark,
        [("2024-01-01 08:00:00", "1", "Mechanical", "A", 10), ("2024-01-15 08:00:00", "1", "Mechanical", "A", 60),
         ("2024-01-20 08:00:00", "1", "Mechanical", "A", 40), ("2024-01-31 08:00:00", "1", "Mechanical", "A", 40),
         ("2024-02-01 08:00:00", "1", "Mechanical", "A", 0)],
    )
    out = add_history_features(df, strategy=strategy)
    got = by_time(
        out, "prior_route_30d_mean_delay", "prior_route_30d_severe_rate_30", "prior_route_30d_severe_rate_60",
        "prior_route_hour_7d_mean_delay",
    )
    assert got[3] == (110 / 3, 2 / 3, 1 / 3, 110 / 3)  # 1 January 08:00 still counts; no 7-day row: route mean
    assert got[4] == (140 / 3, 1.0, 1 / 3, 40.0)


def test_future_targets_do_not_leak(spark):
    lines = [(f"2024-01-{d:02d} 0{d % 9}:00:00", str(d % 3), "Delay", "A", d * 3 % 50) for d in range(1, 25)]
    base = add_history_features(incidents(spark, lines))
    changed = add_history_features(
        incidents(spark, [(*l[:4], l[4] + 77 if l[0] >= "2024-01-15" else l[4]) for l in lines])
    )
    early = F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")
    rows = lambda df: sorted(map(str, df.where(early).select("ts", *HISTORY_FEATURES).collect()))
    assert rows(base) == rows(changed)


def test_strategies_agree_with_a_hot_key_and_missing_values(spark):
    n = 3000
    df = spark.range(n).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 7 % 900).cast("int"))).alias("ts"),
        F.when(F.col("id") % 3 == 0, "bus").otherwise("streetcar").alias("mode"),
        F.when(F.col("id") % 3 != 1, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("route"),
        F.lit("N").alias("direction"), (F.col("id") % 5).cast("string").alias("incident"), F.lit("X").alias("location"),
        (F.col("id") % 83).cast("double").alias("min_delay"),
    )
    both = [
        sorted(map(str, add_history_features(df, strategy=s).collect())) for s in ("sliced", "bucketed", "range")
    ]
    assert both[0] == both[1] == both[2]


def test_hot_partitions_are_split(spark):
    """Every join of the bucketed plan can be split by adaptive execution."""
    df = spark.range(40_000).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50_000).cast("decimal(18,6)"))).alias("ts"),
        F.lit("bus").alias("mode"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("route"),
        F.lit("N").alias("direction"), F.lit("i").alias("incident"), F.lit("X").alias("location"), F.lit(1.0).alias("min_delay"),
        F.sha2(F.col("id").cast("string"), 256).alias("vehicle"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        out = add_history_features(df, ["prior_route_mean_delay"], strategy="bucketed")
        assert len(out.collect()) == 40_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def hot_second(spark, n=6000):
    """A third of the rows in one second, which comes again a month later; one key for all of them."""
    second = F.when(F.col("id") % 3 == 0, F.lit(40 * 86_400)).otherwise(F.col("id") * 1171 % (90 * 86_400)).cast("decimal(18,6)")
    return spark.range(n).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)).alias("ts"),
        F.lit("bus").alias("mode"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 17).cast("string")).alias("route"),
        F.when(F.col("id") % 7 != 0, "N").alias("direction"), (F.col("id") % 4).cast("string").alias("incident"),
        (F.col("id") % 601).cast("string").alias("location"), F.when(F.col("id") % 11 != 0, (F.col("id") % 97).cast("double") / 4).alias("min_delay"),
        F.col("id").alias("number"),
    )


def test_a_hot_second_is_dealt_over_tasks(spark):
    df = hot_second(spark)
    got, want = (
        sorted(map(str, add_history_features(df, strategy=s).collect())) for s in ("sliced", "range")
    )
    assert got == want
    rows = df.withColumn("at", micros(F.col("ts")))
    cut = cut_times(rows, "at", 32)
    sizes = [r["count"] for r in with_slices(rows, "at", cut).groupBy("_slice", "_part").count().collect()]
    assert len(sizes) > 24 and max(sizes) < 3 * sum(sizes) / 32  # 2,000 rows of one second
    assert len(cut.parts) == 1 and sum(cut.parts.values()) >= 9


def test_a_row_is_shuffled_once_for_each_family(spark):
    """All features by default: a row is dealt for the route's groupings, the location's and the others, not per grouping."""
    out = add_history_features(hot_second(spark))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 3 and "Expand" not in plan


@pytest.mark.parametrize("cell_rows", [100, 700])
def test_cells_of_large_keys_and_seconds_agree_with_plain_windows(spark, cell_rows):
    df = hot_second(spark)
    asked, past = df.where("number % 5 = 0").withColumn("nothing", F.lit(None)), df.where("number % 5 != 0 OR number % 2 = 0")
    got, want = (
        sorted(map(str, with_history(asked, history=past, **kind).collect()))
        for kind in ({"cell_rows": cell_rows}, {"strategy": "range"})
    )
    assert got == want and len(got) == 1200


def test_sums_before_equals_a_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("k"), (F.col("id") * 37 % 211).alias("o"), F.col("id").alias("v"))
    got = sums_before(df, ["k"], "o", F.floor(F.col("o") / 10), ["v"])
    lines = [tuple(r) for r in df.collect()]
    expected = sorted((k, o, v, sum(w for a, b, w in lines if a == k and b < o)) for k, o, v in lines)
    assert sorted(tuple(r) for r in got.collect()) == expected


HISTORY = [
    ("2024-01-01 08:00:00", "29", "Mechanical", "Dufferin St", 10), ("2024-02-10 08:00:00", "29", "Mechanical", "Dufferin St", 60),
    ("2024-02-15 08:00:00", "29", "Mechanical", "Dufferin St", 90), ("2024-02-20 08:00:00", "29", "Mechanical", "Dufferin St", 500),
]


@pytest.mark.parametrize("strategy", ["sliced", "bucketed", "range"])
def test_point_in_time_lookup(spark, strategy):
    history = incidents(spark, HISTORY)
    asked = incidents(
        spark, [("2024-02-20 08:00:00", "29.0", "Mech", "dufferin st", 0), ("2023-01-01 00:00:00", "29", "Mech", "x", 0)]
    ).drop("min_delay")
    late, early = look_up_history(asked, history, strategy=strategy).orderBy(F.desc("ts")).collect()
    assert late["prior_route_mean_delay"] == 160 / 3
    assert late["prior_route_30d_mean_delay"] == 75.0
    assert late["prior_route_hour_7d_mean_delay"] == 90.0
    assert late["prior_route_30d_severe_rate_60"] == 1.0
    assert (late["prior_location_mean_delay"], late["prior_location_count"]) == (160 / 3, 3)
    assert (late["support_route"], late["support_route_recent"], late["historical_row_count"]) == (3, 2, 4)
    assert any("low prior support" in w and "prior_route_30d_mean_delay=2" in w for w in late["history_warnings"])
    assert early["prior_route_mean_delay"] is None and early["prior_route_incident_count"] == 0
    assert any("before or at the beginning" in w for w in early["history_warnings"])


def test_modeling_table(spark):
    cleaned = incidents(
        spark,
        [("2022-12-31 08:00:00", "1.0", "Mech", "A", 10), ("2023-01-01 08:00:00", "1", "Mech", "A", 20),
         ("2023-01-02 08:00:00", "1", "Mech", "A", 30), ("2024-05-01 08:00:00", "1", "Mech", "A", 15),
         ("2024-05-02 08:00:00", "1", "Mech", "A", 241)],
    )
    table = add_split(build_modeling_table(cleaned))
    got = by_time(table, "split", "severe_delay_15", "prior_global_mean_delay", "route", "route_raw")
    assert got == [
        ("train", 0, None, "1", "1.0"), ("validation", 1, 10.0, "1", "1"), ("validation", 1, 15.0, "1", "1"),
        ("test", 1, 20.0, "1", "1"),
    ]


@pytest.mark.parametrize("strategy", ["sliced", "bucketed", "range"])
def test_undated_rows_stay(spark, strategy):
    df = incidents(spark, [("2024-01-01 08:00:00", "1", "Mechanical", "A", 10), ("2024-01-02 08:00:00", "1", "Mechanical", "A", 20)])
    df = df.union(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    out = add_history_features(df, strategy=strategy).where("ts IS NULL").collect()
    assert len(out) == 1 and out[0]["prior_route_mean_delay"] is None and out[0]["prior_route_incident_count"] == 0


def test_sums_beyond_the_range_of_scaled_longs(spark):
    df = incidents(spark, [(f"2024-01-0{d} 08:00:00", "1", "Mechanical", "A", 6e12 + d) for d in range(1, 5)])
    out = by_time(add_history_features(df), "prior_route_mean_delay")
    assert out[-1][0] == pytest.approx(6e12 + 2)


@pytest.mark.parametrize("cell_rows", [100, 10**6])
def test_only_asked_rows_are_returned_with_all_history(spark, cell_rows):
    """Rows that are asked for see all others; a key that nobody else has in a slice keeps what it had before."""
    df = hot_second(spark).withColumn("nothing", F.lit(None))
    asked = (F.col("number") % 5 == 0) & (F.col("ts") >= F.lit("2024-02-01").cast("timestamp_ntz"))
    got, want = (
        sorted(map(str, with_history(df, asked=asked, **kind).collect()))
        for kind in ({"cell_rows": cell_rows}, {"strategy": "range"})
    )
    assert got == want and 600 < len(got) < 1200


def test_history_before_the_first_asked_time_is_summed_per_key(spark):
    past = hot_second(spark).select("route", F.lit(1).alias("_past"), micros(F.col("ts")).alias("_at"), "min_delay")
    first = micros_of(spark, "2024-03-20")
    events = _past_events(
        past, past, [30], ["route"], False, (first, first + 10**12), lambda sign: [F.lit(sign).cast("bigint").alias("_m_rows")]
    )
    early = events.where(F.col("_at") < first)
    keys = [tuple(r) for r in early.groupBy("route", "_leaves").count().collect()]
    assert len(keys) > 18 and all(n == 1 for _, _, n in keys)
    assert early.where("_leaves IS NULL").agg(F.sum("_m_rows")).first()[0] == past.where(F.col("_at") < first).count()
    assert events.where(F.col("_at") >= first).count() < 3000


def micros_of(spark, day):
    return spark.range(1).select(micros(F.lit(day).cast("timestamp_ntz"))).first()[0]


def test_squeezed_columns_are_as_the_expression_makes_them(spark):
    texts = ["", " ", "a  b", "\ta", "a\nb\r", " a b ", "a\x0bb\f", "a\u00a0 b", "007", "00", "0.0", "12.00", "ops_/  x&y", "Rail/Switches", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = normalize_categories(df.select(*[F.col("t").alias(c) for c in NORMALIZERS], "t"))
    for name, rule in NORMALIZERS.items():
        assert got.where(~F.col(name).eqNullSafe(rule(F.col("t")))).count() == 0
    keys = [r[0] for r in df.select(incident_key(F.col("t"))).collect()]
    assert keys[-3:] == ["OPS X AND Y", "RAIL SWITCHES", None]


def test_a_slice_has_the_carry_of_keys_that_are_only_asked_there(spark):
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))
    incident = F.when(F.col("id") < 30, "early").otherwise("late")
    others = [F.lit("x").alias(c) for c in ("mode", "route", "direction", "location")]
    past = spark.range(200).select(ts.alias("ts"), *others, incident.alias("incident"), F.lit(7.0).alias("min_delay"))
    asked = past.where("ts = '2024-05-30'").withColumn("incident", F.lit("early"))
    features = [f for f in FEATURES if f.name == "prior_incident_mean_delay"]
    got = with_history(asked, features, history=past, cell_rows=10).collect()
    assert [row["prior_incident_mean_delay"] for row in got] == [7.0]
