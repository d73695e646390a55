"""Model jobs, scoring and stream replay on small tables; a few registered queries against SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.cases import CASES
from checks.compare import compare, database
from priorline.contract import feature_projection
from priorline.operators.history import add_history_features
from priorline.plans import models
from priorline.plans.explain import _permuted, deterministic_sample
from priorline.plans.modeling import add_time_features
from priorline.plans.score import score_incidents
from priorline.sources.durable import durable
from priorline.streaming.replay import score_stream

TINY = models.TreeConfig(rounds=2, depth=2)


@pytest.fixture(scope="module")
def table(spark):
    start = dt.datetime(2024, 1, 1)
    lines = [
        (start + dt.timedelta(hours=7 * i), ["bus", "streetcar"][i % 2], str(i % 5), "NESW"[i % 4],
         ["Mechanical", "Security"][i % 2], f"STOP {i % 3}", float(i * 37 % 100), "train" if i < 240 else "validation")
        for i in range(300)
    ]
    schema = "ts timestamp_ntz, mode string, route string, direction string, incident string, location string, min_delay double, split string"
    return durable(add_history_features(add_time_features(spark.createDataFrame(lines, schema))))


@pytest.fixture(scope="module")
def artifact(table):
    train = table.where("split = 'train'")
    base = models.fit_classifier(train, 30, TINY)
    scored = models.positive_probability(base, table, "p").withColumn("y", (F.col("min_delay") >= 30).cast("int"))
    isotonic = models.fit_calibrators(scored, "p", "y")["isotonic"]
    delay = models.fit_regressor(train, TINY, log_target=True)
    return models.Artifact(delay, {30: models.RiskModel(30, base, isotonic, 0.4)}, feature_projection(table.columns)[0])


def test_predictions_stay_in_range(table, artifact):
    out = models.predict(artifact.regressor, table).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= out[0] <= out[1] <= 240


def test_isotonic_map_is_monotone(table, artifact):
    risk = artifact.risks[30]
    scored = models.positive_probability(risk.base, table, "p")
    points = sorted((r["p"], r["q"]) for r in risk.calibrator.transform(scored, "p", "q").select("p", "q").collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(points, points[1:]))


def test_artifact_round_trip(spark, table, artifact, tmp_path):
    artifact.save(str(tmp_path), spark)
    again = models.load_artifact(str(tmp_path), spark)
    name = "calibrated_severe_delay_probability_30"
    rows = lambda a: sorted(r[0] for r in models.two_output_frame(table, a).select(name).collect())
    assert rows(again) == rows(artifact)


def test_unseen_mode_is_an_error(spark, table):
    with pytest.raises(ValueError, match="missing modes"):
        models.fit_mode_models(table.where("mode = 'bus'"), TINY)


def test_classifier_needs_both_classes(table):
    with pytest.raises(ValueError, match="both classes"):
        models.fit_classifier(table, 1000, TINY)


def test_sample_does_not_depend_on_partitioning(table):
    a = deterministic_sample(table.repartition(7), ["ts", "route"], 40)
    b = deterministic_sample(table.coalesce(1), ["ts", "route"], 40)
    assert sorted(map(str, a.select("ts").collect())) == sorted(map(str, b.select("ts").collect()))


def test_scoring_batch_and_stream(spark, table, artifact, tmp_path):
    history = table.where("split = 'train'")
    asked = table.where("split = 'validation'").select("ts", "mode", "route", "direction", "incident", "location")
    batch = score_incidents(asked, history, artifact)
    assert batch.count() == 60
    first = batch.orderBy("ts").first()
    assert first["request_error"] is None and first["risk_band_30"] in ("low", "medium", "high")
    assert any("Derived missing time fields" in w for w in first["warnings"])
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    query = score_stream(
        stream, lambda df: score_incidents(df, history, artifact), str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("ts", "predicted_delay_minutes")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select("ts", "predicted_delay_minutes").collect()))


@pytest.mark.parametrize(
    "name", ["clean_table", "normalize_table", "all_history", "point_in_time_lookup", "baseline_grid", "cutoff_table", "category_audit"]
)
def test_registered_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    query, check = CASES[name]
    assert compare(name, query(spark, sf), database(sf), check) == ""


def test_rows_without_a_mode_stay(spark, table):
    models_by_mode = models.fit_mode_models(table.where("split = 'train'"), TINY)
    rows = table.limit(10).withColumn("mode", F.when(F.col("route") != "1", F.col("mode")))
    out = models_by_mode.transform(rows).select("mode", "prediction").collect()
    assert len(out) == rows.count() and all((r.mode is None) == (r.prediction is None) for r in out)


def test_medians_are_exact_and_large_categories_one_hot(spark):
    rows = [(float(k), f"c{k}", "bus", float(k)) for k in range(1002)] + [(None, None, "bus", 1.0)]
    df = spark.createDataFrame(rows, "hour double, route string, mode string, y double")
    assert models.exact_medians(df, ["hour"]) == {"hour": 500.5}
    stages = models.preprocessing(df, ["route", "mode"], ["hour"], TINY)
    out = models.Pipeline(stages=stages).fit(df).transform(df)
    vector = out.where("hour = 7").select("features").first()[0]
    # One number, 1,003 routes with the filled one, one mode.
    assert vector.size == 1 + 1003 + 1 and vector.numNonzeros() == 3
    assert out.where("hour IS NULL").select("features").first()[0][0] == 500.5


def test_permuted_rows_hold_the_same_values(spark, table):
    rows = table.select("hour", "route", "min_delay")
    mixed = _permuted(rows, ["hour", "route"], 2, 7).persist()
    assert mixed.count() == rows.count() * 4
    want = sorted(r[0] for r in rows.select("hour").collect())
    moved = mixed.where("feature = 'hour' AND repeat = 1")
    assert sorted(r[0] for r in moved.select("hour").collect()) == want
    kept = sorted(map(tuple, moved.select("route", "min_delay").collect()))
    assert kept == sorted(map(tuple, rows.select("route", "min_delay").collect()))
    other = mixed.where("feature = 'hour' AND repeat = 0").exceptAll(moved.withColumn("repeat", F.lit(0)))
    assert other.count() > 0
