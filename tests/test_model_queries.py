"""Model queries: what is made once is handed on."""

import types

import pytest

from checks import cases
from priorline.plans import models


def test_a_made_table_is_not_made_again(spark, monkeypatch):
    made = spark.createDataFrame([("train", 1.0, 5)], "split string, min_delay double, hour int")
    monkeypatch.setattr(cases, "_ARTIFACTS", {})
    monkeypatch.setattr(cases, "model_table", lambda *_: 1 / 0)
    monkeypatch.setattr(cases, "feature_projection", lambda columns: (["hour"], [], ["hour"]))
    monkeypatch.setattr(models, "run_calibration", lambda df, *_: types.SimpleNamespace(risks={}))
    monkeypatch.setattr(models, "fit_regressor", lambda df, *_, **__: "fitted")
    assert cases.artifact(spark, "nowhere", made).regressor == "fitted"


class Asked(Exception):
    """What a fit was asked for."""


@pytest.mark.parametrize(
    "name, whole", [("log_target", (400, 0.05, 6)), ("mode_specific", (400, 0.05, 6)), ("risk_calibrated", (400, 0.05, 5))]
)
def test_these_queries_fit_whole_models(spark, monkeypatch, name, whole):
    lines = [("train", "1998-03-01", "bus", 5.0, 1), ("train", "1999-03-01", "bus", 70.0, 2), ("train", "1998-05-01", "streetcar", 50.0, 3)]
    made = spark.createDataFrame(lines, "split string, day string, mode string, min_delay double, hour int")
    made = made.selectExpr("split", "CAST(day AS TIMESTAMP_NTZ) AS ts", "mode", "min_delay", "hour")
    monkeypatch.setattr(cases, "model_table", lambda *_: made)
    monkeypatch.setattr(models, "preprocessing", lambda *_: [])

    def fitted(prepared, rows, config, classes):
        raise Asked(config.rounds, config.step, config.depth)

    monkeypatch.setattr(models, "_trees", fitted)
    monkeypatch.setattr(models, "feature_projection", lambda columns: (["mode", "hour"], ["mode"], ["hour"]))
    with pytest.raises(Asked) as asked:
        cases.CASES[name][0](spark, "nowhere")
    assert asked.value.args == whole


def test_fits_of_the_same_rows_prepare_them_once(spark, monkeypatch):
    """Three combined experiments and one for each mode: three preparations, not five."""
    lines = [(split, mode, float(7 * k % 90), k % 24) for k in range(60) for split in ("train", "validation") for mode in models.MODES]
    made = spark.createDataFrame(lines, "split string, mode string, min_delay double, hour int")
    calls, real = [], models.preprocessing
    monkeypatch.setattr(models, "feature_projection", lambda columns: (["mode", "hour"], ["mode"], ["hour"]))
    monkeypatch.setattr(models, "preprocessing", lambda *given: calls.append(1) or real(*given))
    shared, config = {}, models.TreeConfig(rounds=1, depth=1, row_share=1.0, column_share=1.0)
    train = made.where("split = 'train'")
    for fit in models.EXPERIMENTS.values():
        fit(train, config, shared)
    assert len(calls) == 3
