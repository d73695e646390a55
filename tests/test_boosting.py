"""Boosted trees with one-hot categories: the cells stay few, and the trees are the right ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.plans import boosting, models

WHOLE = models.TreeConfig(rounds=2, depth=2, row_share=1.0, column_share=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    lines = []
    for k in range(3000):
        number, route = rng.randint(0, 9), f"r{rng.randint(0, 499)}"
        label = 4.0 * (number > 6) + 50.0 * (route == "r7") + rng.random()
        lines.append((float(number), route, ["a", "b"][k % 2], label))
    return spark.createDataFrame(lines, "hour double, route string, mode string, y double").withColumns(
        {"_label": F.col("y"), "_weight": F.lit(1.0)}
    )


@pytest.fixture(scope="module")
def prepared(rows):
    return models.Pipeline(stages=models.preprocessing(rows, ["route", "mode"], ["hour"], WHOLE)).fit(rows)


def layout_of(prepared):
    index = prepared.stages[1]
    return boosting.Layout(["x_hour"], ["i_route", "i_mode"], [len(x) for x in index.labelsArray])


def test_a_row_has_one_cell_for_each_category(rows, prepared):
    layout = layout_of(prepared)
    held = prepared.transform(rows).withColumn("_row", F.monotonically_increasing_id())
    layout.thresholds = boosting.thresholds(held, layout.numbers)
    table = boosting.binned(held, layout)
    assert len(table.columns) == 4 + 3 and layout.width == 1 + 500 + 2
    sums = boosting.level_sums(table, layout, [], [], [0], 0, False, 1.0, 1).collect()
    assert sum(r.n for r in sums if r.feature == -1) == 3000 and sum(r.n for r in sums if 1 <= r.feature < 501) == 3000


def test_trees_equal_those_of_mllib(rows, prepared):
    """Without draws, and with a number of few values, both learners have the same choices."""
    table = prepared.transform(rows)
    for classes in (False, True):
        labelled = table.withColumn("_label", (F.col("y") > 3.5).cast("double")) if classes else table
        kind = models.GBTClassifier if classes else models.GBTRegressor
        other = kind(labelCol="_label", weightCol="_weight", predictionCol="_raw", **WHOLE.tree()).fit(labelled)
        mine = models._trees(prepared, labelled.select(*rows.columns), WHOLE, classes)
        score = "probability" if classes else "_raw"
        values = [
            np.array([np.atleast_1d(r[0].toArray() if classes else r[0]) for r in m.transform(labelled).orderBy("y").select(score).collect()])
            for m in (mine, other)
        ]
        assert np.allclose(*values, atol=1e-9) and len(np.unique(values[0].round(9))) >= 2


def test_draws_take_about_their_share(rows, prepared):
    table = boosting.binned(prepared.transform(rows).withColumn("_row", F.monotonically_increasing_id()), _with_points(rows, prepared))
    layout = _with_points(rows, prepared)
    found = [
        boosting.level_sums(table, layout, [], [], [0], number, False, 0.8, 1).where("feature = -1").first().n for number in range(2)
    ]
    assert all(0.75 < n / 3000 < 0.85 for n in found) and found[0] != found[1]


def _with_points(rows, prepared):
    layout = layout_of(prepared)
    layout.thresholds = boosting.thresholds(prepared.transform(rows), layout.numbers)
    return layout


def test_margins_are_the_same_when_written(rows, prepared, monkeypatch):
    config = models.TreeConfig(rounds=5, depth=2)
    table = prepared.transform(rows)
    want = models._trees(prepared, rows, config, False).transform(table).agg(F.sum("_raw")).first()[0]
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    assert models._trees(prepared, rows, config, False).transform(table).agg(F.sum("_raw")).first()[0] == pytest.approx(want)


def test_features_are_drawn_as_spark_hashes(spark):
    found = spark.range(50).select(F.xxhash64(F.lit(42), F.lit(7), F.lit(3), F.col("id").cast("int"))).collect()
    assert boosting._hashed([42, 7, 3, np.arange(50)]).tolist() == [r[0] for r in found]


@pytest.mark.parametrize("classes", [False, True])
def test_one_job_for_all_rounds_grows_the_same_trees(rows, prepared, monkeypatch, classes):
    """With draws and weights, in several tasks that send few cells at a time."""
    labelled = rows.withColumns(
        {"_label": (F.col("y") > 3.5).cast("double") if classes else F.col("y"), "_weight": 1 + F.col("hour") % 3}
    )
    # Without the mode: of its two values either one gives the same split.
    layout = boosting.Layout(["x_hour"], ["i_route"], [500])
    held = prepared.transform(labelled).withColumn("_row", F.monotonically_increasing_id()).persist()
    layout.thresholds = boosting.thresholds(held, layout.numbers)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 1000)
    monkeypatch.setattr(boosting, "CELLS_AT_ONCE", 900)
    draws = (layout, classes, 2, 0.3, 3, 0.8, 0.7, 11)
    one, other = boosting.at_once(held, *draws), boosting.level_by_level(held, *draws)
    shape = lambda trees: [[(n.feature, n.bin, n.left, n.right) for n in tree] for tree in trees]
    assert shape(one) == shape(other) and max(len(tree) for tree in one) > 5
    for mine, theirs in zip(one, other):
        assert np.allclose([[*n.sums, n.gain] for n in mine], [[*n.sums, n.gain] for n in theirs], rtol=1e-6, atol=1e-6)
    held.unpersist()


def test_rounds_need_no_jobs_of_their_own(spark, rows, prepared):
    """Fails with a job for each level: 30 rounds of depth 4 had more than a hundred."""
    group = "rounds-of-one-job"
    spark.sparkContext.setJobGroup(group, group)
    models._trees(prepared, rows, models.TreeConfig(rounds=30, depth=4), False)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 20
