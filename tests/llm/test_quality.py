import random

import numpy as np
import pytest

from priorline.llm.quality import LEAST_TAIL, fit, fit_model, fit_sample, grades, judge, select, select_documents

WORDS = ["river", "stone", "under", "walking", "evening", "green", "letter", "market", "bread", "window"]


def text_of(rng, grade):
    words = rng.choices(WORDS, k=rng.randint(20, 60))
    if grade < 2:
        words.insert(rng.randrange(len(words)), rng.choice(["vilegrub", "vilenock", "viletar"]))
    if grade < 1:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 1, 2, 2, 2])) for k in range(1500)]
    docs = [(k, text_of(rng, grade), "en", grade) for k, grade in rows]
    labels = [(k, int(grade > 0), int(grade < 2)) for k, grade in rows if k < 1000]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, expected_grade int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        dict(rows),
    )


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = fit_model(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    kept = {r.doc_id for r in select(docs, model).collect()}
    held_out = [k for k in truth if k >= 1000]
    right = sum((k in kept) == (truth[k] == 2) for k in held_out)
    assert right / len(held_out) > 0.98
    assert {r.doc_id for r in select_documents(docs, labels).collect()} == kept
    grade = {r[0]: judge(model, r[1])[0] for r in docs.collect()}
    means = [np.mean([grade[k] for k in held_out if truth[k] == g]) for g in range(3)]
    assert means == sorted(means)


def test_sample_is_bounded_and_independent_of_partitions(corpus):
    docs, labels, _ = corpus
    one = fit_sample(docs, labels, 100)
    other = fit_sample(docs.repartition(7), labels.repartition(3), 100)
    assert len(one) == 100 and all(a[0] == b[0] and np.array_equal(a[1], b[1]) for a, b in zip(one, other))


def test_select_keeps_columns_and_bears_odd_rows(frame, odd_rows, corpus):
    docs, labels, _ = corpus
    model = fit_model(docs, labels)
    odd = frame([(*row, 1.5, ["x"]) for row in odd_rows], "doc_id long, text string, tail_probability double, grade array<string>")
    kept = select(odd, model)
    assert kept.schema == odd.schema
    rows = kept.collect()
    assert not [r for r in rows if not r.text] and all(judge(model, r.text)[1] >= LEAST_TAIL for r in rows)
    assert select(frame([]), model).count() == 0
    assert judge(model, "") == (0.0, 0.0)


def test_grades(frame):
    labels = frame(
        [(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 0, 1), (4, 1, 1), (None, 1, 0), (5, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    assert {r.labelled: r.grade for r in grades(labels).collect()} == {1: 1, 2: 2, 3: 0, 4: 1}


def test_without_labels_all_texts_stay(frame):
    model = fit_model(frame([(1, "a b")]), frame([], "doc_id long, quality int, toxic int"))
    assert judge(model, "some words")[1] == 1.0
    assert np.isfinite(fit([(2, np.array([1, 2], dtype=np.int32))]).weights).all()
