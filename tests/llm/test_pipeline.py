"""The pipeline on the smallest table, stage by stage, against brute-force versions."""

import hashlib
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from priorline.llm.quality import LEAST_TAIL, fit_model, judge
from tests.llm.test_lines import brute as repeated_lines
from tests.llm.test_near_duplicates import brute as classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Each stage's input and output."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(results):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    for stage in results[1:-1]:
        assert stage.dtypes == results[0].dtypes and 0 < stage.count() <= results[0].count()


def test_quality(spark, results):
    model = fit_model(results[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {k for k, r in rows_of(results[0]).items() if judge(model, r.text)[1] >= LEAST_TAIL}
    assert set(rows_of(results[1])) == want


def test_line_dedup(results):
    before, after = rows_of(results[1]), rows_of(results[2])
    removed = repeated_lines([(k, r.text) for k, r in before.items()])
    assert removed
    for key, row in before.items():
        gone = {n for k, n in removed if k == key}
        left = [line for n, line in enumerate(row.text.split("\n")) if n not in gone]
        if key in after:
            assert after[key].text == "\n".join(left)
            assert after[key].n_chars == (len(after[key].text) if gone else row.n_chars)
        else:
            assert not [line for line in left if len(line.split()) >= 6]


def test_near_duplicates(results):
    before = rows_of(results[2])
    want = classes([(k, r.text) for k, r in before.items()])
    assert set(rows_of(results[3])) == {k for k, (_, class_id, _, _) in want.items() if class_id == k}


def test_decontamination(spark, results):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = rows_of(results[3]), rows_of(results[4])
    whole = {k for k, r in before.items() if any(item in r.text for item in items)}
    assert not whole & set(after) and len(after) > 0.8 * len(before)


def test_tokens(results):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    before, after = rows_of(results[4]), rows_of(results[5])
    assert set(before) == set(after)
    for key, row in before.items():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert after[key].n_tokens == len(ids)
        assert after[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, results):
    want = sorted(map(tuple, results[-1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want
