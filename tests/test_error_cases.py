"""Registered error reports over tables of a few rows, against their SQL."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from checks.cases import CASES
from checks.compare import compare, database


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(5)
    start = dt.datetime(1999, 1, 1)
    lines = [
        (rng.randint(1, 200), rng.randint(1, 12), rng.randint(1, 4), rng.randint(1, 7), float(rng.randint(1, 50)),
         0.02, "FO"[k % 2], start + dt.timedelta(days=rng.randint(0, 1090)))
        for k in range(1500)
    ]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus", "l_shipdate"]
    parts = {"p_partkey": list(range(1, 12)), "p_name": [f"red part {k}" for k in range(1, 12)]}
    columns = dict(zip(names, zip(*lines)))
    columns["l_linenumber"] = pa.array(columns["l_linenumber"], pa.int32())
    pq.write_table(pa.table(columns), f"{folder}/lineitem.parquet")
    pq.write_table(pa.table(parts), f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("group", ["hour", "month", "delay_bucket"])
def test_groups_made_from_other_columns(spark, tables, group):
    query, check = CASES[f"error_by_{group}"]
    out = query(spark, tables)
    assert out.count() > 1 and compare(f"error_by_{group}", out, database(tables), check) == ""
