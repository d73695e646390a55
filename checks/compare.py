"""Run registered queries and their SQL side by side: ``python -m checks.compare DIR [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.cases import CASES
from priorline.sources.durable import drop_durable


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value if value is None else str(value)


def _table(columns: list[str], lines) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(line[i]) for i in order) for line in lines),
        key=lambda t: tuple((v is None, v or "") for v in t),
    )


def _kinds(types) -> list[str]:
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    return [names.get(str(t), str(t)) for t in types]


def compare(name: str, df: DataFrame, con: duckdb.DuckDBPyConnection, check: str) -> str:
    """Empty text when both agree, else what differs."""
    cursor = con.execute(check)
    other_columns = [d[0] for d in cursor.description]
    kinds = dict(zip(other_columns, _kinds(d[1] for d in cursor.description)))
    other = _table(other_columns, cursor.fetchall())
    mine = _table(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(other_columns):
        return f"columns {sorted(df.columns)} / {sorted(other_columns)}"
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    odd = {c: (own[c], kinds[c]) for c in own if own[c] != kinds[c] and not own[c].startswith("array")}
    if len(mine) != len(other):
        return f"rows {len(mine)} / {len(other)}"
    differing = [(a, b) for a, b in zip(mine, other) if a != b]
    if differing:
        return f"{len(differing)} of {len(mine)} rows differ, first: {differing[0]} {sorted(df.columns)}"
    return f"types {odd}" if odd else ""


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), database(sf_dir)
    bad = 0
    for name, (query, check) in CASES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            note = compare(name, df, con, check) if check else f"rows only: {df.count()}"
        except Exception as error:  # report every query
            note = f"error {type(error).__name__}: {str(error)[:600]}"
        drop_durable(spark)
        failed = bool(note) and not note.startswith("rows only")
        bad += failed
        print(f"{'BAD ' if failed else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
