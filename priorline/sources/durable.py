"""Tables that outlive executors: intermediate results written to shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Open lists of written tables, the innermost last; the first one is the process's own.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=([],))


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    Both are shared by the driver and all executors, whatever the master is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"


def scratch_folder(spark: SparkSession, outer: bool = False) -> str:
    """A new folder below the shared one, which leaving the innermost (or the next) ``scratch_tables`` removes."""
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    lists = _written.get()
    lists[max(len(lists) - 2, 0) if outer else -1].append(path)
    return path


def durable(df: DataFrame, outer: bool = False) -> DataFrame:
    """Materialize a table that many jobs read, and cut its lineage.

    Parquet rather than a checkpointed RDD: later reads prune columns and push filters down. The table
    stays until ``discard``, the end of the ``scratch_tables`` block it was made in (with ``outer``: of
    the one around it), or ``drop_durable``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, outer)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table that ``durable`` returned, once nothing reads it any more."""
    _delete(table.sparkSession, table.durable_path)
    for paths in _written.get():
        if table.durable_path in paths:
            paths.remove(table.durable_path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables made in the block are its own, and deleted when it ends."""
    own: list[str] = []
    token = _written.set((*_written.get(), own))
    try:
        yield
    finally:
        _written.reset(token)
        while own:
            _delete(spark, own.pop())


def drop_durable(spark: SparkSession) -> None:
    """Delete the tables of the innermost open list, once their readers are done."""
    paths = _written.get()[-1]
    while paths:
        _delete(spark, paths.pop())
