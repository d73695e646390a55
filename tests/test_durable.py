import os

import pytest

from priorline.sources.durable import discard, drop_durable, durable, scratch_tables


def there(table):
    return os.path.isdir(table.durable_path.removeprefix("file:"))


def test_blocks_own_their_tables(spark):
    before = durable(spark.range(3))
    with scratch_tables(spark):
        inner = durable(spark.range(4))
        result = durable(inner.where("id > 1"), outer=True)
        with scratch_tables(spark):
            nested = durable(spark.range(2))
        assert not there(nested) and there(inner)
    assert not there(inner) and there(before) and result.count() == 2
    drop_durable(spark)
    assert not there(before) and not there(result)


def test_discarded_tables_are_gone_and_forgotten(spark):
    table = durable(spark.range(3))
    discard(table)
    assert not there(table)
    drop_durable(spark)


def test_failing_blocks_clean_up(spark):
    with pytest.raises(ValueError), scratch_tables(spark):
        table = durable(spark.range(1))
        raise ValueError
    assert not there(table)
