import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame with a given schema."""
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame(rows, schema)


#: A null text, an empty one, a repeated row, a null id, and a long text.
@pytest.fixture()
def odd_rows():
    return [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id"), (4, "word " * 30_000)]
