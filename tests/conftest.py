import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session
    from priorline.sources.durable import drop_durable

    spark = session("4")
    yield spark
    drop_durable(spark)
