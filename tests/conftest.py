import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4", shuffle_partitions="4", driver_memory="6g")


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row: one(expr, name=value, ...)."""
    def run(*exprs, schema=None, **values):
        df = spark.createDataFrame([tuple(values.values())] or [(0,)], schema or list(values) or ["_"])
        row = df.select(*exprs).first()
        return row[0] if len(exprs) == 1 else tuple(row)

    return run
