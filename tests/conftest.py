import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablestory.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows from dictionaries, numbered so that their order is stated."""
    def make(records: list[dict], schema: str | None = None):
        numbered = [{**r, "__n": i} for i, r in enumerate(records)]
        if schema:
            return spark.createDataFrame([tuple(r.values()) for r in numbered], schema + ", __n int")
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(numbered))

    return make
