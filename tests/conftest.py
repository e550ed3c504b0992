import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablesight.session import local_session

    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a DataFrame from a schema string and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
