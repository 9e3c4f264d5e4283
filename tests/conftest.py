import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rentroll.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("rentroll-tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a DDL string."""

    def build(data, ddl):
        return spark.createDataFrame(data, ddl)

    return build
