import os

import pytest

from platewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def table(spark):
    """Rows of tuples as a DataFrame with the given DDL schema."""

    def make(schema: str, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def rows():
    """A DataFrame's rows as plain tuples, in order."""
    return lambda df: [tuple(r) for r in df.collect()]
