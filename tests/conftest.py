"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TESTDATA = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import build_session

    session = build_session("local[8]", "tests", 4, spark__driver__memory="6g", spark__sql__adaptive__coalescePartitions__initialPartitionNum="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return TESTDATA


def rows_of(df):
    """Rows as tuples in the order of sorted column names."""
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return rows_of
