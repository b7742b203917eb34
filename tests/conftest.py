import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pacegrid.operators.skew import PARTS_SETTING, ROWS_SETTING  # noqa: E402
from pacegrid.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", partitions=4, name="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def splitting(spark):
    """Count every group of more than 20 rows as large."""
    spark.conf.set(ROWS_SETTING, "20")
    spark.conf.set(PARTS_SETTING, "6")
    yield
    spark.conf.unset(ROWS_SETTING)
    spark.conf.unset(PARTS_SETTING)
