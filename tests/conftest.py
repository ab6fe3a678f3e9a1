import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from drawlytics.session import local_session

    return local_session("tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def idx(spark, sf_dir):
    """Single history."""
    from drawlytics.catalog import inputs

    return inputs.stored(inputs.idx(spark, sf_dir, False), "test-idx")


@pytest.fixture(scope="session")
def series_idx(spark, sf_dir):
    from drawlytics.catalog import inputs

    return inputs.stored(inputs.idx(spark, sf_dir), "test-series-idx")
