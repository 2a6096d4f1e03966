import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("WEARLINE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from wearline.session import build_session

    ckpt = tempfile.mkdtemp(prefix="wearline-test-ckpt-")
    s = build_session("local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    from tools.check_oracle import duck as make

    return make(sf)


@pytest.fixture(scope="session")
def readings(spark, sf):
    from wearline.plans import tables

    return tables.readings(spark, sf)
