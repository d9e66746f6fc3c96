import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from murmuration.session import build_session

    s = build_session("local[4]", 8, app_name="murmuration-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="murmuration-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf001():
    if not os.path.isdir(SF001):
        pytest.skip("fixture tables not available")
    return SF001
