import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from alertflow.session import get_session
    s = get_session("local[4]", app="alertflow-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="alertflow-test-"))
    yield s


@pytest.fixture
def tmpdir_work(spark):
    from alertflow.session import new_work_dir
    return new_work_dir(spark, "test")
