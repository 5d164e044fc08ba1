"""Inputs are read as Spark reads them, and work folders are shared ones."""

import pytest

from alertflow import session
from alertflow.plans import fixtures as fx
from conftest import SF001


def test_tables_are_read_without_a_shuffle(spark):
    plan = fx.read_table(spark, SF001, "events")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


class _Cluster:
    """A session without a checkpoint folder, on some master."""

    def __init__(self, master):
        self.master = master
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.work_root(_Cluster(master))
