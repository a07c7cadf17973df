import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from dunning.session import local_session

    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = local_session("4", shuffle_partitions=8, app="dunning-tests", **shared)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.oracle_check import duck

    return duck("/root/testdata/sf0.001")
