import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from boreflow.session import local_session

    s = local_session("2", shuffle_partitions=4, app="boreflow-tests")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
