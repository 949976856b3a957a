import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"
CHECK_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rostercast.session import local_session

    s = local_session(4, shuffle_partitions=4, app="rostercast-tests")
    yield s
    s.stop()
