import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quire.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app_name="quire-tests")
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    import tempfile

    return tempfile.mkdtemp(prefix="quire-test-")
