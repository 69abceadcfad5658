import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("AGROLENS_SCRATCH", tempfile.mkdtemp(prefix="agrolens-tests-"))
    from agrolens.session import build_session
    s = build_session("local[4]", app="agrolens-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
