import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabloom.session import checkpoint_dir, get_session
    s = get_session("local[*]", 8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def registry():
    from tabloom.plans import registry as r
    r.load_all()
    return r


@pytest.fixture(scope="session")
def duck():
    from tests.oracle_check import duck as mk
    return mk(SMOKE)
