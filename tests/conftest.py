import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield (s := compare.session())
    s.stop()


@pytest.fixture(scope="session")
def duck():
    return compare.engine("sf0.001")
