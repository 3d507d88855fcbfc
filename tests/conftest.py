from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from fleetwake.session import session

    s = session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
