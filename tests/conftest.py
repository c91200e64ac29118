from __future__ import annotations

import os

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from agoraspark.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    yield s
    release(s)
    s.stop()
