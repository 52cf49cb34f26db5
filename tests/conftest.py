import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from racebook.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
