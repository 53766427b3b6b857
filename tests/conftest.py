import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__driver__host="127.0.0.1")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
