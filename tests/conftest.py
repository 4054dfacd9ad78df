import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import datetime as dt

import pytest

from seagrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    """Day n of January 2024; runs on into later months."""
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)
