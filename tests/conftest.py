import pytest

from stockloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", "stockloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
