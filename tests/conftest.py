import pytest

from idloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
