import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session()
