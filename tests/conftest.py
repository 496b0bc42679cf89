import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
