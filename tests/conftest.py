import pytest

from graphloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()
