import pytest

from lakeloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
