import pytest

from cardmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "cardmill-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.default.parallelism": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
