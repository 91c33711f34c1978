import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from netsight.session import build_session, ship_package

    session = build_session(
        "netsight-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def at(spark):
    """Rows with a time: at([(seconds, ...)], 'name type, ...') adds `ts` in front."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)

    def make(rows, columns):
        data = [(start + dt.timedelta(seconds=s), *rest) for s, *rest in rows]
        return spark.createDataFrame(data, f"ts timestamp_ntz, {columns}" if columns else "ts timestamp_ntz")

    make.start = start
    make.seconds = lambda t: (t - start).total_seconds()
    return make
