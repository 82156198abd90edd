import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidewire.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def articles(spark):
    """Build an article table from (ticker, ord, date, headline, source, summary) tuples."""
    from tidewire.schemas import NEWS, RAW_NEWS
    import datetime as dt

    def make(rows, raw=False):
        if raw:
            return spark.createDataFrame(rows, RAW_NEWS)
        rows = [(t, o, dt.date.fromisoformat(d), h, s, m) for t, o, d, h, s, m in rows]
        return spark.createDataFrame(rows, NEWS)

    return make
