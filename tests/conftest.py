import pytest

from clearcharge.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
