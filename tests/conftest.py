import sys
import tempfile
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tenora.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tenora-warehouse-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as dicts, sorted by the given columns."""

    def read(df, *by):
        got = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(got, key=lambda r: [(r[c] is not None, r[c]) for c in by]) if by else got

    return read
