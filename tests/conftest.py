from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from demandloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", 4, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a DataFrame as dicts in a stable order."""

    def collect(df, *order):
        return [r.asDict() for r in df.orderBy(*(order or df.columns)).collect()]

    return collect
