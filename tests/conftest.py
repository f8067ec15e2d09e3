from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from presswerk.session import build_session, ship_package

    session = build_session("local[4]", "tests", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
