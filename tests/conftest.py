from __future__ import annotations

import pytest

from weekloom.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "weekloom-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def nothing_stays_cached(request):
    """What a test caches is not seen by the tests after it."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
