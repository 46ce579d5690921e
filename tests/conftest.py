import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lumenfold.session import build_session

    session = build_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


def pytest_collection_modifyitems(items):
    # Cheap unit tests first, so that a broken function fails fast.
    items.sort(key=lambda i: "oracle" in i.nodeid)
