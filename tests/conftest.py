from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shelfmark.session import local_session

    session = local_session(str(tmp_path_factory.mktemp("shared")), "8", "shelfmark-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    path = DATA / "sf0.001"
    if not path.is_dir():
        pytest.skip("no test data")
    return str(path)
