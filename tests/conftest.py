from __future__ import annotations

import os

import pytest

SF = os.environ.get("LOGWARDEN_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from logwarden.session import local_session

    session = local_session(cores="4", shuffle_partitions=4, app="logwarden-tests")
    yield session
    session.stop()


@pytest.fixture
def fresh_dir(tmp_path):
    return str(tmp_path)
