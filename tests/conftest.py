from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from foliodex.session import local_session

    return local_session("tests", 4, spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
