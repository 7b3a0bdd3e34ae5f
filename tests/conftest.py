from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "docloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def go(spark):
    """One Go file per argument, named f0.go, f1.go, ..."""

    def make(*contents: str):
        return spark.createDataFrame([(f"f{i}.go", c) for i, c in enumerate(contents)], "path string, content string")

    return make
