"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from granary.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("granary-tests", cores="4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()
