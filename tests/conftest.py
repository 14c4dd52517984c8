from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]

from sievelight.operators.lanes import ROWS_PER_SLICE  # noqa: E402
from sievelight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.log.level": "ERROR"})
    yield s
    s.stop()


@pytest.fixture
def sliced(spark):
    """Make every lane of more than ``rows`` rows run in slices."""
    def on(rows: int) -> None:
        spark.conf.set(ROWS_PER_SLICE, str(rows))
    yield on
    spark.conf.unset(ROWS_PER_SLICE)
