"""Every registered query against its SQL text, on the smallest test set."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402

FOLDER = os.environ.get("CATALENS_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    from check import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    from check import compare

    state, rows, detail = compare(spark, duck, name, FOLDER)
    assert state in ("ok", "rows only"), detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0
