"""Every registered query runs on the smallest tables and agrees with its SQL twin."""

from __future__ import annotations

import os

import pytest

from recut.queries import load
from tests.oracle import compare, connect

ROOT = os.environ.get("RECUT_TEST_DIR", "/root/testdata/sf0.001")
REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(REGISTRY.plans))
def test_query(spark, duck, name):
    outcome = compare(spark, duck, name, REGISTRY.plans[name], REGISTRY.sql.get(name), ROOT)
    assert not outcome.startswith("FAIL"), outcome
