"""Bootstraps over items: digests in numpy, and totals by what items hold instead of rows per item and draw."""

import hashlib

import pytest

from scenemill.operators import digests
from scenemill.operators import stats as st
from scenemill.plans import registry


@pytest.mark.parametrize("prefix", [b"items:7:", b"x" * 46 + b":3:", b"y" * 52, b"z" * 70 + b":"])
def test_digests_are_those_of_the_library(prefix):
    for lo, hi in ((0, 10), (95, 130), (9998, 10012)):
        got = [v for _, run in digests.runs(lo, hi) for v in run.first_48(prefix).tolist()]
        assert got == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:12], 16) for i in range(lo, hi)]


def test_totals_are_those_of_the_weights(spark):
    rows = [(None if i == 3 else f"i{i}", tag, i % 3 == 0, None if i % 5 == 0 else i % 2 == 0) for i in range(150) for tag in ("a", "b")[: 1 + i % 2]]
    cells = spark.createDataFrame(rows, "item string, tag string, y boolean, yhat boolean")
    plain = st.bootstrap(cells, st.hashed_weights(cells, "item", "s", 90), "item", ["tag"]).collect()
    found = st.bootstrap_items(cells, "item", ["tag"], "s", 90).select(*plain[0].__fields__).collect()
    assert sorted(found) == sorted(plain)


def test_differences_are_those_of_the_weights(spark):
    rows = [(i // 2, None if i % 11 == 0 else i % 2, i % 3) for i in range(200)]
    labels = spark.createDataFrame(rows, "item long, a int, b int")
    plain = st.bootstrap_difference(labels, st.hashed_weights(labels, "item", "s", 50), "item", "a", "b").collect()
    assert sorted(st.bootstrap_item_difference(labels, "item", "a", "b", "s", 50).collect()) == sorted(plain)


@pytest.mark.parametrize("name", ["item_bootstrap", "design_effect"])
def test_no_row_per_item_and_draw(spark, name):
    plan = registry.load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
