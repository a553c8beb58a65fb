"""What the physical plans must and must not hold."""

import re

import pytest

from motorpool.bindings import QUERIES
from tests.conftest import SMALL

WRITES = {"a05", "a06", "a07", "k01", "k02", "k03", "k04", "k05"}


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:3] not in WRITES))
def test_no_pairs_and_no_row_python(name, spark):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    assert ("MapInPandas" in text) == (name == "l01_map_batches")


#: Windows over all rows of a frame that has one row per partition of a written table.
PART_TOTALS = "__part"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:3] not in WRITES))
def test_no_window_sees_all_rows(name, spark):
    """A window without a partition gathers its rows in one task; only the running totals over the
    partitions of a numbering may do that."""
    logical = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for line in logical.splitlines():
        if re.match(r"[\s:+|-]*Window \[", line) and re.search(r"windowspecdefinition\((?!\w+#\d+, )\w*", line):
            spec = line.split("windowspecdefinition(")[1]
            if re.match(r"[^,]+ (ASC|DESC)", spec):
                assert PART_TOTALS in spec, line[:300]


def test_elapsed_horizon_bounds_reach_the_scan(spark):
    text = plan(spark, "b07_filter_horizon_elapsed")
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


@pytest.mark.parametrize("name", ["e03_top_n_per_key", "c09_latest_per_key_all", "c09_latest_per_key_one", "j11_context_window"])
def test_top_n_is_cut_before_the_shuffle(name, spark):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize(
    "name, column",
    [("b03_filter_since_hours", "GreaterThanOrEqual(ts"), ("b01_filter_equals", "EqualTo(l_returnflag"), ("b08_filter_in", "In(o_orderpriority")],
)
def test_filters_reach_the_scan(name, column, spark):
    assert column in plan(spark, name)


def test_scans_read_only_their_columns(spark):
    assert "ReadSchema: struct<l_returnflag:string>" in plan(spark, "d01_conditional_share")
