"""What the physical plans of single queries look like; `test_oracles` checks those of all."""

import re

import pytest

from wickstore.plans.queries import QUERIES


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candles_1h", "candles_1m", "candles_1d"])
def test_candles_take_one_shuffle_of_partial_results(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert plan.count("Exchange") == 1
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "missing_ts")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("value" not in columns for columns in schemas)
