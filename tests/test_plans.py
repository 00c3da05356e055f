"""Plans are those that scale: filters and columns reach the scan, and no join is a nested loop by accident."""

import re

import pytest

from lumenframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_seven_columns_and_pushes_its_filter(spark):
    text = plan(spark, "q_flagship")
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(l_shipdate", text)
    assert len(re.search(r"ReadSchema: struct<([^>]*)", text)[1].split(",")) <= 8
    assert "partial_sum" in text


@pytest.mark.parametrize("name", ["q_topk", "q_tail"])
def test_top_k_is_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["q_asof", "q_asof_forward", "q_join_interval", "q_not_in_subquery", "q_in_subquery", "q_not_exists", "q_correlated", "q_lateral_join", "q_exists"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["q_pivot", "q_pivot_multi", "q_cube", "q_rollup", "q_agg_basic"])
def test_groups_are_summed_before_the_exchange(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["q_filter_cmp", "q_bool_tests", "q_unpivot", "q_fn_array", "q_extract_value"])
def test_projections_and_filters_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_no_sketch_for_each_key(spark):
    """A grouping by the counted column carries no sketch: it would keep and shuffle one for every key."""
    text = plan(spark, "q_approx_distinct_bounds")
    grouped = [line for line in text.splitlines() if re.search(r"Aggregate\(keys=\[l_partkey", line)]
    assert grouped and not any("approx_count_distinct" in line for line in grouped)
    assert "approx_count_distinct" in text


def test_bounds_of_odd_columns(spark, tmp_path):
    """NULLs are no value; a table without any value counts 0 both ways."""
    for name, rows in {"nulls": [(None,), (1,), (1,), (None,)], "only": [(None,)], "none": []}.items():
        spark.createDataFrame(rows, "l_partkey bigint").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert [tuple(r) for r in catalogue.QUERIES["q_approx_distinct_bounds"](spark, f"{tmp_path}/{name}").collect()] == [(True,)]
