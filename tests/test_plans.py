"""What the plans of the catalog must and must not hold."""

import os
import re

import pytest

from caliper.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
FILES = re.compile(r"(S\d|K\d|ST|J13|Q4|V\d)")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not FILES.match(n)))
def test_no_nested_loops_and_no_row_python(name, spark):
    text = plan(catalog.queries()[name](spark, ROOT))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(catalog.queries()["S2_parquet_projection"](spark, ROOT))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    text = plan(catalog.queries()["U2_union_distinct"](spark, ROOT))
    assert "GreaterThan(l_quantity,48.0)" in text


@pytest.mark.parametrize("name", ["A3_median", "A7_global_percentiles", "A34_scale_summary", "A36_decode_comparison", "W9_selection_rank", "W13_reading_order", "W15_tail_split", "T1_multi_key_sort", "T7_seeded_shuffle", "U9_proportional_mix"])
def test_no_task_gets_all_rows(name, spark):
    """One partition takes only what an aggregate without keys hands on."""
    text = plan(catalog.queries()[name](spark, ROOT)).split("== Initial Plan ==")[-1].splitlines()
    for i, line in enumerate(text):
        if "SinglePartition" in line:
            assert "partial_" in text[i + 1], name


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["T2_head"](spark, ROOT))


def test_top_of_each_group_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.queries()["W4_top_quota"](spark, ROOT))


def test_pairs_and_densities_join_by_bands_and_bins(spark):
    """No join of a group with itself alone."""
    text = plan(catalog.queries()["J14_tolerance_pairs"](spark, ROOT))
    joins = [x for x in text.splitlines() if "Join" in x]
    assert joins and all("__band" in x for x in joins)
    text = plan(catalog.queries()["A33_point_density"](spark, ROOT))
    assert "__bin" in text and "EXP(" not in text.upper()  # no kernel of a pair


def test_averages_of_runs_are_native(spark):
    assert not re.search("Python|Pandas|Arrow|SinglePartition", plan(catalog.queries()["W10_ema"](spark, ROOT)))
