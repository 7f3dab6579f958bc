"""Plan-shape guards: the scale properties of key operators, checked on sf0.001 plans."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan))


@pytest.mark.parametrize("name,most", [
    ("agg24_score_report", 3),            # cells -> per-label -> group, one scan
    ("join10_latest_definition", 1),      # texts clustered by document once
    ("join14_reindex_edges", 1),
    ("flt05_drop_dead_declarations", 1),  # segmentation + per-program pass share the partitioning
    ("fea04_java_counts", 1),
    ("prj15_merge_user_turns", 1),        # one fold per conversation
])
def test_shuffle_budget(spark, name, most):
    assert _exchanges(_plan(spark, name)) <= most


def test_score_report_has_no_join(spark):
    plan = _plan(spark, "agg24_score_report")
    assert "Join" not in plan and len(re.findall(r"FileScan parquet", plan)) == 1


def test_iterative_graph_plan_is_flat(spark):
    assert _exchanges(_plan(spark, "join08_rollup_callee_features")) == 0


def test_scan_pruning_and_pushdown(spark):
    plan = _plan(spark, "prj05_strip_comments_c")
    assert "EqualTo(o_orderstatus,F)" in plan
    li = re.search(r"FileScan parquet \[[^\]]*\][^\n]*?ReadSchema: (struct<[^>]*>)", _plan(spark, "agg24_score_report")).group(1)
    assert "l_extendedprice" not in li and "l_shipdate" not in li
