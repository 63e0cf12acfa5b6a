"""Plan shapes: no Python in native queries, no single-task window, no Cartesian product."""

import pytest

from corpuslens.plans import catalog as contract

STREAMS = {name for name in contract.queries() if name.startswith(("st", "sr"))} | {"r3_r5_rewritten_table"}
NATIVE = sorted(set(contract.queries()) - STREAMS)


@pytest.mark.parametrize("name", NATIVE)
def test_plan(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct"):
        assert forbidden not in plan
    lines = plan.split("\n")
    for above, below in zip(lines, lines[1:]):
        # A window right above a gather into one partition would run in a single task.
        assert not ("Window" in above and "SinglePartition" in below)
    for line in lines:
        if "FileScan parquet" in line and "documents" in line:
            assert "ReadSchema" in line


@pytest.mark.parametrize("name", ["a1_file_coverage", "a2_block_counters", "a13_diagnostic_funnel", "r7_lifecycle", "w2_latest_run"])
def test_aggregates_combine_before_the_shuffle(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan


def test_columns_are_pruned(spark, sf_dir):
    plan = contract.queries()["a1_file_coverage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    plan = contract.queries()["r2_run_list"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in plan


@pytest.mark.parametrize("name", ["b1_b5_block_spans", "b6_block_analysis", "b7_module_rows", "b8_blueprint"])
def test_segmentation_reads_content_once_and_shuffles_nothing(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan parquet") == 1


def test_patched_lines_leave_their_row_only_when_merged(spark, sf_dir):
    plan = contract.queries()["w6_patched_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text:string") == 1 and "Window" not in plan
    hashed = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(hashed) == 1 and "SortMergeJoin" not in plan


def test_main_flow_scans_text_twice(spark, sf_dir):
    query = contract.queries()["flow_patched_files"](spark, sf_dir)
    plan = query._jdf.queryExecution().executedPlan().toString()
    # Once before, for the written items, and once here.
    assert plan.count("text:string") == 1
