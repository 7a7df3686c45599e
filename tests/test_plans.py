"""What the physical plans must show: pruned columns, pushed filters, summed-before-shuffled aggregates, no stray Python."""

import os

import pytest

from loomline.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, monkeypatch):
    from loomline.functions import stats

    real, plans = stats.cut_lineage, []

    def seen(df, *names):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *names)

    monkeypatch.setattr(stats, "cut_lineage", seen)  # the query's scan feeds a written table
    plan(spark, "o5_4_linear_percentiles")
    assert len(plans) == 1 and "ReadSchema: struct<lang:string,n_chars:bigint>" in plans[0] and "partial_count" in plans[0]
    assert "text" not in plan(spark, "o7_4_stratified_sample").split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    assert "In(lang, [en,fr])" in plan(spark, "o3_2_candidates")
    assert "IsNotNull(n_chars), GreaterThanOrEqual(n_chars,60)" in plan(spark, "o6_1_first_per_hash")


def test_groups_are_summed_before_the_shuffle(spark):
    for name in ("o5_7_duplicate_groups", "o5_14_paired_shares", "o6_2_first_example"):
        assert "partial_" in plan(spark, name), name


def test_samples_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "o7_4_stratified_sample")


#: Queries on transcript keys: texts with characters that NFKC changes go to Python, in one function.
KEYED = ("o4_10_eval_absent", "o5_6_speaker_candidates", "o6_2_first_example", "o8_5_leaks")


def test_native_queries_run_no_python(spark):
    for name in registry.queries():
        if name.startswith(("o3_", "o4_", "o5_", "o6_", "o7_", "o8_")):
            text = plan(spark, name)
            if name in KEYED:
                lines = [x for x in text.splitlines() if "ArrowEvalPython" in x]
                assert lines and all(x.count("normalize_transcript_exact(") == x.count("ArrowEvalPython") for x in lines), name
                text = text.replace("ArrowEvalPython", "")
            assert not any(w in text for w in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "FlatMapGroups")), name
            assert "CartesianProduct" not in text, name
