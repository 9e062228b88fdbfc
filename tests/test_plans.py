"""Plans hold what the design promises: pushed filters, pruned columns, one aggregation, no cross products of tables."""

import re

import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_asof_scans_what_it_needs(spark):
    text = plan(catalog.QUERIES["asof_matrix"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(ts", text) and re.search(r"PushedFilters: \[[^\]]*In\(event_type", text)
    assert "props" not in text and text.count("MapInArrow") == text.count("ArrowEvalPython") == 0


@pytest.mark.parametrize("name", ["pearson_pairs", "profile_numeric", "chi2_cramers_v", "dedupe_keep_first", "lead_score", "evalue_combine", "referee_chow", "usage_rollup"])
def test_hot_paths_stay_in_the_jvm(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search("Python|MapInArrow|MapInPandas", text)


@pytest.mark.parametrize("name", ["pearson_pairs", "merge_outer", "lag_correlation", "market_pairs", "twin_segments", "asof_matrix"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SF))


def test_all_pairs_in_one_pass(spark):
    text = plan(catalog.QUERIES["pearson_pairs"](spark, SF))
    assert text.count("Scan parquet") == 1 and "l_shipdate" not in text
