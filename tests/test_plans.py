"""Physical plans: what is pushed to the scan, read and joined."""

import re

import pytest

from tessella.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalogue.QUERIES["task_by_id"](spark, sf_dir))
    assert "EqualTo(o_orderkey,42)" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>", text)
    text = plan(catalogue.QUERIES["in_list_filter"](spark, sf_dir))
    assert "In(p_brand" in text and "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in text


@pytest.mark.parametrize("name", ["window_feature_join", "window_feature_semi", "window_in_zone_semi", "stack_crop", "flagship_sample_manifest"])
def test_range_joins_are_equi_joins(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["mask_rle_text", "chip_resample_nearest", "l2_normalize", "tile_rowcol", "signal_clip", "bbox_scan", "class_code_join", "spot_windows"])
def test_projections_have_no_shuffle_and_no_python(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "Python" not in text and "Pandas" not in text
