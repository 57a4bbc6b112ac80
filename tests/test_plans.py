"""Plans: filters and columns reach the scans, limits reach the windows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ionquarry.operators import lookup, topk
from ionquarry.plans.views import VIEWS, view

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    text = plan(orders.where(F.col("o_orderkey") == 7).select("o_orderkey", "o_totalprice"))
    assert "EqualTo(o_orderkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    found = lookup.metadata_by_ids(view(spark, DATA, "v_spectra"), lookup.request(spark, ["1"]), ["precursor_mz"])
    assert "o_orderdate" not in plan(found) and "o_orderstatus" not in plan(found)


def test_top_k_is_cut_before_the_shuffle(spark):
    e = view(spark, DATA, "v_embeddings")
    text = plan(topk.dense(e.withColumnRenamed("pos", "query_ix"), e, 5))
    assert text.count("WindowGroupLimit") >= 2


def test_views_are_the_same_text_for_both_engines():
    assert all("{" in sql for sql in VIEWS.values())
