"""Plan shapes that must hold at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import history, notify
from tidemark.plans.skew import MAX_SMALL_ROWS, small_frame
from tidemark.sources import topics
from tidemark.suite import derive, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(n for n in registry.QUERIES if not n.startswith("stream_"))


# numbering adds up one row per partition in a window of its own
NUMBERING = {"assign_ids", "store_apply", "store_apply_rejects"}


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(spark, name):
    """No pair joins, no row-at-a-time Python, no window over all rows in one task."""
    text = plan(entry.queries()[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert node not in text
    if "Window" in text and name not in NUMBERING:
        assert "SinglePartition" not in text


def test_topic_is_pruned_and_columns_are_few(spark, tmp_path):
    path = str(tmp_path / "t")
    topics.write_topic(derive.cdc_topic(spark, SF), path)
    text = plan(topics.read_topic(spark, path, "shop0.cdc.even").select("offset"))
    assert "PartitionFilters: [isnotnull(topic" in text
    assert "ReadSchema: struct<offset:bigint>" in text


def test_later_pages_filter_in_the_scan(spark):
    ops = derive.operations(spark, SF).select("name", "status", "create_time")
    rows = ops.filter(F.col("create_time") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan(rows)
    assert history.page(ops, None, 5)[1] is not None


def test_json_is_parsed_once_per_message(spark):
    text = plan(notify.match_rules(
        topics.good_events(derive.cdc_topic(spark, SF)).select("message_type", "operation", "uid"),
        notify.rule_frame(spark, [{"app": "a", "message_type": "even", "events": ["create"]}]),
    ))
    assert text.count("from_json(") == 1


def test_relations_of_one_frame_are_grouped_once(spark):
    text = plan(entry.queries()["user_details"](spark, SF))
    assert text.count("orders.parquet") == 1


def test_results_are_read_twice_at_most(spark):
    text = plan(entry.queries()["op_results"](spark, SF))
    assert text.count("lineitem.parquet") <= 2 and text.count("orders.parquet") <= 2


def test_only_short_lists_are_broadcast(spark):
    short = small_frame(spark, [(1,)], "a int")
    long = small_frame(spark, [(i,) for i in range(MAX_SMALL_ROWS + 1)], "a int")
    hinted = ["Hint" in f._jdf.queryExecution().logical().toString() for f in (short, long)]
    assert hinted == [True, False]
