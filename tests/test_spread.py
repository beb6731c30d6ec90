"""Work that must not lie in one task, however many rows a file's row group holds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import attributes, history
from tidemark.plans.spread import spread
from tidemark.streaming import stateful
from tidemark.suite import derive, record_queries, stream_queries

START = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_spread_goes_by_rows(spark):
    one = spark.range(10).coalesce(1)
    assert [spread(one, n).rdd.getNumPartitions() for n in (3, 10, 100)] == [4, 1, 1]
    assert spread(one.filter("id > 10"), 3).count() == 0
    assert sorted(r[0] for r in spread(one, 3).collect()) == list(range(10))


def test_deep_merge_shares_one_row_group(spark, tmp_path):
    rows = 2 * record_queries.MERGES_A_TASK + 1
    spark.range(rows).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"), F.lit("t").alias("p_type")
                             ).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert "RoundRobinPartitioning(3)" in plan(entry.queries()["deep_merge"](spark, str(tmp_path)))


@pytest.fixture
def places(spark, tmp_path):
    def put(name, items, schema):
        spark.createDataFrame(items, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("region", [(0, "R"), (1, "S")], "r_regionkey int, r_name string")
    put("nation", [(n, f"N{n}", n % 2) for n in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    return put, str(tmp_path)


def test_user_groups_of_repeated_users(spark, places, monkeypatch):
    put, path = places
    put("customer", [(1, 4, "AUTO"), (1, 4, "AUTO"), (1, 5, "AUTO"), (2, 24, "HOME"), (None, 3, "HOME"), (3, None, "HOME")],
        "c_custkey bigint, c_nationkey int, c_mktsegment string")
    monkeypatch.setattr(derive, "USERS_A_TASK", 2)
    found = derive.user_groups(spark, path)
    got = sorted((str(r["user"]), r["path"]) for r in found.collect())
    want = set()
    for user, nation, segment in ((1, 4, "AUTO"), (1, 5, "AUTO"), (2, 24, "HOME"), (None, 3, "HOME")):
        for n in (nation, (nation + 7) % 25):
            region = f"/{'RS'[n % 2]}"
            want |= {(str(user), p) for p in (region, f"{region}/N{n}", f"{region}/N{n}/{segment}")}
    assert got == sorted(want)
    text = plan(found)
    assert "hashpartitioning(c_custkey" in text and "RoundRobinPartitioning(3)" in text
    # the customers are never the side that is sent: the other one is a single task
    assert text.count("BuildLeft") == 0


def test_hook_leaves_rows_of_a_hot_value_where_they_are(spark):
    items = [(user, path, "k", value) for user in range(40) for path, value in (("/a", "7"), ("/a/b", "x" if user % 4 else "2"), ("/c", None))]
    items += items[:5] + [(None, "/a", "k", "x"), (None, "/b", "k", "3")]
    rows = spark.createDataFrame(items, "user int, path string, key string, value string").repartition(3, "user")
    want = sorted([(user, "k", 2.0) for user in range(0, 40, 4)] + [(-1, "k", 3.0)])

    def resolved():
        found = attributes.resolve_groups_with(rows, float)
        return plan(found), sorted((-1 if r["user"] is None else r["user"], r["key"], r["value"]) for r in found.collect())

    text, got = resolved()
    assert got == want
    # the rows are dealt once, by user: neither by value nor again for the two groupings
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(value" not in text
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert resolved()[1] == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_provider_members_are_dealt(spark, places, monkeypatch):
    put, path = places
    put("customer", [(1, 4, "AUTO"), (1, 4, "AUTO"), (2, 5, "HOME"), (4, None, "HOME"), (7, 26, "AUTO")], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    monkeypatch.setattr(derive, "USERS_A_TASK", 2)
    found = derive.provider_members(spark, path)
    text = plan(found)
    assert "RoundRobinPartitioning(3)" in text and "BuildLeft" not in text
    names = sorted((r["user_ext"], r["name"]) for r in found.collect())
    assert names == sorted([("u000000001", n) for n in ("N4", "R", "AUTO")] * 2 + [("u000000002", n) for n in ("N5", "S", "HOME")])


def test_results_are_not_sorted(spark):
    ops = spark.createDataFrame([(1,), (2,), (2,), (None,)], "op bigint")
    results = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (4, 4)], "op bigint, seq int")
    found = history.results_of(ops, results, "op")
    got = sorted((r["op"] or 0, r["seq"] or 0, r["result_status"]) for r in found.collect())
    assert got == [(0, 0, "missing"), (1, 1, "ok"), (1, 2, "ok"), (2, 0, "missing"), (2, 0, "missing")]
    text = plan(history.results_of(ops, results, "op"))
    assert "SortMergeJoin" not in text and text.count("ShuffledHashJoin") == 2


def test_exit_notices_without_a_python_call_per_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "FOLD_ROWS", 3)  # folds several times in a batch
    schema, src = "op bigint, status string, ts timestamp", str(tmp_path / "src")
    items = [(op, status, START + dt.timedelta(minutes=(op * 7 + k * 5) % 11)) for op in range(40) for k, status in enumerate(("Failed", "Running", "Error", "Failed"))]
    spark.createDataFrame(items, schema).coalesce(1).write.parquet(src)
    found = stateful.exit_notices(spark.readStream.schema(schema).parquet(src))
    assert "FlatMapGroupsInPandasWithState" not in logical(found)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()))
    want = [min((ts, status) for o, status, ts in items if o == op and status != "Running") for op in range(40)]
    assert got == [(op, status, ts) for op, (ts, status) in enumerate(want)]


def test_idle_sessions_are_session_windows(spark, tmp_path):
    schema = "user bigint, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "src"))
    activity = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
    assert "FlatMapGroupsInPandasWithState" not in logical(stateful.culled_sessions(activity, 3600))
    assert "FlatMapGroupsInPandasWithState" in logical(stateful.culled_sessions(activity, 3600, 5000))


def test_steps_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    part = stream_queries._parted(spark, spark.range(100).mapInPandas(count, "id bigint"), F.when(F.col("id") > 2, F.col("id") % 3))
    got = [sorted(r["id"] for r in part(n).collect()) for n in range(4)]
    assert got == [list(range(3, 100, 3)), list(range(4, 100, 3)), list(range(5, 100, 3)), []]
    assert seen.value == 100
