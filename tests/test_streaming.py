"""Streams: restart, repeats, bad rows, late changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import topics
from tidemark.streaming import consume as st
from tidemark.streaming import groups
from tidemark.streaming import identity as sync
from tidemark.streaming import stateful
from tidemark.streaming.keyed import KeyedTable

GOOD = '{{"message_type":"t","operation":"{op}","uid":"{uid}","resource":{{"v":{v}}},"meta":{{"app_name":"a"}}}}'


def messages(spark, items):
    start = dt.datetime(2024, 1, 1)
    rows = [(str(o), v, "a.cdc.t", 0, o, start + dt.timedelta(seconds=o)) for o, v in items]
    return spark.createDataFrame(rows, topics.TOPIC_SCHEMA)


def event(offset, uid, op="update", v=0):
    return offset, GOOD.format(op=op, uid=uid, v=v)


def test_consume_skips_bad_rows_and_resumes(spark, tmp_path):
    src, out, bad, mark = (str(tmp_path / n) for n in ("src", "out", "bad", "mark"))
    schema = topics.good_events(messages(spark, [])).schema

    def run():
        stream = topics.stream_topic(spark, src)
        st.run_to_end(st.consume(
            stream, lambda df, n: st.write_batch(df, out, n), mark, lambda df, n: st.write_batch(df, bad, n)
        ))

    topics.write_topic(messages(spark, [event(0, "x"), (1, "{broken"), event(2, "y")]), src)
    run()
    topics.write_topic(messages(spark, [event(3, "z")]), src)
    run()
    run()
    assert sorted(r["offset"] for r in st.read_batches(spark, out, schema).collect()) == [0, 2, 3]
    assert [r["reason"] for r in spark.read.parquet(bad).collect()] == ["not_json"]


def test_repeated_batch_does_not_count_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(5).toDF("a")
    st.write_batch(df, out, 0)
    st.write_batch(df, out, 0)
    st.write_batch(df, out, 1)
    assert st.read_batches(spark, out, df.schema).count() == 10


def test_state_ignores_late_older_changes_and_compacts(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = topics.good_events(messages(spark, [])).schema

    def run():
        st.run_to_end(st.maintain_state(topics.good_events(topics.stream_topic(spark, src)), out, mark))

    topics.write_topic(messages(spark, [event(5, "x", v=5), event(6, "y", "delete"), event(2, "z")]), src)
    run()
    topics.write_topic(messages(spark, [event(3, "x", v=3), event(4, "y"), event(7, "z", "delete"), event(8, "w")]), src)
    run()
    want = [("w", 8), ("x", 5)]

    def shown():
        return sorted((r["uid"], r["offset"]) for r in st.current_state(spark, out, schema).collect())

    assert shown() == want
    st.compact_state(spark, out, schema)  # the newest batch is left alone, so there is nothing to fold yet
    assert shown() == want and sorted(st.committed_batches(spark, out)) == [0, 1]
    topics.write_topic(messages(spark, [event(1, "y"), event(9, "x", v=9)]), src)
    run()
    st.compact_state(spark, out, schema)
    assert shown() == [("w", 8), ("x", 9)] and sorted(st.committed_batches(spark, out)) == [-2, 0, 1, 2]
    for offset in (10, 11):
        topics.write_topic(messages(spark, [event(offset, "v")]), src)
        run()
    st.compact_state(spark, out, schema)
    assert shown() == [("v", 11), ("w", 8), ("x", 9)] and sorted(st.committed_batches(spark, out)) == [-4, -2, 2, 3, 4]


def test_compaction_leaves_a_batch_that_is_written_meanwhile(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "a bigint, n bigint"

    def rows(a):
        return spark.createDataFrame([(a, 1)], schema)

    def total():
        return {r["a"]: r["n"] for r in st.read_batches(spark, out, schema).groupBy("a").sum("n").withColumnRenamed("sum(n)", "n").collect()}

    def fold(df):
        # a batch is committed, and another one begun, after the folder was listed
        st.write_batch(rows(4), out, 3)
        spark.createDataFrame([(9, 1)], schema).write.parquet(f"{out}/batch_id=4/_temporary/0")
        return df.groupBy("a").agg(F.sum("n").alias("n"))

    for n in range(3):
        st.write_batch(rows(n), out, n)
    st.compact(spark, out, schema, fold)
    assert total() == {0: 1, 1: 1, 2: 1, 4: 1}
    st.write_batch(rows(0), out, 0)  # a folded batch written again does not count twice
    assert total() == {0: 1, 1: 1, 2: 1, 4: 1}
    st.write_batch(rows(5), out, 4)
    st.compact(spark, out, schema, lambda df: df.groupBy("a").agg(F.sum("n").alias("n")))
    assert total() == {0: 1, 1: 1, 2: 1, 4: 1, 5: 1} and 0 not in st.committed_batches(spark, out)


def test_handler_errors_stay_with_their_row(spark):
    df = topics.good_events(messages(spark, [event(0, "x"), event(1, "boom"), event(2, "y")]))

    def handler(row):
        if row["uid"] == "boom":
            raise ValueError("no")
        return row["uid"].upper()

    got = {r["offset"]: (r["result"], r["error"]) for r in st.handle_rows(df, handler).collect()}
    assert got == {0: ("X", None), 1: (None, "ValueError: no"), 2: ("Y", None)}


def test_dedup_across_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    keys = ["topic", "key", "offset"]

    def run(offsets):
        messages(spark, [event(o, str(o)) for o in offsets]).write.mode("append").parquet(src)
        stream = spark.readStream.schema(topics.TOPIC_SCHEMA).parquet(src).select(*keys, "timestamp")
        st.run_to_end(st.distinct_messages(stream, keys, out, mark, "timestamp"))

    run([90_000, 90_001])
    run([2, 3, 90_001])  # more than a day late
    found = st.first_rows(spark, out, "topic string, key string, offset bigint, timestamp timestamp", keys, "timestamp")
    assert sorted(r["offset"] for r in found.collect()) == [2, 3, 90_000, 90_001]


def test_first_terminal_takes_late_rows(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    start = dt.datetime(2024, 1, 1)
    schema = "op string, status string, ts timestamp"

    def run(items):
        rows = [(op, status, start + dt.timedelta(minutes=m)) for op, status, m in items]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        st.run_to_end(st.first_terminal_stream(spark.readStream.schema(schema).parquet(src), out, mark))

    run([("a", "Running", 0), ("a", "Succeeded", 9000), ("b", "Pending", 9000)])
    run([("a", "Failed", 2), ("b", "Failed", 3)])
    found = st.first_rows(spark, out, "op string, ts timestamp, status string", ["op"], "ts")
    assert sorted((r["op"], r["status"]) for r in found.collect()) == [("a", "Failed"), ("b", "Failed")]


def test_sessions_take_late_rows_and_show_open_ones(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    start = dt.datetime(2024, 1, 1)

    def run(items):
        rows = [(u, start + dt.timedelta(minutes=m)) for u, m in items]
        spark.createDataFrame(rows, "user bigint, ts timestamp").write.mode("append").parquet(src)
        stream = spark.readStream.schema("user bigint, ts timestamp").parquet(src)
        st.run_to_end(st.sessions_stream(stream, out, mark, 3600))

    run([(1, 0), (1, 100), (2, 1000)])
    run([(1, 50), (3, 5)])
    found = st.current_sessions(spark, out, timeout=3600).collect()
    assert sorted((r["user"], r["n_events"], r["open"]) for r in found) == [(1, 3, False), (2, 1, True), (3, 1, False)]


def test_failing_handler_gives_bad_rows_first_and_frees_the_batch(spark, tmp_path):
    src, bad, mark = (str(tmp_path / n) for n in ("src", "bad", "mark"))
    topics.write_topic(messages(spark, [event(0, "x"), (1, "{broken")]), src)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())

    def handler(df, n):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        st.run_to_end(st.consume(topics.stream_topic(spark, src), handler, mark, lambda df, n: st.write_batch(df, bad, n)))
    assert [r["reason"] for r in spark.read.parquet(bad).collect()] == ["not_json"]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def admin(spark, items):
    return spark.createDataFrame(
        [(kind, op, f"x/{i}/more", n) for n, (kind, op, i) in enumerate(items)],
        "resource_type string, operation_type string, resource_path string, seq bigint")


def provider(spark, users, groups=(), members=()):
    kinds = ("ext_id string, username string, email string, enabled boolean", "ext_id string, name string",
             "user_ext string, kind string, ext_id string, name string")
    frames = [spark.createDataFrame(list(rows), kind) for rows, kind in zip((users, groups, members), kinds)]
    return sync.Source(*[lambda f=f: f for f in frames])


def test_identity_batches_use_the_state_of_earlier_ones(spark, tmp_path):
    store = sync.IdentityStore(spark, str(tmp_path / "store"), buckets=4)
    store.users.load(spark.createDataFrame([("t1", "ann", None), ("t2", "old", "e2"), ("t3", "cid", "e9")], "target_id string, name string, ext_id string"))

    def users():
        return sorted((r["target_id"], r["name"], r["ext_id"], r["active"]) for r in store.users.records().collect())

    def refused():
        return sorted(tuple(r) for r in st.read_batches(spark, store.refused, sync.REFUSED).select(st.BATCH, "kind", "ext_id", "label").collect())

    first = provider(spark, [("e1", "ann", None, None), ("e2", "bob", None, None), ("e3", None, "dan@x", None), ("e4", "", "", None), ("e5", "cid", None, None)],
                     [("g1", "staff")], [("e1", "group", None, "staff"), ("e1", "group", None, "all"), ("e2", "organization", "o1", "Org"), ("e5", "group", None, "no")])
    events = admin(spark, [("USER", "UPDATE", i) for i in ("e1", "e2", "e3", "e4", "e5")] + [("GROUP", "UPDATE", "g1"), ("CLIENT", "UPDATE", "e1")])
    for _ in range(2):  # a batch that is repeated after a failure gives the same
        store.apply(events, 0, first)
        assert users() == [("new-e3", "dan@x", "e3", True), ("t1", "ann", "e1", True), ("t2", "bob", "e2", True), ("t3", "cid", "e9", True)]
        assert refused() == [(0, "user", "e4", "rejected"), (0, "user", "e5", "conflict")]
        assert sorted((r["name"], r["target_id"], r["ext_id"]) for r in store.groups.records().collect()) == [("all", "new-all", None), ("staff", "new-g1", "g1")]
        held = sorted(tuple(r) for r in store.members.read().collect())
        assert held == [("e1", "group", "new-all"), ("e1", "group", "new-g1"), ("e2", "organization", "new-o1")]
    # the name that e2 gives up is free from the next batch on; a deleted user is inactive, memberships follow
    second = provider(spark, [("e2", "bobby", None, None), ("e6", "bob", None, None), ("e3", "dan", None, True)], [("g1", "team")], [("e2", "group", None, "all")])
    store.apply(admin(spark, [("USER", "UPDATE", "e2"), ("USER", "UPDATE", "e6"), ("USER", "UPDATE", "e1"), ("USER", "DELETE", "e1"), ("USER", "DELETE", "e3"), ("GROUP", "UPDATE", "g1")]), 1, second)
    assert users() == [("new-e3", "dan", "e3", True), ("t1", "ann", "e1", False), ("t2", "bobby", "e2", True), ("t3", "cid", "e9", True)]
    assert refused()[-1] == (1, "user", "e6", "conflict")
    assert sorted(tuple(r) for r in store.members.read().collect()) == [("e2", "group", "new-all")]
    store.apply(admin(spark, [("GROUP_MEMBERSHIP", "CREATE", "e6")]), 2, second)
    assert ("new-e6", "bob", "e6", True) in users()
    assert sorted((r["name"], r["target_id"]) for r in store.groups.records().collect()) == [("all", "new-all"), ("team", "new-g1")]
    for table in (store.users.entries, store.members):
        table.vacuum(2)
    assert ("new-e6", "bob", "e6", True) in users() and len(users()) == 5


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "keyed"), "key string, v bigint", "key", 32)
    table.load(spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v")))
    before = {r["key"]: r["v"] for r in table.read().collect()}
    for n, keys in enumerate((["k1", "k2", "k3"], ["k7"], ["new"])):
        rows = spark.createDataFrame([(k, -1) for k in keys], table.schema)
        table.replace(rows, rows.select("key"), n)
        assert 0 < len(table.last_read) <= len(keys)
        before |= dict.fromkeys(keys, -1)
        assert {r["key"]: r["v"] for r in table.read().collect()} == before and len(table.last_read) == 32
    assert {f.split("bucket=")[1].split("/")[0] for f in table.read(3, [0]).inputFiles()} == {"0"}
    # the state before a batch stays readable while its versions are kept
    assert {r["key"]: r["v"] for r in table.read(1).collect()}["k7"] == 7


START = dt.datetime(2024, 1, 1)


def steps_of(spark, tmp_path, schema, start):
    """Give each step's rows to the stream and return what its sink holds."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    stateful.use_rocksdb(spark)

    def run(items):
        spark.createDataFrame(items, schema).write.mode("append").parquet(src)
        df = start(spark.readStream.schema(schema).parquet(src))
        st.run_to_end(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))
        return sorted(map(tuple, spark.read.schema(df.schema).parquet(out).collect()))

    return run


def test_exit_notice_is_sent_once(spark, tmp_path):
    at = [START + dt.timedelta(minutes=m) for m in range(10)]
    run = steps_of(spark, tmp_path, "op string, status string, ts timestamp", stateful.exit_notices)
    first = run([("a", "Running", at[0]), ("a", "Succeeded", at[5]), ("a", "Failed", at[3]), ("b", "Pending", at[9]), (None, "Failed", at[1])])
    assert first == [("a", "Failed", at[3])]
    assert run([("a", "Error", at[1]), ("a", "Failed", at[3]), ("b", "Skipped", at[2])]) == [("a", "Failed", at[3]), ("b", "Skipped", at[2])]
    assert len(run([("a", "Error", at[1]), ("b", "Skipped", at[2])])) == 2


def plain_culls(rows, timeout, max_age, every, end):
    """Walk the checks one by one."""
    out, users = [], {u for u, _ in rows}
    for user in users:
        moments, session = sorted(s for u, s in rows if u == user), None
        for tick in range(0, end, every):
            for s in [m for m in moments if tick - every < m <= tick]:
                session = (session[0], s) if session else (s, s)
            if session and max_age and tick - session[0] > max_age and not tick - session[1] > timeout:
                out.append((user, tick, "age"))
                session = None
            elif session and tick - session[1] > timeout:
                out.append((user, tick, "idle"))
                session = None
    return sorted(out)


@pytest.mark.parametrize("max_age", [0, 5000])
def test_culled_sessions(spark, tmp_path, max_age):
    rng = random.Random(max_age)
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    rows = sorted(((u, s) for u in (1, 2, 3) for s in rng.sample(range(0, 60_000, 50), 40)), key=lambda r: r[1])
    rows += [(u, s) for u, s in [(7, 600), (7, 600 + 3600), (8, 0)]]  # just at a check; long over the limit
    rows.sort(key=lambda r: r[1])
    run = steps_of(spark, tmp_path, "user bigint, ts timestamp", lambda df: stateful.culled_sessions(df, 3600, max_age, 600))

    def given(part):
        return [(u, START + dt.timedelta(seconds=s)) for u, s in part]

    for k in range(3):
        run(given(rows[k * 40:(k + 1) * 40]))
    run(given(rows[120:]))
    found = run(given([(0, 80_000)]))
    got = sorted((u, int((t - START).total_seconds()), r) for u, t, r in found if u)
    assert base % 600 == 0 and got == plain_culls(rows, 3600, max_age, 600, 80_000)


def test_results_in_and_after_the_limit(spark, tmp_path):
    def minute(m):
        return START + dt.timedelta(minutes=m)

    paths = {n: str(tmp_path / n) for n in ("ops", "results", "in", "late", "m1", "m2")}
    kinds = {"ops": "op bigint, start_ts timestamp", "results": "op bigint, seq int, ts timestamp"}

    def run(ops, results):
        for name, rows in (("ops", ops), ("results", results)):
            spark.createDataFrame(rows, kinds[name]).write.mode("append").parquet(paths[name])
        read = [spark.readStream.schema(kinds[n]).parquet(paths[n]) for n in ("ops", "results")]
        for df, out, mark in ((stateful.results_in_time(*read, 300), "in", "m1"), (stateful.results_too_late(*read, 300, 3600), "late", "m2")):
            st.run_to_end(df.select("op", "seq").writeStream.format("parquet").option("path", paths[out]).option("checkpointLocation", paths[mark]))

    run([(1, minute(0)), (2, minute(0)), (3, minute(1))], [(1, 1, minute(2)), (2, 1, minute(6))])
    run([(4, minute(10))], [(1, 2, minute(5)), (1, 3, minute(7)), (4, 1, minute(15))])
    run([(9, minute(500))], [(9, 1, minute(500))])
    schema = "op bigint, seq int"
    got = sorted((r["op"], r["seq"] or 0) for r in spark.read.schema(schema).parquet(paths["in"]).collect() if r["op"] < 9)
    assert got == [(1, 1), (1, 2), (2, 0), (3, 0), (4, 1)]
    late = sorted((r["op"], r["seq"]) for r in spark.read.schema(schema).parquet(paths["late"]).collect())
    assert late == [(1, 3), (2, 1)]


def test_consumer_groups(spark, tmp_path):
    src, offsets = (str(tmp_path / n) for n in ("src", "offsets"))
    start = dt.datetime(2024, 1, 1)

    def send(*items):
        topics.write_topic(spark.createDataFrame([("k", "v", t, p, o, start) for t, p, o in items], topics.TOPIC_SCHEMA), src)

    def places(df):
        return sorted((r["topic"], r["partition"], r["offset"]) for r in df.collect())

    def unread(group, names=("a", "b"), most=None):
        return places(groups.poll(spark, src, offsets, group, names, most))

    assert unread("g") == [] and groups.consume_group(spark, src, offsets, "g", ["a"], lambda batch, n: None) == 0
    send(("a", 0, 0), ("a", 0, 1), ("a", 1, 7), ("b", 0, 0))
    batch = groups.poll(spark, src, offsets, "g", ["a"])
    send(("a", 0, 2), ("a", 1, 9))
    assert places(batch) == [("a", 0, 0), ("a", 0, 1), ("a", 1, 7)]  # what came later is not in it
    assert groups.commit(batch, offsets, "g") == 0
    assert unread("g") == [("a", 0, 2), ("a", 1, 9), ("b", 0, 0)]
    # a new partition of a known topic, and a new topic
    send(("a", 2, 0), ("c", 5, 3))
    assert unread("g", ["a", "c", "c"]) == [("a", 0, 2), ("a", 1, 9), ("a", 2, 0), ("c", 5, 3)]
    assert {(r["topic"], r["partition"]): r["behind"] for r in groups.lag(spark, src, offsets, "g", ["a"]).collect()} == {
        ("a", 0): 1, ("a", 1): 1, ("a", 2): 1}
    # another group has its own offsets; a limit counts from the first unread offset, over gaps too
    seen = []
    polls = groups.consume_group(spark, src, offsets, "h", ["a"], lambda batch, n: seen.append((n, places(batch))), most=2)
    assert (polls, [n for n, _ in seen]) == (2, [0, 1])
    assert seen[0][1] == [("a", 0, 0), ("a", 0, 1), ("a", 1, 7), ("a", 2, 0)] and seen[1][1] == [("a", 0, 2), ("a", 1, 9)]
    assert unread("h", ["a"]) == []


def test_failed_consumer_gets_its_messages_again(spark, tmp_path):
    src, offsets, out = (str(tmp_path / n) for n in ("src", "offsets", "out"))
    topics.write_topic(messages(spark, [event(i, "x") for i in range(4)]), src)

    def handle(batch, n):
        st.write_batch(batch.select("offset"), out, n)
        if batch.count() == 4:
            raise ValueError("after its work, before the commit")

    with pytest.raises(ValueError):
        groups.consume_group(spark, src, offsets, "g", ["a.cdc.t"], handle)
    # an offset table that was not written whole does not count
    groups.committed(spark, offsets, "g").write.parquet(f"{offsets}/g/{st.BATCH}=0")
    (tmp_path / "offsets" / "g" / f"{st.BATCH}=0" / "_SUCCESS").unlink()
    topics.write_topic(messages(spark, [event(4, "y")]), src)
    assert groups.consume_group(spark, src, offsets, "g", ["a.cdc.t"], handle) == 1
    assert sorted(r["offset"] for r in st.read_batches(spark, out, "offset bigint").collect()) == [0, 1, 2, 3, 4]


def test_poll_skips_row_groups(spark, tmp_path, capsys):
    src, offsets = (str(tmp_path / n) for n in ("src", "offsets"))
    topics.write_topic(messages(spark, [event(i, "x") for i in range(4)]), src)
    groups.commit(groups.poll(spark, src, offsets, "g", ["a.cdc.t"]), offsets, "g")
    topics.write_topic(messages(spark, [event(4, "y")]), src)
    groups.poll(spark, src, offsets, "g", ["a.cdc.t"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(offset,4)" in plan and "BroadcastHashJoin" in plan and "PartitionFilters: [isnotnull(topic" in plan
