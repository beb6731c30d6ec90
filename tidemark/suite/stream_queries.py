"""Streaming queries. The input is written in several steps, for queries that fold late rows in an
order that has nothing to do with event time; after each step the stream runs to its end, so every
query also goes through a restart from its checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.session import scratch
from tidemark.sources import topics
from tidemark.streaming import consume as st
from tidemark.streaming import groups
from tidemark.streaming import identity as sync
from tidemark.streaming import stateful
from tidemark.suite import derive as d
from tidemark.suite import history_queries, notify_queries, topic_queries
from tidemark.suite.registry import query, table


def _replay(spark, rows, earlier, start, read=None):
    """Write ``rows`` in two steps (first those where ``earlier`` holds); run the query that
    ``start(stream)`` describes after each."""
    _replay_steps(spark, rows, F.when(earlier, 0).otherwise(1), 2, start, read)


def _parted(spark, rows, step):
    """The rows of each step. All are derived once, and written by step."""
    path = scratch(spark, "steps")
    rows.withColumn("_step", step.cast("int")).write.partitionBy("_step").parquet(path)
    held = spark.read.schema(StructType([*rows.schema.fields]).add("_step", IntegerType())).parquet(path)
    return lambda number: held.filter(F.col("_step") == number).drop("_step")


def _replay_steps(spark, rows, step, steps, start, read=None, after=None):
    """Write ``rows`` in several steps, by their number; run the query, and ``after``, after each."""
    source = scratch(spark, "stream-in")
    read = read or (lambda path: spark.readStream.schema(rows.schema).parquet(path))
    part = _parted(spark, rows, step)
    for number in range(steps):
        part(number).write.mode("append").parquet(source)
        st.run_to_end(start(read(source)))
        if after:
            after()


def _to_files(stream, out, checkpoint):
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def _replay_topic(spark, sf, start, files_per_batch=None, after=None):
    rows = d.cdc_topic(spark, sf).select(*topics.TOPIC_COLUMNS)
    step = F.when(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"), 0).otherwise(1)
    _replay_steps(spark, rows, step, 2, start, lambda path: topics.stream_topic(spark, path, files_per_batch), after)


@query("stream_consume", topic_queries.SQL_PARSED)
def stream_consume(spark, sf):
    out, bad, mark = (scratch(spark, n) for n in ("events", "bad", "mark"))
    good = topics.good_events(d.cdc_topic(spark, sf)).schema

    def start(stream):
        return st.consume(
            stream, lambda df, n: st.write_batch(df, out, n), mark, lambda df, n: st.write_batch(df, bad, n)
        )

    _replay_topic(spark, sf, start)
    return topic_queries.parsed_columns(st.read_batches(spark, out, good))


@query("stream_restart", f"""WITH {d.SQL_CDC}
SELECT uid AS "key", "offset", app || '.cdc.' || message_type AS topic FROM cdc""")
def stream_restart(spark, sf):
    out, mark = scratch(spark, "copy"), scratch(spark, "mark")
    _replay_topic(spark, sf, lambda stream: _to_files(stream.select("key", "offset", "topic"), out, mark))
    return spark.read.schema("key string, offset bigint, topic string").parquet(out)


@query("consumer_groups", f"""WITH {d.SQL_CDC}
SELECT g AS "group", user_id % 4 AS "partition", "offset", app || '.cdc.' || message_type AS topic
FROM cdc, (VALUES ('early'), ('late')) AS t(g)""")
def consumer_groups(spark, sf):
    rows = d.cdc_topic(spark, sf).select(*topics.TOPIC_COLUMNS)
    path, offsets, out = (scratch(spark, n) for n in ("topic", "offsets", "handled"))
    names = [f"shop{i}.cdc.{kind}" for i in range(3) for kind in ("even", "odd")]
    least, top = rows.agg(F.min("offset"), F.max("offset")).first()
    middle = ((least or 0) + (top or 0)) // 2

    def handle(group):
        return lambda batch, n: st.write_batch(batch.select("topic", "partition", "offset"), f"{out}/{group}", n)

    topics.write_topic(rows.filter(F.col("offset") < middle), path)
    groups.consume_group(spark, path, offsets, "early", names, handle("early"), most=max(1, (middle - (least or 0)) // 2))
    topics.write_topic(rows.filter(F.col("offset") >= middle), path)
    # a consumer that ends before its commit: the next one of the group gets the same again
    handle("early")(groups.poll(spark, path, offsets, "early", names), max(st.committed_batches(spark, f"{offsets}/early"), default=-1) + 1)
    groups.consume_group(spark, path, offsets, "early", names, handle("early"))
    groups.consume_group(spark, path, offsets, "late", names, handle("late"))
    found = [st.read_batches(spark, f"{out}/{g}", "topic string, partition int, offset bigint").withColumn("group", F.lit(g))
             for g in ("early", "late")]
    return found[0].unionByName(found[1]).select("group", F.col("partition").cast("long").alias("partition"), "offset", "topic")


@query("stream_cdc_state", f"""WITH {d.SQL_GOOD},
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY "offset" DESC) AS rn FROM good)
SELECT uid, "offset", operation, message_type, round(value, 2) AS value FROM r WHERE rn = 1 AND operation <> 'delete'""")
def stream_cdc_state(spark, sf):
    out, mark = scratch(spark, "state"), scratch(spark, "mark")
    schema = topics.good_events(d.cdc_topic(spark, sf)).schema

    def start(stream):
        return st.maintain_state(topics.good_events(stream), out, mark)

    _replay_topic(spark, sf, start, 2, lambda: st.compact_state(spark, out, schema))
    rows = st.current_state(spark, out, schema)
    value = F.round(F.get_json_object("resource", "$.value").cast("double"), 2)
    return rows.select("uid", "offset", "operation", "message_type", value.alias("value"))


@query("stream_notify", notify_queries.SQL_OUTBOX)
def stream_notify(spark, sf):
    out, mark = scratch(spark, "outbox"), scratch(spark, "mark")

    def start(stream):
        return _to_files(notify_queries.outbox_rows(topics.good_events(stream), spark), out, mark)

    _replay_topic(spark, sf, start)
    schema = notify_queries.outbox_rows(topics.good_events(d.cdc_topic(spark, sf)), spark).schema
    return spark.read.schema(schema).parquet(out)


@query("stream_identity", d.SQL_SYNC)
def stream_identity(spark, sf):
    """Admin events in four steps keep users, groups, organizations and memberships in step with the
    provider: the records, the memberships and the refused rows of each step."""
    path, mark = scratch(spark, "identity"), scratch(spark, "mark")
    store = sync.IdentityStore(spark, path, buckets=8)
    store.users.load(d.identity_target(spark, sf).withColumnRenamed("username", "name"))
    store.groups.load(d.target_groups(spark, sf))
    store.organizations.load(d.target_organizations(spark, sf))
    enabled = F.when(F.col("seq") % 31 == 0, True)
    source = sync.Source(
        users=lambda: d.identity_source(spark, sf).withColumn("enabled", enabled).drop("seq"),
        groups=lambda: d.provider_groups(spark, sf),
        members=lambda: d.provider_members(spark, sf))
    rows = d.admin_events(spark, sf)
    _replay_steps(spark, rows, F.col("step"), d.SYNC_STEPS, lambda stream: sync.sync_admin_events(stream, store, mark, source))
    none = F.lit(None).cast("string")
    out = store.members.read().select(
        F.concat(F.lit("member of "), "kind").alias("kind"), F.col("user_ext").alias("id"), F.col("target_id").alias("name"),
        none.alias("ext_id"), F.lit(None).cast("boolean").alias("active"), none.alias("label"))
    for kind, held in (("user", store.users), ("group", store.groups), ("organization", store.organizations)):
        out = out.unionByName(held.records().select(
            F.lit(kind).alias("kind"), F.col("target_id").alias("id"), "name", "ext_id", "active", none.alias("label")))
    refused = st.read_batches(spark, store.refused, sync.REFUSED)
    return out.unionByName(refused.select(
        F.concat(F.lit("refused "), "kind").alias("kind"), F.col(st.BATCH).cast("string").alias("id"), "name", "ext_id",
        F.lit(None).cast("boolean").alias("active"), "label"))


def _shuffled(rows, *key):
    """Four arrival steps that have nothing to do with event time."""
    return F.pmod(F.xxhash64(*key), F.lit(4))


@query("stream_first_terminal", history_queries.SQL_FIRST)
def stream_first_terminal(spark, sf):
    out, mark = scratch(spark, "terminal"), scratch(spark, "mark")
    rows = d.status_changes(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("op", "status", "ts")
    schema = "op bigint, ts timestamp, status string"
    _replay_steps(spark, rows, _shuffled(rows, "op", "ts"), 4, lambda stream: st.first_terminal_stream(stream, out, mark),
                  after=lambda: st.compact_first(spark, out, schema, ["op"], "ts"))
    found = st.first_rows(spark, out, schema, ["op"], "ts")
    return found.select("op", "status", d.stamp("ts").alias("ts"))


def _arrival(bits):
    """A number from 0 to 3 that the SQL twin can compute too, unrelated to event time."""
    return F.expr(f"(({bits}) * 7919 + 13) % 4")


@query("stream_exit_once", f"""WITH {d.SQL_CHANGES},
t AS (SELECT op, status, ts, ((op * 3 + epoch(ts)::BIGINT // 60) * 7919 + 13) % 4 AS step FROM changes
  WHERE status IN ('Error', 'Succeeded', 'Skipped', 'Failed'))
SELECT op, status, {d.sql_stamp('ts')} AS ts FROM t
QUALIFY row_number() OVER (PARTITION BY op ORDER BY step, ts, status) = 1""")
def stream_exit_once(spark, sf):
    """The notice of the first terminal status to arrive, straight from the sink, over four restarts."""
    out, mark = scratch(spark, "exits"), scratch(spark, "mark")
    rows = d.status_changes(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("op", "status", "ts")
    stateful.use_rocksdb(spark)
    _replay_steps(spark, rows, _arrival("op * 3 + unix_seconds(ts) div 60"), 4,
                  lambda stream: _to_files(stateful.exit_notices(stream), out, mark))
    found = spark.read.schema("op bigint, status string, ts timestamp").parquet(out)
    return found.select("op", "status", d.stamp("ts").alias("ts"))


CULL_END = "2024-03-01 00:00:00"


@query("stream_cull", f"""WITH g AS (
  SELECT user_id AS "user", epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
t AS (SELECT "user", nxt, ((us + 21600000000) // 600000000 + 1) * 600000000 AS tick FROM g)
SELECT "user", {d.sql_stamp('make_timestamp(tick)')} AS tick, 'idle' AS reason FROM t WHERE nxt IS NULL OR nxt > tick""")
def stream_cull(spark, sf):
    """Every session that the ten-minute checks end, over four steps in event-time order; a last
    activity of nobody in particular moves the clock past the last check."""
    out, mark = scratch(spark, "culled"), scratch(spark, "mark")
    rows = history_queries._activity(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    clock = spark.createDataFrame([(-1, CULL_END)], "user bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    steps = F.when(F.col("user") == -1, 4).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)))
    stateful.use_rocksdb(spark)
    _replay_steps(spark, rows.unionByName(clock), steps, 5, lambda stream: _to_files(
        stateful.culled_sessions(stream, history_queries.SESSION_GAP), out, mark))
    found = spark.read.schema("user bigint, tick timestamp, reason string").parquet(out)
    return found.select("user", d.stamp("tick").alias("tick"), "reason")


RESULT_LIMIT, RESULT_HORIZON = 180, 86_400
SQL_RESULTS = f"""WITH {d.SQL_OPS}, pairs AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT o_orderkey AS op, l_linenumber AS seq, l_linenumber * 60 + o_orderkey % 4 * 30 AS secs FROM ops JOIN pairs ON l_orderkey = o_orderkey)"""


def _run_results(spark, sf):
    """Operations and their results, and one of each that moves the clock past the last limit."""
    key = F.col("o_orderkey")
    ops = d.operations(spark, sf).select(key.alias("op"), F.col("create_time").cast("timestamp").alias("start_ts"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("op"), F.col("l_linenumber").cast("int").alias("seq")).distinct()
    results = lines.join(ops, "op").select(
        "op", "seq", (F.col("start_ts") + F.make_dt_interval(secs=F.col("seq") * 60 + F.col("op") % 4 * 30)).alias("ts"))
    end = F.lit("2100-01-01").cast("timestamp")
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("op"), F.lit(0).alias("seq"), end.alias("ts"))
    return (ops.unionByName(clock.select("op", end.alias("start_ts"))), results.unionByName(clock))


def _replay_both(spark, ops, results, start):
    """Both inputs year by year, so that each side's clock moves with the other's."""
    places = [scratch(spark, n) for n in ("ops-in", "results-in")]
    ends = (1994, 1997, 2000, 2050, 9999)

    def period(ts):
        found = F.lit(None)
        for number, end in reversed([*enumerate(ends)]):
            found = F.when(F.year(ts) < end, number).otherwise(found)
        return F.when(F.year(ts) >= 0, found)

    parts = [_parted(spark, df, period(ts)) for df, ts in ((ops, "start_ts"), (results, "ts"))]
    for number in range(len(ends)):
        for part, path in zip(parts, places):
            part(number).write.mode("append").parquet(path)
        st.run_to_end(start(*[spark.readStream.schema(df.schema).parquet(p) for df, p in zip((ops, results), places)]))


@query("stream_results", f"""{SQL_RESULTS}
SELECT op, seq, 'ok' AS result_status FROM r WHERE secs <= {RESULT_LIMIT}
UNION ALL SELECT o_orderkey, NULL, 'missing' FROM ops WHERE o_orderkey NOT IN (SELECT op FROM r WHERE secs <= {RESULT_LIMIT})""")
def stream_results(spark, sf):
    """Results in the time limit of their operation, and a row for each operation without one."""
    out, mark = scratch(spark, "results"), scratch(spark, "mark")
    stateful.use_rocksdb(spark)
    _replay_both(spark, *_run_results(spark, sf), lambda ops, found: _to_files(
        stateful.results_in_time(ops, found, RESULT_LIMIT).select("op", "seq", "result_status"), out, mark))
    return spark.read.schema("op bigint, seq int, result_status string").parquet(out).filter("op >= 0")


@query("stream_results_late", f"""{SQL_RESULTS}
SELECT op, seq FROM r WHERE secs > {RESULT_LIMIT}""")
def stream_results_late(spark, sf):
    """The side output: results after the limit."""
    out, mark = scratch(spark, "late"), scratch(spark, "mark")
    stateful.use_rocksdb(spark)
    _replay_both(spark, *_run_results(spark, sf), lambda ops, found: _to_files(
        stateful.results_too_late(ops, found, RESULT_LIMIT, RESULT_HORIZON).select("op", "seq"), out, mark))
    return spark.read.schema("op bigint, seq int").parquet(out)


@query("stream_sessions", history_queries.SQL_SESSIONS)
def stream_sessions(spark, sf):
    out, mark = scratch(spark, "sessions"), scratch(spark, "mark")
    rows = history_queries._activity(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))

    def start(stream):
        return st.sessions_stream(stream, out, mark, history_queries.SESSION_GAP)

    _replay_steps(spark, rows, _shuffled(rows, "user", "ts"), 4, start, after=lambda: st.compact_sessions(spark, out))
    found = st.current_sessions(spark, out, timeout=history_queries.SESSION_GAP)
    return found.select("user", d.stamp("start_ts").alias("start_ts"), d.stamp("end_ts").alias("end_ts"), "n_events")


@query("stream_dedup", f"""WITH {d.SQL_CDC}
SELECT app || '.cdc.' || message_type AS topic, uid, "offset" FROM cdc""")
def stream_dedup(spark, sf):
    out, mark = scratch(spark, "once"), scratch(spark, "mark")
    copies = F.when(F.col("offset") % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    topic = topics.topic_id(F.col("app"), F.lit("cdc"), F.col("message_type"))
    rows = d.cdc(spark, sf).select(
        topic.alias("topic"), "uid", "offset", F.col("ts").cast("timestamp").alias("ts"), F.explode(copies).alias("copy")
    )
    keys, schema = ["topic", "uid", "offset"], "topic string, uid string, offset bigint, ts timestamp"
    _replay_steps(spark, rows, _shuffled(rows, "offset", "copy"), 4,
                  lambda stream: st.distinct_messages(stream.drop("copy"), keys, out, mark),
                  after=lambda: st.compact_first(spark, out, schema, keys, "ts"))
    return st.first_rows(spark, out, schema, keys, "ts").select(*keys)


@query("stream_handler", f"""WITH {d.SQL_GOOD}
SELECT "offset", CASE WHEN "offset" % 7 = 3 THEN NULL ELSE upper(operation) END AS result,
       CASE WHEN "offset" % 7 = 3 THEN 'ValueError: no' END AS error FROM good""")
def stream_handler(spark, sf):
    """A handler that fails on some events: they carry the error, all others arrive."""
    out, bad, mark = (scratch(spark, n) for n in ("handled", "bad", "mark"))

    def handler(event):
        if event["offset"] % 7 == 3:
            raise ValueError("no")
        return event["operation"].upper()

    _replay_topic(spark, sf, lambda stream: st.consume_rows(stream, handler, out, mark, lambda df, n: st.write_batch(df, bad, n)))
    return st.read_batches(spark, out, st.HANDLED).select("offset", "result", "error")
