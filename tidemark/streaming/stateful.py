"""Streams that emit by themselves: exit notices, culled sessions, results within a time limit.

State is kept per key in the state store (``use_rocksdb`` keeps it off the heap and in the checkpoint),
so the sinks hold final rows and no reader has to fold batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.history import TERMINAL
from tidemark.operators.retention import IDLE_SECONDS

# Fixed value: seconds between two checks for idle sessions.
CULL_EVERY = 600
# Fixed value: rows that an exit-notice task takes before it folds them.
FOLD_ROWS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, not in the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # no look-up with each write just to count the keys, and one store for a join's sides in place of four
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


def exit_notices(changes: DataFrame, key: str = "op") -> DataFrame:
    """(key, status, ts) of the first terminal status of each operation to arrive, sent once.

    Of several that arrive in one batch the earliest counts. Later ones, repeats and rows of a
    repeated batch send nothing, as the state of a key is committed with the batch that sent it.
    ``changes``: key, status, ts; a change without a key belongs to no operation.

    Each batch is cut down to the earliest row per key first, in a task that holds one row per key of its
    partition; the state then only keeps the keys. The key is of an atomic type.
    """
    def earliest(tables: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(tables).sort_by([("ts", "ascending"), ("status", "ascending")])
        rows = rows.append_column("_row", pa.array(range(rows.num_rows), pa.int64()))
        firsts = rows.group_by(key, use_threads=False).aggregate([("_row", "min")])["_row_min"]
        return rows.drop_columns(["_row"]).take(firsts)

    def notices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            # folded when as many rows wait as are held, so a row is sorted a few times at most
            if waiting >= max(FOLD_ROWS, held[0].num_rows):
                held, waiting = [earliest(held)], 0
        if held:
            yield from earliest(held).to_batches(max_chunksize=FOLD_ROWS)

    done = changes.filter(F.col("status").isin(*TERMINAL) & F.col(key).isNotNull() & F.col("ts").isNotNull())
    done = done.select(key, "status", "ts")
    return done.repartition(key).mapInArrow(notices, done.schema).dropDuplicates([key])


def next_check(micros: int, every: int) -> int:
    """The first check strictly after a moment, both in microseconds; checks are at multiples of ``every`` seconds."""
    step = every * MICROS
    return (micros // step + 1) * step


def cull_at(first: int, last: int, timeout: int, max_age: int, every: int) -> tuple[int, str]:
    """When a session that began at ``first`` and was last active at ``last`` is ended, and why: at the
    first check more than ``timeout`` seconds after its last activity, or, unless ``max_age`` is 0,
    more than that many seconds after its beginning."""
    idle = next_check(last + timeout * MICROS, every)
    old = next_check(first + max_age * MICROS, every) if max_age else None
    return (old, "age") if old is not None and old < idle else (idle, "idle")


def _until_check(ts: str, timeout: int, every: int) -> Column:
    """The interval from an activity to just after the check that would end its session."""
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    over, step = now + timeout * MICROS, every * MICROS
    micros = over - F.pmod(over, F.lit(step)) + step - now + 1
    return F.make_interval(secs=(micros.cast("decimal(18,0)") / MICROS).cast("decimal(18,6)"))


def culled_sessions(activity: DataFrame, timeout: int = IDLE_SECONDS, max_age: int = 0, every: int = CULL_EVERY,
                    delay: str = "0 seconds", user: str = "user") -> DataFrame:
    """(user, tick, reason): the sessions that the checks end, each once, as a timer of its own.

    ``activity`` has a user column and ``ts``. A session lives in the state until the event-time clock
    (the latest activity of anybody, less ``delay``) has passed its check; what a user does after
    the check begins another session, also when both arrive in one batch. An activity at the moment of
    a check still counts for it. All users count, administrators too. Rows without user or time are
    left out. Without ``max_age`` a session is a session window whose gap ends with the check of its last
    activity, and an activity behind the clock counts until its own check has passed; with it, such are dropped, and checks are walked one by one in Python.
    """
    kind = dict(activity.dtypes)[user]
    rows = activity.filter(F.col(user).isNotNull() & F.col("ts").isNotNull()).select(user, "ts").withWatermark("ts", delay)
    if not max_age:
        sessions = rows.groupBy(user, F.session_window("ts", _until_check("ts", timeout, every)).alias("_s")).count()
        tick = F.col("_s.end").cast("timestamp") - F.expr("INTERVAL 0.000001 SECOND")
        return sessions.select(user, tick.alias("tick"), F.lit("idle").alias("reason"))

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended: list[tuple[int, str]] = []
        session = state.get if state.exists else None
        if state.hasTimedOut:
            ended.append(cull_at(*session, timeout, max_age, every))
            state.remove()
            session = None
        else:
            moments = sorted(m for f in frames for m in (f["ts"].astype("datetime64[us]").astype("int64")).tolist())
            for moment in moments:
                while session is not None:
                    tick, reason = cull_at(*session, timeout, max_age, every)
                    if moment <= tick:
                        break
                    ended.append((tick, reason))
                    session = None
                first, last = session or (moment, moment)
                session = (min(first, moment), max(last, moment))
            if session is not None:
                state.update(session)
                tick = cull_at(*session, timeout, max_age, every)[0] // 1000
                state.setTimeoutTimestamp(max(tick, state.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame({
                user: [key[0]] * len(ended),
                "tick": pd.to_datetime([t for t, _ in ended], unit="us"),
                "reason": [r for _, r in ended],
            })

    return rows.groupBy(user).applyInPandasWithState(
        watch, f"{user} {kind}, tick timestamp, reason string", "first bigint, last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def _after(column: str, seconds: int) -> Column:
    return F.col(column) + F.expr(f"INTERVAL {int(seconds)} SECOND")


def _sides(operations: DataFrame, results: DataFrame, key: str, delay: str) -> tuple[DataFrame, DataFrame]:
    ops = operations.withWatermark("start_ts", delay).alias("o")
    found = results.withColumnsRenamed({key: "_key", "ts": "result_ts"}).withWatermark("result_ts", delay).alias("r")
    return ops, found


def results_in_time(operations: DataFrame, results: DataFrame, limit: int, key: str = "op", delay: str = "0 seconds") -> DataFrame:
    """Operations with each of their results, by the time limit of the run.

    ``operations``: key, ``start_ts`` and more; ``results``: key, ``ts`` and more. A result counts from the
    start to ``limit`` seconds after it. An operation without one gives one row with
    ``result_status`` = ``missing`` once the clock of both streams has passed its limit; results outside the limit are
    for ``results_too_late``. An operation leaves the state when its limit has passed.
    """
    ops, found = _sides(operations, results, key, delay)
    in_time = (F.col("result_ts") >= F.col("start_ts")) & (F.col("result_ts") <= _after("start_ts", limit))
    joined = ops.join(found, (F.col(key) == F.col("_key")) & in_time, "left_outer")
    return joined.withColumn("result_status", F.when(F.col("_key").isNull(), "missing").otherwise("ok")).drop("_key")


def results_too_late(operations: DataFrame, results: DataFrame, limit: int, horizon: int, key: str = "op",
                     delay: str = "0 seconds") -> DataFrame:
    """The side output of ``results_in_time``: results after the limit, up to ``horizon`` seconds after the
    start, which is how long an operation is remembered."""
    ops, found = _sides(operations, results, key, delay)
    late = (F.col("result_ts") > _after("start_ts", limit)) & (F.col("result_ts") <= _after("start_ts", horizon))
    return ops.join(found, (F.col(key) == F.col("_key")) & late, "inner").drop("_key")
