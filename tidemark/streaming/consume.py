"""Streams over topics: consume with error isolation, notices and state.

All sinks are written per micro-batch into a folder named after the batch, which is overwritten
when a batch is repeated after a failure. A repeated batch therefore never counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType

from tidemark.operators.events import latest_change
from tidemark.operators.history import TERMINAL
from tidemark.operators.retention import IDLE_SECONDS, join_slots, time_slots
from tidemark.sources.topics import parse_cdc

BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch so that a repeat replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a sink folder, with their ``batch_id``; folded ones have the number of their fold."""
    done = committed_batches(spark, path)
    return _read(spark, path, schema, [done[n] for n in current_batches(done)])


def _read(spark: SparkSession, path: str, schema, paths: list[str]) -> DataFrame:
    if isinstance(schema, str):
        full = f"{schema}, {BATCH} bigint"
    else:
        full = type(schema)(list(schema.fields)).add(BATCH, LongType())
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*paths)


def run_to_end(writer) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def consume(
    messages: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
    bad: Callable[[DataFrame, int], None],
):
    """Call ``handler(events, batch_id)`` with the good change events of each micro-batch; bad
    records go to ``bad`` first and never stop the others. New consumers start at the earliest
    message; the checkpoint keeps the offsets over restarts. An error of ``handler`` itself ends
    the stream, which repeats the batch when it starts again; see ``consume_rows`` for handlers
    of single events."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_cdc(batch).persist()
        try:
            bad(parsed.filter(F.col("reason").isNotNull()).select("topic", "partition", "offset", "reason"), batch_id)
            handler(parsed.filter(F.col("reason").isNull()).drop("reason", "value"), batch_id)
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def handle_rows(events: DataFrame, handler: Callable[[dict], object]) -> DataFrame:
    """Call a Python function once per event, over Arrow batches: (topic, partition, offset, result, error).

    An event on which the handler fails gets the error text and does not stop the others.
    """
    keys = ["topic", "partition", "offset"]

    def run(frames):
        for frame in frames:
            results, errors = [], []
            for event in frame.to_dict("records"):
                try:
                    answer = handler(event)
                    results.append(None if answer is None else str(answer))
                    errors.append(None)
                except Exception as error:  # the rule: report and go on
                    results.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield frame[keys].assign(result=results, error=errors)

    return events.mapInPandas(run, "topic string, partition int, offset bigint, result string, error string")


def consume_rows(messages: DataFrame, handler: Callable[[dict], object], path: str, checkpoint: str,
                 bad: Callable[[DataFrame, int], None]):
    """Call a Python function once per good event and write its results below ``path``; an event on
    which it fails is written with the error, and the stream goes on."""
    return consume(messages, lambda events, n: write_batch(handle_rows(events, handler), path, n), checkpoint, bad)


HANDLED = "topic string, partition int, offset bigint, result string, error string"


def maintain_state(events: DataFrame, path: str, checkpoint: str, key: str = "uid", order: str = "offset"):
    """Keep the current record per key: each batch adds its last change per key.

    A batch costs as much as its own rows, not as the whole state. ``current_state`` folds the
    batches; a late older change loses against a newer one there, by its offset.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_change(batch, key, order), path, batch_id)

    return events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def current_state(spark: SparkSession, path: str, schema, key: str = "uid", order: str = "offset") -> DataFrame:
    """The maintained state; deleted keys are not shown."""
    changes = read_batches(spark, path, schema).drop(BATCH)
    return latest_change(changes, key, order).filter(F.col("operation") != "delete")


def committed_batches(spark: SparkSession, path: str) -> dict[int, str]:
    """The batches of a sink folder whose write has ended, with their paths. A negative number is the
    fold of all batches from 0 to ``-number - 1``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = {}
    for found in files.listStatus(root) if files.exists(root) else []:
        at = found.getPath()
        if at.getName().startswith(f"{BATCH}=") and files.exists(hadoop.Path(at, "_SUCCESS")):
            done[int(at.getName().split("=")[1])] = at.toString()
    return done


def current_batches(done: Iterable[int]) -> list[int]:
    """The newest fold and what came after it: together every batch once."""
    fold = min([n for n in done if n < 0], default=0)
    return sorted(n for n in done if n == fold < 0 or n >= -fold)


def compact(spark: SparkSession, path: str, schema, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Put the older batches of a sink folder in one that holds their fold, while the stream goes on.

    Exactly the batches that are committed when this begins are folded, but for the newest one, which
    a restarted stream may write again; a batch written meanwhile is not touched. The fold's number
    tells which batches it stands for, so ``read_batches`` meets each batch once, before, while and
    after this runs, and after a crash. What a fold replaces is deleted by the next ``compact``, when
    readers that began before the fold have had that long to end.
    """
    done = committed_batches(spark, path)
    now = current_batches(done)
    for n in set(done).difference(now):
        old = spark._jvm.org.apache.hadoop.fs.Path(done[n])
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    older = now[:-1]
    if len(older) >= 2:
        write_batch(fold(_read(spark, path, schema, [done[n] for n in older]).drop(BATCH)), path, -older[-1] - 1)


def compact_state(spark: SparkSession, path: str, schema, key: str = "uid", order: str = "offset") -> None:
    """Fold the batches of a maintained state (deletes stay, to win over late changes)."""
    compact(spark, path, schema, lambda rows: latest_change(rows, key, order))


def compact_first(spark: SparkSession, path: str, schema, keys: Sequence[str], order: str) -> None:
    """Fold the batches that ``keep_first`` writes."""
    compact(spark, path, schema, lambda rows: _first(rows, keys, order))


def keep_first(rows: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str):
    """Keep one row per key, the first by ``order``: each batch adds its own first rows.

    No state grows in the executors and no row is too late: ``first_rows`` folds the batches, so a
    row that arrives long after others of its key still counts.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(_first(batch, keys, order), path, batch_id)

    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def _first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    # the order column first, so that equal times are settled by the other columns
    body = F.struct(order, *[c for c in rest if c != order])
    return rows.groupBy(*keys).agg(F.min(body).alias("_f")).select(*keys, "_f.*")


def first_rows(spark: SparkSession, path: str, schema, keys: Sequence[str], order: str) -> DataFrame:
    """The kept row of each key over all batches."""
    return _first(read_batches(spark, path, schema).drop(BATCH), keys, order)


def first_terminal_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "op"):
    """Keep the first terminal status of each operation; read it with ``first_rows``."""
    return keep_first(changes.filter(F.col("status").isin(*TERMINAL)), [key], "ts", path, checkpoint)


def distinct_messages(messages: DataFrame, keys: Sequence[str], path: str, checkpoint: str, ts: str = "ts"):
    """Keep each message once, however late it or a repeat of it comes; read with ``first_rows``."""
    return keep_first(messages, keys, ts, path, checkpoint)


def sessions_stream(activity: DataFrame, path: str, checkpoint: str, timeout: int = IDLE_SECONDS):
    """Combine (user, ts) activity per time slot; read the sessions with ``current_sessions``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(time_slots(batch, timeout), path, batch_id)

    return activity.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def _slots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def _slot_schema(user_type: str) -> str:
    return f"user {user_type}, slot bigint, lo timestamp, hi timestamp, n bigint"


def compact_sessions(spark: SparkSession, path: str, user_type: str = "bigint") -> None:
    """Fold the time slots that ``sessions_stream`` writes."""
    compact(spark, path, _slot_schema(user_type), _slots)


def current_sessions(spark: SparkSession, path: str, user_type: str = "bigint", timeout: int = IDLE_SECONDS) -> DataFrame:
    """All sessions of the batches so far; ``open`` where the last activity seen by anybody is not
    yet ``timeout`` seconds after the session's end."""
    slots = _slots(read_batches(spark, path, _slot_schema(user_type)))
    latest = slots.agg(F.max("hi")).scalar()
    quiet = F.unix_micros(latest) - F.unix_micros("end_ts")
    return join_slots(slots, timeout).withColumn("open", quiet <= timeout * 1_000_000)
