"""Topics as partitioned directories with the columns key, value, topic, partition, offset,
timestamp. The same columns come from Spark's Kafka source, so a frame from there fits too."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.events import CDC_SCHEMA, OPERATIONS

TOPIC_SCHEMA = (
    "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
)
TOPIC_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]


def topic_id(app: Column, topic_type: Column, message_type: Column) -> Column:
    """``app.type.message``; a change-event topic has the type ``cdc``."""
    return F.concat_ws(".", app, topic_type, message_type)


def write_topic(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Append messages to a topic directory.

    ``rebalance`` lets AQE cut a topic with many messages into several write tasks and put small
    topics together, so a hot topic does not end in one task and small ones make no tiny files.
    """
    rows = messages.select(*TOPIC_COLUMNS).hint("rebalance", "topic")
    rows.write.mode(mode).partitionBy("topic").parquet(path)


def read_topic(spark: SparkSession, path: str, topic: str | None = None, in_order: bool = False) -> DataFrame:
    """All messages from the earliest offset, of every topic partition.

    ``topic`` prunes to one directory. ``in_order`` sorts by topic, partition and offset, as a
    range sort over all tasks. A topic that nothing was written to yet gives an empty frame.
    """
    try:
        rows = spark.read.schema(TOPIC_SCHEMA).parquet(path).select(*TOPIC_COLUMNS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], TOPIC_SCHEMA)
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    return rows.orderBy("topic", "partition", "offset") if in_order else rows


def stream_topic(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same topic as a stream, starting at the earliest message."""
    reader = spark.readStream.schema(TOPIC_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """Parse the JSON value; columns of ``schema`` stand next to partition and offset."""
    parsed = F.from_json("value", schema)
    return messages.withColumn("_v", parsed).select("topic", "partition", "offset", "timestamp", "_v.*")


def parse_cdc(messages: DataFrame) -> DataFrame:
    """Change events with a ``reason`` column: NULL for a good record, else why it is bad.

    Reasons: ``not_json``, ``no_operation`` (not a change event), ``bad_operation``, ``schema``
    (a required field is missing). One bad record never stops the others.
    """
    parsed = F.from_json(
        "value",
        CDC_SCHEMA + ", _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    # a one-item explode keeps later filters above the parse: pushed into it, they would repeat it
    rows = messages.select("*", F.explode(F.array(parsed)).alias("_v"))
    broken = F.col("_v._corrupt_record").isNotNull() | F.col("_v").isNull()
    operation = F.col("_v.operation")
    has_operation = operation.isNotNull() | F.coalesce(
        F.array_contains(F.json_object_keys("value"), "operation"), F.lit(False)
    )
    reason = (
        F.when(broken & F.try_parse_json("value").isNull(), "not_json")
        .when(~has_operation, "no_operation")
        .when(broken, "schema")
        .when(operation.isNull() | ~operation.isin(*OPERATIONS), "bad_operation")
        .when(F.col("_v.message_type").isNull() | F.col("_v.meta.app_name").isNull(), "schema")
    )
    return rows.select(
        "topic", "partition", "offset", "timestamp", "value", reason.alias("reason"),
        "_v.message_type", "_v.operation", "_v.uid", "_v.resource", "_v.meta",
    )


def good_events(messages: DataFrame) -> DataFrame:
    return parse_cdc(messages).filter(F.col("reason").isNull()).drop("reason", "value")


def quarantine(messages: DataFrame) -> DataFrame:
    return parse_cdc(messages).filter(F.col("reason").isNotNull()).select(
        "topic", "partition", "offset", "value", "reason"
    )
