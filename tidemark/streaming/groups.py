"""Consumer groups: how far a group has read each topic partition, apart from any checkpoint.

A poll reads what a group has not read, a commit notes what it has. The notes are a small table per
group, written anew by each commit, so a group can go on in another job, as a stream or in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage
from tidemark.sources.topics import read_topic
from tidemark.streaming.consume import committed_batches, write_batch

OFFSETS = "topic string, partition int, next_offset bigint"
PARTITION = ["topic", "partition"]


def _latest(spark: SparkSession, offsets: str, group: str) -> tuple[int, str | None]:
    """Number and path of the group's last whole commit; -1 where there is none."""
    done = committed_batches(spark, f"{offsets.rstrip('/')}/{group}")
    last = max(done, default=-1)
    return last, done.get(last)


def committed(spark: SparkSession, offsets: str, group: str) -> DataFrame:
    """(``topic``, ``partition``, ``next_offset``): a row per partition that the group has read from."""
    _, path = _latest(spark, offsets, group)
    return spark.read.schema(OFFSETS).parquet(path) if path else spark.createDataFrame([], OFFSETS)


def _unread(spark: SparkSession, path: str, topics: Sequence[str], known: DataFrame) -> DataFrame:
    named = list(dict.fromkeys(topics))
    known = known.filter(F.col("topic").isin(named))
    bounds = {r["topic"]: r for r in known.groupBy("topic").agg(
        F.min("next_offset").alias("least"), F.max("partition").alias("top"), F.count("*").alias("parts")).collect()}
    parts = []
    for topic in named:
        rows = read_topic(spark, path, topic).filter(F.col("partition").isNotNull())
        bound = bounds.get(topic)
        if bound and bound["top"] == bound["parts"] - 1:
            # partitions have the numbers from 0 on, new ones come behind: row groups that were read are skipped
            rows = rows.filter((F.col("offset") >= bound["least"]) | (F.col("partition") > bound["top"]))
        parts.append(rows)
    rows = reduce(DataFrame.unionByName, parts)
    behind = rows.join(known, PARTITION, "left")
    return behind.filter(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).select(*rows.columns)


def poll(spark: SparkSession, path: str, offsets: str, group: str, topics: Sequence[str], most: int | None = None) -> DataFrame:
    """The messages that a group has not read yet; a new group begins at the earliest one.

    ``most`` limits a poll to that many offsets of each partition, from the first unread one on. The
    frame stays the same when messages arrive after the call. Offsets of a partition only grow, so one
    below the committed offset counts as read. A message without a partition or an offset is in no poll.
    """
    rows = _unread(spark, path, topics, committed(spark, offsets, group))
    if most is None:
        return rows
    # a row per partition, written: the planner then sends it to the messages, not these to it
    first = cut_lineage(rows.groupBy(*PARTITION).agg(F.min("offset").alias("first")))
    return rows.join(first, PARTITION).filter(F.col("offset") < F.col("first") + most).select(*rows.columns)


def commit(batch: DataFrame, offsets: str, group: str) -> int:
    """Note that the group has read ``batch``; returns the number of the commit.

    One consumer of a group commits at a time. A commit that was not written whole does not count.
    """
    spark = batch.sparkSession
    number = _latest(spark, offsets, group)[0] + 1
    read = batch.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("next_offset"))
    both = committed(spark, offsets, group).unionByName(read)
    write_batch(both.groupBy(*PARTITION).agg(F.max("next_offset").alias("next_offset")), f"{offsets.rstrip('/')}/{group}", number)
    return number


def consume_group(spark: SparkSession, path: str, offsets: str, group: str, topics: Sequence[str],
                  handler: Callable[[DataFrame, int], None], most: int | None = None) -> int:
    """Poll, call ``handler(messages, number)``, commit, until all is read; returns the number of polls.

    Every message is handled at least once: after a failure between handler and commit the same number
    comes again with the same messages and those that have arrived since, so a handler that writes by
    number (``write_batch``) replaces its former result.
    """
    polls = 0
    while True:
        batch = poll(spark, path, offsets, group, topics, most)
        if batch.isEmpty():
            return polls
        handler(batch, _latest(spark, offsets, group)[0] + 1)
        commit(batch, offsets, group)
        polls += 1


def lag(spark: SparkSession, path: str, offsets: str, group: str, topics: Sequence[str]) -> DataFrame:
    """(``topic``, ``partition``, ``behind``): messages not read yet, for partitions that have some."""
    return poll(spark, path, offsets, group, topics).groupBy(*PARTITION).agg(F.count("*").alias("behind"))
