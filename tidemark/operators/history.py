"""Operation history: status search, flags, paging, logs, results, expiry."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phases of an operation, page limits and expiry seconds.
PENDING, RUNNING, SUCCEEDED, SKIPPED, FAILED, ERROR = (
    "Pending", "Running", "Succeeded", "Skipped", "Failed", "Error",
)
TERMINAL = (ERROR, SUCCEEDED, SKIPPED, FAILED)
PAGE_DEFAULT, PAGE_MIN, PAGE_MAX = 10, 1, 50
TTL_DONE, TTL_SUCCESS, TTL_FAILURE = 3600, 1200, 7200


def search(operations: DataFrame, status: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Operations, optionally of one phase and with some fields only."""
    found = operations if status is None else operations.filter(F.col("status") == status)
    return found.select(*fields) if fields else found


def with_flags(operations: DataFrame) -> DataFrame:
    status = F.col("status")
    return operations.withColumns({
        "finished": status.isin(*TERMINAL),
        "running": status.isin(RUNNING, PENDING),
        "error": status.isin(ERROR, FAILED),
        "succeeded": status == SUCCEEDED,
        "failed": status == FAILED,
    })


def _encode(create_time: dt.datetime, name: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([create_time.isoformat(), name]).encode()).decode()


def _decode(token: str) -> tuple[dt.datetime, str]:
    stamp, name = json.loads(base64.urlsafe_b64decode(token.encode()))
    return dt.datetime.fromisoformat(stamp), name


def page(
    operations: DataFrame, status: str | None = None, limit: int = PAGE_DEFAULT, token: str | None = None
) -> tuple[DataFrame, str | None]:
    """One page in (create_time, name) order and the token of the next one, if there is any.

    The token holds the last key, so a later page is a filter that reaches the scan, not a skip.
    The driver sees the page (at most 50 rows) and one row more.
    """
    if not PAGE_MIN <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between {PAGE_MIN} and {PAGE_MAX}")
    rows = search(operations, status)
    if token is not None:
        stamp, name = _decode(token)
        after = F.lit(stamp).cast(operations.schema["create_time"].dataType)
        rows = rows.filter(
            (F.col("create_time") >= after)
            & ((F.col("create_time") > after) | (F.col("name") > name))
        )
    found = rows.orderBy("create_time", "name").limit(limit + 1).collect()
    shown = operations.sparkSession.createDataFrame(found[:limit], operations.schema)
    if len(found) <= limit:
        return shown, None
    return shown, _encode(found[limit - 1]["create_time"], found[limit - 1]["name"])


def concat_logs(lines: DataFrame, key: str, seq: str, text: str, lines_per_part: int = 10_000) -> DataFrame:
    """The log of each operation, its lines joined by newlines in ``seq`` order.

    A log comes in parts of ``lines_per_part`` sequence numbers, so that an operation with a
    very long log is put together by many tasks; the parts joined by newlines are the whole log.
    """
    part = F.floor(F.col(seq) / lines_per_part).cast("long")
    collected = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return lines.groupBy(key, part.alias("part")).agg(
        F.array_join(F.transform(collected, lambda x: x["t"]), "\n").alias("log")
    )


def results_of(operations: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The result messages of each operation, one row per message, and one ``missing`` row for
    an operation without any. Rows are not collected per operation, which may have any number;
    AQE splits the side of the results where one operation has very many. The results pass by a table of
    the operations' keys, unsorted."""
    found = results.join(operations.select(key).hint("shuffle_hash"), key).withColumn("result_status", F.lit("ok"))
    missing = missing_results(operations, results, key)
    return found.unionByName(missing.withColumn("result_status", F.lit("missing")), allowMissingColumns=True)


def missing_results(operations: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Operations that put no result in their queue."""
    return operations.select(key).join(results.select(key).distinct().hint("shuffle_hash"), key, "left_anti")


def duplicate_names(tasks: DataFrame, operation: str, name: str) -> DataFrame:
    """Task names that occur more than once in an operation."""
    return tasks.groupBy(operation, name).agg(F.count("*").alias("n")).filter("n > 1")


def leaf_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without children. ``links`` has (parent, child)."""
    parents = links.select(F.col("parent").alias("node")).distinct()
    return nodes.join(parents, "node", "left_anti")


def first_terminal(changes: DataFrame, key: str = "op") -> DataFrame:
    """The first terminal status of each operation: the one that triggers the exit notice."""
    done = changes.filter(F.col("status").isin(*TERMINAL))
    first = done.groupBy(key).agg(F.min(F.struct("ts", "status")).alias("_f"))
    return first.select(key, "_f.*")


def expiry_seconds(
    status: Column, done: int | None = TTL_DONE, success: int | None = TTL_SUCCESS, failure: int | None = TTL_FAILURE
) -> Column:
    """Seconds a finished operation is kept; NULL is for ever. Success and failure have their own
    limits, any other end uses the general one."""
    general = F.lit(done).cast("int")
    return (
        F.when(status == SUCCEEDED, F.coalesce(F.lit(success).cast("int"), general))
        .when(status.isin(FAILED, ERROR), F.coalesce(F.lit(failure).cast("int"), general))
        .when(status.isin(*TERMINAL), general)
    )


def expired(operations: DataFrame, asof: Column, **ttl: int | None) -> DataFrame:
    """Finished operations whose time is over at ``asof``."""
    keep = expiry_seconds(F.col("status"), **ttl)
    age = F.unix_timestamp(asof.cast("timestamp")) - F.unix_timestamp(F.col("end_time").cast("timestamp"))
    return operations.filter(keep.isNotNull() & (age > keep)).withColumn("ttl", keep)
