"""Notifications: match events to rules, fan out to channels, render, exit notices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import render
from tidemark.operators.history import TERMINAL
from tidemark.plans.skew import small_frame


def rule_frame(spark: SparkSession, rules: Sequence[Mapping]) -> DataFrame:
    """One row per entry of a rule's ``events`` list; repeated entries fire repeatedly."""
    rows = [
        (rule["app"], rule["message_type"], operation, n)
        for n, rule in enumerate(rules)
        for operation in rule["events"]
    ]
    return small_frame(spark, rows, "rule_app string, message_type string, operation string, rule_id int")


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with the event's message type and operation; the app is not compared."""
    return events.join(rules, ["message_type", "operation"])


def channel_frame(spark: SparkSession, notices: Mapping, channels: Mapping) -> DataFrame:
    """One row per operation, channel and backend. Empty channels are skipped."""
    rows = []
    for operation, notice in notices.items():
        for name in notice["channels"]:
            channel = channels.get(name)
            if not channel:
                continue
            for backend in channel["backends"]:
                rows.append((
                    operation, name, backend, channel["adapter"].lower(), channel["from"], ",".join(channel["to"]),
                ))
    schema = "operation string, channel string, backend string, adapter string, email_from string, email_to string"
    return small_frame(spark, rows, schema)


def outbox(matched: DataFrame, notices: Mapping, channels: Mapping, domain: str) -> DataFrame:
    """Rendered notifications. An adapter other than e-mail gives a ``failed`` row and does not
    touch the rows of the other channels.

    ``notices`` maps an operation to its subject, template and channels.
    """
    context = {
        "app_name": F.col("app_name"),
        "message_type": F.col("message_type"),
        "operation": F.col("operation"),
        "uid": F.col("uid"),
        "description": F.col("description"),
        "domain": F.lit(domain),
    }
    subject_context = {k: context[k] for k in ("message_type", "domain")}
    subject = message = F.lit(None).cast("string")
    for operation, notice in notices.items():
        this = F.col("operation") == operation
        subject = F.when(this, render(notice["subject"], subject_context)).otherwise(subject)
        message = F.when(this, render(notice["template"], context)).otherwise(message)
    known = F.col("adapter") == "email"
    rendered = matched.withColumn("subject", subject).withColumn("message", message)
    return rendered.join(channel_frame(matched.sparkSession, notices, channels), "operation").withColumns({
        "subject": F.when(known, F.col("subject")),
        "message": F.when(known, F.col("message")),
        "status": F.when(known, "rendered").otherwise("failed"),
    })


def exit_notices(operations: DataFrame, queue: Column, payload: Column) -> DataFrame:
    """A message for every finished operation that names a queue; the payload is optional."""
    body = F.struct(F.col("status"), payload.alias("payload"), F.col("name").alias("workflow"))
    return operations.filter(F.col("status").isin(*TERMINAL) & queue.isNotNull()).select(
        "name", queue.alias("topic"), F.to_json(body, {"ignoreNullFields": "true"}).alias("value")
    )
