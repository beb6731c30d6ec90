"""Notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import render
from tidemark.operators import notify
from tidemark.sources import topics
from tidemark.suite import derive as d
from tidemark.suite.registry import query

RULES = [
    {"app": "shop0", "message_type": "even", "events": ["create", "delete"]},
    {"app": "shop1", "message_type": "odd", "events": ["update", "update", "create"]},
    {"app": "shop2", "message_type": "even", "events": ["delete"]},
]
CHANNELS = {
    "admins": {"adapter": "email", "backends": ["email"], "from": "info@example.com", "to": ["a@example.com", "b@example.com"]},
    "log": {"adapter": "Email", "backends": ["console", "email"], "from": "info@example.com", "to": ["log@example.com"]},
    "chat": {"adapter": "chat", "backends": ["console"], "from": "bot@example.com", "to": ["room"]},
    "off": {},
}
NOTICES = {
    "create": {"subject": "New {{ message_type }} - {{ domain }}", "template": "{{ app_name }}: {{ description }} was made", "channels": ["admins", "log"]},
    "update": {"subject": "Update {{ message_type }} - {{ domain }}", "template": "{{ uid }} changed in {{ app_name }}", "channels": ["chat", "admins"]},
    "delete": {"subject": "Delete {{ message_type }} - {{ domain }}", "template": "{{ description }} is gone", "channels": ["log", "off"]},
}
DOMAIN = "example.org"

SQL_RULES = """rules(rule_app, message_type, operation, rule_id) AS (VALUES
  ('shop0', 'even', 'create', 0), ('shop0', 'even', 'delete', 0), ('shop1', 'odd', 'update', 1),
  ('shop1', 'odd', 'update', 1), ('shop1', 'odd', 'create', 1), ('shop2', 'even', 'delete', 2))"""
SQL_CHANNELS = """ch(operation, channel, backend, adapter, email_from, email_to) AS (VALUES
  ('create', 'admins', 'email', 'email', 'info@example.com', 'a@example.com,b@example.com'),
  ('create', 'log', 'console', 'email', 'info@example.com', 'log@example.com'),
  ('create', 'log', 'email', 'email', 'info@example.com', 'log@example.com'),
  ('update', 'chat', 'console', 'chat', 'bot@example.com', 'room'),
  ('update', 'admins', 'email', 'email', 'info@example.com', 'a@example.com,b@example.com'),
  ('delete', 'log', 'console', 'email', 'info@example.com', 'log@example.com'),
  ('delete', 'log', 'email', 'email', 'info@example.com', 'log@example.com'))"""


def flat(events):
    return events.select("offset", "message_type", "operation", "uid", "meta.app_name", "meta.description")


@query("notify_match", f"""WITH {d.SQL_GOOD}, {SQL_RULES}
SELECT "offset", uid, operation, message_type, rule_app, CAST(rule_id AS BIGINT) AS rule_id FROM good JOIN rules USING (message_type, operation)""")
def notify_match(spark, sf):
    events = flat(topics.good_events(d.cdc_topic(spark, sf)))
    matched = notify.match_rules(events, notify.rule_frame(spark, RULES))
    return matched.select("offset", "uid", "operation", "message_type", "rule_app", F.col("rule_id").cast("long").alias("rule_id"))


OUTBOX = ["offset", "operation", "rule_id", "channel", "backend", "email_from", "email_to", "subject", "message", "status"]

SQL_OUTBOX = f"""WITH {d.SQL_GOOD}, {SQL_RULES}, {SQL_CHANNELS}
SELECT "offset", operation, CAST(rule_id AS BIGINT) AS rule_id, channel, backend, email_from, email_to,
  CASE WHEN adapter = 'email' THEN
    CASE operation WHEN 'create' THEN 'New ' WHEN 'update' THEN 'Update ' ELSE 'Delete ' END || message_type || ' - example.org' END AS subject,
  CASE WHEN adapter = 'email' THEN
    CASE operation WHEN 'create' THEN app || ': ' || message_type || ' - ' || uid || ' was made'
      WHEN 'update' THEN uid || ' changed in ' || app ELSE message_type || ' - ' || uid || ' is gone' END END AS message,
  CASE WHEN adapter = 'email' THEN 'rendered' ELSE 'failed' END AS status
FROM good JOIN rules USING (message_type, operation) JOIN ch USING (operation)"""


def outbox_rows(events, spark):
    matched = notify.match_rules(flat(events), notify.rule_frame(spark, RULES))
    rows = notify.outbox(matched, NOTICES, CHANNELS, DOMAIN)
    return rows.withColumn("rule_id", F.col("rule_id").cast("long")).select(*OUTBOX)


@query("notify_outbox", SQL_OUTBOX)
def notify_outbox(spark, sf):
    return outbox_rows(topics.good_events(d.cdc_topic(spark, sf)), spark)


@query("render_notifications", f"""WITH {d.SQL_CDC}
SELECT "offset", 'New ' || message_type || ' - example.org' AS subject, app || ': ' || message_type || ' - ' || uid || ' was made' AS body
FROM cdc""")
def render_notifications(spark, sf):
    rows = d.cdc(spark, sf)
    context = {
        "message_type": F.col("message_type"), "domain": F.lit(DOMAIN), "app_name": F.col("app"),
        "description": F.concat("message_type", F.lit(" - "), "uid"),
    }
    return rows.select(
        "offset", render(NOTICES["create"]["subject"], context).alias("subject"),
        render(NOTICES["create"]["template"], context).alias("body"),
    )
