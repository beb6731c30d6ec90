"""Snapshot retention tiers and idle sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Retention and session defaults.
KEEP_DAYS, KEEP_WEEKS, KEEP_MONTHS = 7, 4, 6
IDLE_SECONDS = 3600


def tiers(snapshots: DataFrame, *key: str) -> DataFrame:
    """Tier rows of (key..., ts) snapshots: every one is a daily, the latest of each ISO week a
    weekly, the latest of each month a monthly."""
    starts = F.array(
        F.struct(F.lit("daily").alias("tier"), F.col("ts").alias("start")),
        F.struct(F.lit("weekly").alias("tier"), F.date_trunc("week", "ts").cast(snapshots.schema["ts"].dataType).alias("start")),
        F.struct(F.lit("monthly").alias("tier"), F.date_trunc("month", "ts").cast(snapshots.schema["ts"].dataType).alias("start")),
    )
    rows = snapshots.select(*key, "ts", F.explode(starts).alias("b"))
    # buckets are grouped by their first moment and named afterwards, once per bucket
    latest = rows.groupBy(*key, "b.tier", "b.start").agg(F.max("ts").alias("ts"))
    week = F.concat_ws(
        "-",
        F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"),
        F.lpad(F.weekofyear("ts").cast("string"), 2, "0"),
    )
    bucket = (
        F.when(F.col("tier") == "daily", F.date_format("ts", "yyyy-MM-dd-HHmmss.SSSSSS"))
        .when(F.col("tier") == "weekly", week)
        .otherwise(F.date_format("ts", "yyyy-MM"))
    )
    return latest.select(*key, "tier", bucket.alias("bucket"), "ts")


def retention(
    snapshots: DataFrame, asof: Column, *key: str,
    keep_days: int = KEEP_DAYS, keep_weeks: int = KEEP_WEEKS, keep_months: int = KEEP_MONTHS,
) -> DataFrame:
    """Tier rows with ``age_days`` (whole days) and ``keep``."""
    limits = {"daily": keep_days, "weekly": keep_weeks * 7 + 1, "monthly": keep_months * 31 + 1}
    limit = F.lit(None).cast("int")
    for tier, days in limits.items():
        limit = F.when(F.col("tier") == tier, days).otherwise(limit)
    seconds = F.unix_micros(asof.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    age = F.floor(seconds / F.lit(86_400_000_000)).cast("long")
    return tiers(snapshots, *key).withColumn("age_days", age).withColumn("keep", F.col("age_days") <= limit)


def idle(sessions: DataFrame, asof: Column, timeout: int = IDLE_SECONDS, max_age: int = 0) -> DataFrame:
    """(user, ts) activity: users whose last activity is older than ``timeout`` seconds, or whose
    first is older than ``max_age`` (0 = no limit)."""
    seen = sessions.groupBy("user").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    now = F.unix_seconds(asof.cast("timestamp"))
    quiet = now - F.unix_seconds(F.col("last_ts").cast("timestamp")) > timeout
    old = now - F.unix_seconds(F.col("first_ts").cast("timestamp")) > max_age
    return seen.withColumn("idle", quiet | (F.lit(max_age > 0) & old))


def sessions(activity: DataFrame, timeout: int = IDLE_SECONDS) -> DataFrame:
    """Sessions of (user, ts) activity: a gap of more than ``timeout`` seconds starts a new one.

    Activity is first combined per user and time slot of one timeout length. Two rows of one slot
    are always in one session, so this is exact, and it bounds what one user sends to the window
    by the time range, however many events the user has.
    """
    return join_slots(time_slots(activity, timeout), timeout)


def time_slots(activity: DataFrame, timeout: int = IDLE_SECONDS) -> DataFrame:
    """(user, slot, lo, hi, n): activity combined per slot of one timeout length."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(timeout * 1_000_000))
    return activity.groupBy("user", slot.alias("slot")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")
    )


def join_slots(slots: DataFrame, timeout: int = IDLE_SECONDS) -> DataFrame:
    """Sessions of time slots (one row per user and slot)."""
    in_order = Window.partitionBy("user").orderBy("slot")
    gap = F.unix_micros(F.col("lo").cast("timestamp")) - F.unix_micros(F.lag("hi").over(in_order).cast("timestamp"))
    starts = F.when(gap.isNull() | (gap > timeout * 1_000_000), 1).otherwise(0)
    numbered = slots.withColumn("_start", starts).withColumn("session", F.sum("_start").over(in_order))
    return numbered.groupBy("user", "session").agg(
        F.min("lo").alias("start_ts"), F.max("hi").alias("end_ts"), F.sum("n").alias("n_events")
    )
