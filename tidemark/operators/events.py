"""Change events: envelope, output without nulls, validation, current state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operations of a change event.
OPERATIONS = ("create", "update", "delete", "other")

# Patterns a text field must start with or match.
FIELD_PATTERNS = {
    "filename": "^[^<>:;,?*|]+$",
    "path": "^[^<>:;,?|]+$",
    "database": "^(mongo|postgres|neo4j|sqlite3)$",
    "image": "^(?:[a-z]+/)?([a-z]+)(?::[0-9]+)?",
}

CDC_SCHEMA = (
    "message_type string, operation string, uid string, resource string, "
    "meta struct<app_name string, user string, func string, args array<string>, "
    "kwargs string, description string>"
)


def envelope(
    df: DataFrame,
    app: Column,
    message_type: Column,
    operation: Column,
    uid: Column,
    resource: Sequence[str],
    user: Column | None = None,
    func: str | None = None,
    args: Sequence[Column] = (),
    kwargs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add a JSON ``value`` column with the change event of every row.

    ``resource`` lists the columns of the object. The object is always sent, also when it is a
    plain map. Arguments that have no JSON form are left out by the caller; keyword arguments
    become a list of one-entry objects.
    """
    description = F.concat(message_type, F.lit(" - "), uid.cast("string"))
    meta = F.struct(
        app.alias("app_name"),
        (user if user is not None else F.lit(None).cast("struct<id:string>")).alias("user"),
        F.lit(func).alias("func"),
        F.array(*args).alias("args"),
        F.array(*[F.create_map(F.lit(k), v.cast("string")) for k, v in (kwargs or {}).items()]).alias("kwargs"),
        description.alias("description"),
    )
    body = F.struct(
        meta.alias("meta"),
        message_type.alias("message_type"),
        operation.alias("operation"),
        uid.alias("uid"),
        F.struct(*resource).alias("resource"),
    )
    return df.withColumn("value", F.to_json(body, {"ignoreNullFields": "true"}))


def latest_state(events: DataFrame, key: str = "uid", order: str = "offset") -> DataFrame:
    """Fold a change log to the current record per key; deleted keys are dropped.

    ``max_by`` combines on the map side: a hot key ships one row per map task.
    """
    return latest_change(events, key, order).filter(F.col("operation") != "delete")


def latest_change(events: DataFrame, key: str = "uid", order: str = "offset") -> DataFrame:
    """The last change per key, deletes included."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(key, "_last.*")


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``failed``: the names of the rules a record breaks (NULL counts as broken)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.filter(F.array(*checks), lambda name: name.isNotNull()))


def matches(column: Column, kind: str) -> Column:
    """Rule: the field has the form its kind asks for."""
    return column.rlike(FIELD_PATTERNS[kind])


def validation_summary(checked: DataFrame) -> DataFrame:
    """Records per broken rule; ``ok`` counts the good ones."""
    reasons = F.when(F.size("failed") == 0, F.array(F.lit("ok"))).otherwise(F.col("failed"))
    return checked.select(F.explode(reasons).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
