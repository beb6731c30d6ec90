"""Layered configuration: overlay of rows, look-ups with a default, host names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., path, value, rank) rows: the value of the highest rank that sets a path wins, also
    when it sets it to NULL."""
    top = rows.groupBy(*key, "path").agg(F.max_by(F.struct("value", "rank"), "rank").alias("_t"))
    return top.select(*key, "path", "_t.value", "_t.rank")


def lookup_default(requests: DataFrame, apps: DataFrame, key: str, fields: list[str], default: str) -> DataFrame:
    """Join the app of each key, or the app whose ``name`` is ``default``.

    ``apps`` has ``key``, ``seq``, ``name`` and ``fields``; of several apps with one key the first
    in ``seq`` order counts.
    """
    first = apps.groupBy(key).agg(F.min_by(F.struct("name", *fields), "seq").alias("_a"))
    fallback = apps.filter(F.col("name") == default).agg(F.min_by(F.struct("name", *fields), "seq").alias("d"))
    rows = requests.join(first, key, "left").withColumn("_a", F.coalesce("_a", fallback.scalar()))
    return rows.select(*requests.columns, *[F.col("_a")[f].alias(f) for f in ["name", *fields]])


def lookup_chain(
    names: DataFrame, apps: DataFrame, task_images: DataFrame, key: str
) -> DataFrame:
    """Image of a base name: the app's image, else the task image, else the name itself.

    ``apps`` and ``task_images`` have (key, image) with unique keys.
    """
    none = F.lit(None).cast("string")
    both = apps.select(key, F.col("image").alias("app"), none.alias("task")).unionByName(
        task_images.select(key, none.alias("app"), F.col("image").alias("task"))
    )
    images = both.groupBy(key).agg(F.coalesce(F.max("app"), F.max("task")).alias("image"))
    found = names.join(images, key, "left")
    return found.withColumn("image", F.coalesce("image", F.col(key)))


def host_names(apps: DataFrame, subdomain: Column, aliases: Column, domain: str) -> DataFrame:
    """Host of every non-empty subdomain and of every alias."""
    names = F.concat(
        F.when((subdomain != ""), F.array(subdomain)).otherwise(F.array().cast("array<string>")),
        F.coalesce(aliases, F.array().cast("array<string>")),
    )
    return apps.select(F.explode(names).alias("subdomain")).select(
        "subdomain", F.concat_ws(".", "subdomain", F.lit(domain)).alias("host")
    )
