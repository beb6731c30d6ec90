"""Hierarchical group attributes, precedence and quotas."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maps import filter_attributes
from tidemark.functions.text import to_number
from tidemark.session import cut_lineage


def ancestors(path: Column) -> Column:
    """The strict ancestors of ``/a/b/c``: ``/a`` and ``/a/b``."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve_groups(attributes: DataFrame, convert: Callable[[Column], Column] = to_number) -> DataFrame:
    """Resolve (user, path, key, value) rows to one value per user and key.

    A value counts unless the same user has a strict descendant path with the same key; of the
    values left the largest wins. ``convert`` gives NULL for a value to be skipped. A value that
    can not be converted still hides its ancestors.

    Each row also marks its ancestor paths as covered, so that one grouping on (user, key, path)
    tells live rows from covered ones: no pairs of paths are formed, and both groupings combine
    on the map side.
    """
    none = F.when(F.lit(False), convert(F.col("value")))  # a null of the hook's type
    marks = F.transform(
        ancestors(F.col("path")),
        lambda p: F.struct(p.alias("path"), none.alias("v"), F.lit(1).alias("covered")),
    )
    own = F.struct(F.col("path"), convert(F.col("value")).alias("v"), F.lit(0).alias("covered"))
    rows = attributes.select("user", "key", F.explode(F.concat(F.array(own), marks)).alias("n"))
    nodes = rows.select("user", "key", "n.*").groupBy("user", "key", "path").agg(
        F.max("v").alias("v"), F.max("covered").alias("covered")
    )
    live = nodes.filter((F.col("covered") == 0) & F.col("v").isNotNull())
    return live.groupBy("user", "key").agg(F.max("v").alias("value"))


def convert_values(attributes: DataFrame, hook: Callable[[str], object], kind: str = "double") -> DataFrame:
    """(..., value) rows with each value put through a Python function, as ``kind``.

    The function runs once per distinct value, over Arrow batches; a value on which it fails, or for
    which it gives None, becomes NULL, which ``resolve_groups`` skips. NULL values are not given to it.
    The converted values are written as a table, so that the planner knows its true size and sends it
    to the rows where it is small: a third of all rows may have one value, and would meet in one task.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for value in frame["value"]:
                try:
                    done.append(hook(value))
                except Exception:  # the rule: a value that fails is skipped
                    done.append(None)
            yield pd.DataFrame({"value": frame["value"], "_done": pd.Series(done, dtype=object, index=frame.index)})

    distinct = attributes.select("value").filter(F.col("value").isNotNull()).distinct()
    converted = cut_lineage(distinct.mapInPandas(run, f"value string, _done {kind}"))
    rest = [c for c in attributes.columns if c != "value"]
    return attributes.join(converted, "value", "left").select(*rest, F.col("_done").alias("value"))


def resolve_groups_with(attributes: DataFrame, hook: Callable[[str], object], kind: str = "double") -> DataFrame:
    """``resolve_groups`` with a Python function for the values."""
    return resolve_groups(convert_values(attributes, hook, kind), lambda value: value)


def effective(
    users: DataFrame, own: DataFrame, group: DataFrame, defaults: Mapping[str, float | str],
    convert: Callable[[Column], Column] = to_number,
) -> DataFrame:
    """Per user and default key: the user's own value, else the group result, else the default.

    ``own`` and ``group`` hold (user, key, value). Own values are taken as they are, defaults are
    converted. A user without any entry gets the defaults.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("d")) for k, v in defaults.items()])
    base = users.select("user", F.explode(keys).alias("_d")).select(
        "user", "_d.key", convert(F.col("_d.d")).cast("string").alias("value"), F.lit(0).alias("rank")
    )
    named = F.col("key").isin(*defaults)
    layers = [base]
    for rank, frame in ((1, group), (2, own)):
        layers.append(frame.filter(named).select(
            "user", "key", F.col("value").cast("string").alias("value"), F.lit(rank).alias("rank")
        ))
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2])
    top = rows.groupBy("user", "key").agg(F.max(F.struct("rank", "value")).alias("_t"))
    origin = F.element_at(F.array(F.lit("default"), F.lit("group"), F.lit("user")), F.col("_t.rank") + 1)
    return top.select("user", "key", F.col("_t.value").alias("value"), origin.alias("origin"))


def group_values(groups: DataFrame, defaults: Mapping[str, float | str]) -> DataFrame:
    """The quota attributes of each group on its own, limited to the keys of the defaults."""
    kept = filter_attributes(F.col("attributes"), list(defaults))
    return groups.select("path", F.explode(kept).alias("key", "value"))


def over_quota(active: DataFrame, quotas: DataFrame) -> DataFrame:
    """Users with a count of active servers against their quota; no or zero quota means no check.

    ``active`` holds one (user, active) row per server, ``quotas`` (user, quota).
    """
    counted = active.groupBy("user").agg(F.sum(F.when(F.col("active"), 1).otherwise(0)).alias("n_active"))
    checked = (F.col("quota") != 0) & F.col("quota").isNotNull()
    rows = quotas.join(counted, "user", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    whole = F.when(F.col("quota") < 0, F.ceil("quota")).otherwise(F.floor("quota"))
    return rows.withColumn("rejected", F.coalesce(checked & (F.col("n_active") > whole), F.lit(False)))
