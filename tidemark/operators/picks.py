"""First-of-group choices, id assignment and Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.numbering import number_rows


def pick_default(rows: DataFrame, group: str, flag: Column, seq: str) -> DataFrame:
    """Per group the first flagged row in ``seq`` order, else the first row."""
    rest = [c for c in rows.columns if c != group]
    order = F.struct(~F.coalesce(flag, F.lit(False)), F.col(seq))
    best = rows.groupBy(group).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(group, "_b.*")


def first_match(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """The first row per group in ``seq`` order."""
    return pick_default(rows, group, F.lit(False), seq)


def assign_ids(existing: DataFrame, new_rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Give new rows the largest existing id + 1, + 2, ... in the given order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    return number_rows(new_rows, order, key).withColumn(key, F.col(key) + top)


def run_task(df: DataFrame, task: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a Python function over Arrow batches. A failure fails the Spark task, which is run again up
    to ``spark.task.maxFailures`` times; see ``run_task_isolated`` for one that keeps going."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield task(frame)

    return df.mapInPandas(batches, schema)


# Fixed value: how often a task is tried.
TRIES = 10


def run_task_isolated(df: DataFrame, task: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str],
                      tries: int = TRIES) -> DataFrame:
    """``run_task`` in which rows that fail do not stop the others: ``schema``'s columns and ``error``.

    A batch on which the function fails is cut in two until the failing rows are alone. Such a row is
    tried ``tries`` times in all, so one that fails now and then still gets its result, and one that
    always fails goes out with its ``keys`` (columns of ``df`` that ``schema`` has too), nulls and the last
    error's text. The function must not depend on which rows come together.
    """
    out = StructType.fromDDL(schema)
    names = [f.name for f in out.fields]

    def alone(row: pd.DataFrame) -> pd.DataFrame:
        for attempt in range(tries):
            try:
                return task(row.copy())[names].assign(error=None)
            except Exception as problem:  # the rule: try again, then report
                error = f"{type(problem).__name__}: {problem}"
        return pd.DataFrame({n: row[n].to_numpy() if n in keys else [None] for n in names}).assign(error=error)

    def parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frame) == 1:
            yield alone(frame)
            return
        try:
            done = task(frame.copy())[names].assign(error=None)
        except Exception:
            half = len(frame) // 2
            yield from parts(frame.iloc[:half])
            yield from parts(frame.iloc[half:])
        else:
            yield done

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield from parts(frame)

    return df.mapInPandas(batches, f"{schema}, error string")
