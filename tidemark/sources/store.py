"""Keyed record store: apply a batch of create / update / delete changes in offset order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.numbering import number_rows
from tidemark.session import cut_lineage


def apply_changes(
    base: DataFrame, changes: DataFrame, fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Return (store after the batch, rejected changes).

    ``base`` has ``id`` and ``fields``; ``changes`` has ``offset``, ``operation``, ``id`` and
    ``fields``. A create gets the largest id + 1, + 2, ... in offset order. An update replaces
    the whole record. An update or delete of an id that is not there at that moment, because it
    was never made, is made later, or is deleted before, is rejected as not found.
    """
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    created = number_rows(
        changes.filter(F.col("operation") == "create").select("offset", *fields), ["offset"], "id", F.lit(1)
    ).withColumn("id", F.col("id") + top)
    # only the created rows are written; the base is read where it is
    created = cut_lineage(created.select("id", F.col("offset").alias("born"), *fields))
    known = base.select("id", F.lit(-1).cast("long").alias("born"), *fields).unionByName(created)
    edits = changes.filter(F.col("operation").isin("update", "delete"))
    dated = cut_lineage(
        edits.select("offset", "operation", "id", *fields).join(known.select("id", "born"), "id", "left")
    )
    valid = dated.filter(F.col("born").isNotNull() & (F.col("offset") > F.col("born")))
    per_id = valid.groupBy("id").agg(
        F.min(F.when(F.col("operation") == "delete", F.col("offset"))).alias("deleted_at"),
        F.max_by(
            F.when(F.col("operation") == "update", F.struct(*fields)),
            F.when(F.col("operation") == "update", F.col("offset")),
        ).alias("last"),
    )
    kept = known.join(per_id, "id", "left").filter(F.col("deleted_at").isNull())
    store = kept.select("id", *[
        F.when(F.col("last").isNotNull(), F.col("last")[f]).otherwise(F.col(f)).alias(f) for f in fields
    ])
    deletes = per_id.filter(F.col("deleted_at").isNotNull()).select("id", "deleted_at")
    judged = dated.drop(*fields).join(deletes, "id", "left")
    rejects = judged.filter(
        F.col("born").isNull() | (F.col("offset") <= F.col("born")) | (F.col("offset") > F.col("deleted_at"))
    ).select("offset", "operation", "id", F.lit("not_found").alias("reason"))
    return store, rejects
