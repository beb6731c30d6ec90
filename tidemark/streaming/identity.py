"""Users, groups, organizations and memberships kept in step with a source by its admin events.

A batch is collapsed to the distinct ids it names, the source is asked for these, and only the buckets
of the state that they touch are read and written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.identity import route_admin_events, username_of
from tidemark.session import cut_lineage
from tidemark.streaming.consume import write_batch
from tidemark.streaming.keyed import KeyedTable

ENTRY = "key string, name string, target_id string, ext_id string, active boolean"
TAKEN = ("noop", "rename", "adopt", "insert")
REFUSED = "kind string, ext_id string, name string, label string"


def _by_name(name: str | Column) -> Column:
    return F.concat(F.lit("n:"), name)


def _by_id(ext_id: str | Column) -> Column:
    return F.concat(F.lit("e:"), ext_id)


class Directory:
    """Records of one kind with a unique name and at most one external id, in one keyed table: an entry
    by name, which is the record, and one by external id, which leads to the name."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.entries = KeyedTable(spark, path, ENTRY, "key", buckets)

    def load(self, target: DataFrame) -> None:
        """Begin with (target_id, name, ext_id) rows, names and external ids unique."""
        self.entries.load(self._entries(target.select("name", "target_id", "ext_id", F.lit(True).alias("active"))))

    @staticmethod
    def _entries(rows: DataFrame) -> DataFrame:
        keys = F.filter(F.array(_by_name("name"), _by_id("ext_id")), lambda k: k.isNotNull())
        return rows.select(F.explode(keys).alias("key"), "name", "target_id", "ext_id", "active")

    def records(self) -> DataFrame:
        """All records: name, target_id, ext_id, active."""
        return self.entries.read().filter(F.col("key").startswith("n:")).drop("key")

    def resolve(self, asked: DataFrame, batch_id: int) -> DataFrame:
        """Labels of one row per external id (``ext_id``, ``name``, ``active``) and of names that only have to be
        there (``ext_id`` null): with ``target_id`` and ``old_name``.

        A row that is linked by its external id is ``noop`` or ``rename``; else a record of its name
        without an external id is ``adopt``ed, and a free name is an ``insert``. A name that another record has, or
        that a lower external id claims in the same batch, is a ``conflict``; a row without a name is
        ``rejected`` unless it is linked. Names that become free in a batch are free from the next one on.
        """
        links = self.entries.read(batch_id, self.entries.touched(asked.select(_by_id("ext_id"))))
        linked = links.filter(F.col("key").startswith("e:")).select("ext_id", F.col("name").alias("old_name"))
        known = asked.join(linked, "ext_id", "left").persist()
        names = known.select(F.explode(F.array(_by_name("name"), _by_name("old_name"))))
        held = self.entries.read(batch_id, self.entries.touched(names)).filter(F.col("key").startswith("n:")).select(
            "name", F.col("target_id").alias("owner"), F.col("ext_id").alias("owner_ext"))
        own = held.select(F.col("name").alias("old_name"), F.col("owner").alias("own_target"))
        claims = F.col("name").isNotNull() & F.col("ext_id").isNotNull() & (F.col("old_name").isNull() | (F.col("old_name") != F.col("name")))
        winners = known.filter(claims).groupBy("name").agg(F.min("ext_id").alias("winner"))
        rows = known.join(held, "name", "left").join(own, "old_name", "left").join(winners, "name", "left")
        same = F.col("old_name").isNotNull() & (F.col("name").isNull() | (F.col("name") == F.col("old_name")))
        label = (
            F.when(F.col("ext_id").isNull(), F.when(F.col("owner").isNotNull(), "there").when(F.col("winner").isNull(), "insert").otherwise("claimed"))
            .when(same, "noop")
            .when(F.col("name").isNull(), "rejected")
            .when(F.col("winner") != F.col("ext_id"), "conflict")
            .when(F.col("owner").isNull(), F.when(F.col("old_name").isNull(), "insert").otherwise("rename"))
            .when(F.col("owner_ext").isNull() & F.col("old_name").isNull(), "adopt")
            .otherwise("conflict")
        )
        target = (
            F.when(F.col("label").isin("noop", "rename"), F.col("own_target"))
            .when(F.col("label").isin("adopt", "there"), F.col("owner"))
            .when(F.col("label") == "insert", F.concat(F.lit("new-"), F.coalesce("ext_id", "name")))
        )
        out = rows.withColumn("label", label).withColumn("target_id", target)
        # a name claimed by a row of this batch has that row's target
        given = out.filter(F.col("label").isin(*TAKEN) & F.col("ext_id").isNotNull()).select("name", F.col("target_id").alias("claimed"))
        out = out.join(given, "name", "left").withColumn("target_id", F.when(F.col("label") == "claimed", F.col("claimed")).otherwise(F.col("target_id")))
        out = cut_lineage(out.select("ext_id", "name", "old_name", "active", "label", "target_id"))
        known.unpersist()
        return out

    def apply(self, resolved: DataFrame, batch_id: int) -> None:
        """Write what ``resolve`` decided."""
        done = resolved.filter(F.col("label").isin(*TAKEN))
        rows = done.select(
            F.when(F.col("label") == "noop", F.col("old_name")).otherwise(F.col("name")).alias("name"), "target_id", "ext_id", "active")
        gone = done.filter("old_name is not null").select(_by_name("old_name"))
        self.entries.replace(self._entries(rows), gone, batch_id)


@dataclass
class Source:
    """What the identity provider knows, as frames that are read anew in each batch.

    ``users``: ext_id, username, email, enabled (null: unless deleted). ``groups``: ext_id, name.
    ``members``: user_ext, kind (``group`` or ``organization``), ext_id (of an organization), name.
    """

    users: Callable[[], DataFrame]
    groups: Callable[[], DataFrame]
    members: Callable[[], DataFrame]


class IdentityStore:
    """The target side: three directories, and the memberships by user."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.users, self.groups, self.organizations = (Directory(spark, f"{path}/{n}", buckets) for n in ("users", "groups", "organizations"))
        self.members = KeyedTable(spark, f"{path}/members", "user_ext string, kind string, target_id string", "user_ext", buckets)
        self.refused = f"{path}/refused"

    def _mentioned(self, batch: DataFrame) -> DataFrame:
        """One row per entity that the batch's events name, with what the last event of a user says."""
        routed = route_admin_events(batch).filter(F.col("entity_id").isNotNull())
        return cut_lineage(routed.groupBy("action", F.col("entity_id").alias("ext_id")).agg(
            F.max_by("is_delete", F.struct("seq", "is_delete")).alias("deleted")))

    def apply(self, batch: DataFrame, batch_id: int, source: Source) -> None:
        """Bring the entities of a batch of admin events (resource_type, operation_type, resource_path,
        seq) in step. Conflicts and rejected users are written below ``refused``, and the rest of the batch goes on."""
        named = self._mentioned(batch)
        asked = named.filter("action = 'sync_user'").select("ext_id", "deleted").join(source.users(), "ext_id", "left")
        active = F.coalesce("enabled", ~F.col("deleted"))
        users = self.users.resolve(asked.select("ext_id", username_of(F.col("username"), F.col("email")).alias("name"), active.alias("active")), batch_id)
        self.users.apply(users, batch_id)
        taken = users.filter(F.col("label").isin(*TAKEN)).select(F.col("ext_id").alias("user_ext"))
        wanted = cut_lineage(source.members().join(taken, "user_ext").filter(F.col("name").isNotNull()).distinct())

        groups = named.filter("action = 'sync_group'").select("ext_id").join(source.groups(), "ext_id").select("ext_id", "name")
        by_name = wanted.filter("kind = 'group'").select(F.lit(None).cast("string").alias("ext_id"), "name").distinct()
        groups = self.groups.resolve(groups.unionByName(by_name).withColumn("active", F.lit(True)), batch_id)
        self.groups.apply(groups, batch_id)
        orgs = wanted.filter("kind = 'organization' and ext_id is not null").groupBy("ext_id").agg(F.min("name").alias("name"))
        orgs = self.organizations.resolve(orgs.withColumn("active", F.lit(True)), batch_id)
        self.organizations.apply(orgs, batch_id)

        group_of = groups.filter("ext_id is null").select("name", "target_id")
        org_of = orgs.filter(F.col("label").isin(*TAKEN)).select("ext_id", "target_id")
        members = wanted.filter("kind = 'group'").join(group_of, "name").select("user_ext", "kind", "target_id").unionByName(
            wanted.filter("kind = 'organization'").join(org_of, "ext_id").select("user_ext", "kind", "target_id"))
        self.members.replace(members.distinct(), taken, batch_id)

        refused = None
        for kind, rows in (("user", users), ("group", groups), ("organization", orgs)):
            lost = rows.filter(F.col("label").isin("conflict", "rejected")).select(F.lit(kind).alias("kind"), "ext_id", "name", "label")
            refused = lost if refused is None else refused.unionByName(lost)
        write_batch(refused, self.refused, batch_id)


def sync_admin_events(events: DataFrame, store: IdentityStore, checkpoint: str, source: Source):
    """Keep ``store`` in step with ``source`` as admin events arrive."""
    return events.writeStream.foreachBatch(lambda batch, n: store.apply(batch, n, source)).option("checkpointLocation", checkpoint)
