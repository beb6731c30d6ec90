"""Users, groups, organizations and memberships kept equal to a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import UUID_PATTERN, path_id
from tidemark.session import cut_lineage

# Resource types that are listened to, by handler.
GROUP_TYPES = ("GROUP",)
USER_TYPES = ("CLIENT_ROLE_MAPPING", "USER", "GROUP_MEMBERSHIP", "ORGANIZATION_MEMBERSHIP")


def route_admin_events(events: DataFrame) -> DataFrame:
    """Action and entity id of the admin events that are listened to; only a user event can
    carry a delete."""
    kind = F.col("resource_type")
    action = F.when(kind.isin(*GROUP_TYPES), "sync_group").otherwise("sync_user")
    return events.filter(kind.isin(*GROUP_TYPES, *USER_TYPES)).withColumns({
        "action": action,
        "is_delete": (kind == "USER") & (F.col("operation_type") == "DELETE"),
        "entity_id": path_id(F.col("resource_path")),
    })


def find_users(requests: DataFrame, users: DataFrame, arg: str = "arg") -> DataFrame:
    """Look up each argument by id when it is a UUID, else by exact user name.

    ``users`` has (id, username); of several users with one name the first id is taken. A request
    without a hit, or without an argument, has the status ``not_found``.
    """
    by_id = F.coalesce(F.col(arg).rlike(UUID_PATTERN), F.lit(False))
    ids = users.select(F.col("id").alias(arg), F.col("id").alias("found"))
    names = users.groupBy(F.col("username").alias(arg)).agg(F.min("id").alias("found"))
    hits = requests.filter(by_id).join(ids, arg, "left").unionByName(
        requests.filter(~by_id).join(names, arg, "left")
    )
    return hits.withColumn("status", F.when(F.col("found").isNull(), "not_found").otherwise("found"))


def username_of(username: Column, email: Column) -> Column:
    """User name, or the e-mail address where it is empty."""
    return F.coalesce(F.nullif(username, F.lit("")), F.nullif(email, F.lit("")))


def map_user(users: DataFrame, admin: Column, deleted: Column) -> DataFrame:
    """Target user record. Without an ``enabled`` flag the user is active unless deleted."""
    return users.select(
        "id",
        username_of(F.col("username"), F.col("email")).alias("username"),
        F.coalesce("first_name", F.lit("")).alias("first_name"),
        F.coalesce("last_name", F.lit("")).alias("last_name"),
        F.coalesce("email", F.lit("")).alias("email"),
        admin.alias("is_staff"),
        admin.alias("is_superuser"),
        F.coalesce("enabled", ~deleted).alias("is_active"),
    )


def _two_key_match(source: DataFrame, target: DataFrame, only_unlinked: bool) -> DataFrame:
    """Match (ext_id, name) rows to (target_id, name, ext_id) rows: by external id, else by name.

    Columns added: ``target_id``, ``target_name``, ``by`` = id / name / none / conflict / rejected.
    A target that some source matched by id is not taken again by name, and of several sources
    with one name the lowest external id takes it; the others are conflicts. With
    ``only_unlinked`` a name only matches targets without an external id.

    One full outer join on the external id, unique on both sides, tells matched rows, open
    sources and open targets apart. The winner of a name is joined back on its own unique id, so
    a name shared by very many rows is only ever grouped, never joined on.
    """
    linked = target.filter(F.col("ext_id").isNotNull()).select(
        "ext_id", F.col("target_id").alias("id_target"), F.col("name").alias("id_name")
    )
    sides = cut_lineage(source.withColumn("in_source", F.lit(True)).join(linked, "ext_id", "full"))
    step1 = sides.filter("in_source").drop("in_source")
    winners = step1.filter(F.col("id_target").isNull() & F.col("name").isNotNull()).groupBy("name").agg(
        F.min("ext_id").alias("ext_id")
    )
    open_target = F.lit(False) if only_unlinked else F.col("in_source").isNull()
    offers = sides.filter(F.col("id_target").isNotNull()).select(
        F.col("id_name").alias("name"), F.col("id_target").alias("name_target"), open_target.alias("name_free")
    ).unionByName(
        target.filter(F.col("ext_id").isNull()).select(
            "name", F.col("target_id").alias("name_target"), F.lit(True).alias("name_free")
        )
    )
    named = winners.join(offers, "name", "left").drop("name").withColumn("winner", F.lit(True))
    rows = step1.join(named, "ext_id", "left")
    by = (
        F.when(F.col("id_target").isNotNull(), "id")
        .when(F.col("name").isNull(), "rejected")
        .when(F.col("winner").isNull(), "conflict")
        .when(F.col("name_target").isNull(), "none")
        .when(F.col("name_free"), "name")
        .otherwise("conflict")
    )
    return rows.withColumn("by", by).withColumn(
        "target_id", F.when(F.col("by") == "id", F.col("id_target")).when(F.col("by") == "name", F.col("name_target"))
    ).withColumn("target_name", F.when(F.col("by") == "id", F.col("id_name"))).drop(
        "id_target", "id_name", "name_target", "name_free", "winner"
    )


def match_by_email(target: DataFrame, source: DataFrame) -> DataFrame:
    """Give target users the ``ext_id`` of the source user with the same e-mail address, of several the
    lowest; NULL where there is none. An empty address matches nothing. Addresses are grouped before
    the join, so one that very many source users share is one row."""
    first = source.filter(F.nullif(F.col("email"), F.lit("")).isNotNull()).groupBy("email").agg(F.min("ext_id").alias("ext_id"))
    return target.join(first, "email", "left")


def resolve_users(source: DataFrame, target: DataFrame) -> DataFrame:
    """Label source users ``matched_id``, ``matched_name``, ``new``, ``rejected`` (no user name
    and no e-mail) or ``conflict`` (the name belongs to another user of the batch).

    ``source``: ext_id, username, email. ``target``: target_id, username, ext_id (unique each).
    """
    named = source.withColumn("name", username_of(F.col("username"), F.col("email")))
    matched = _two_key_match(named, target.withColumnRenamed("username", "name"), only_unlinked=False)
    labels = {"id": "matched_id", "name": "matched_name", "none": "new"}
    label = F.col("by")
    for short, long in labels.items():
        label = F.when(F.col("by") == short, long).otherwise(label)
    return matched.withColumn("label", label).drop("by", "target_name")


def upsert_organizations(source: DataFrame, target: DataFrame) -> DataFrame:
    """Action per source organization: ``noop``, ``rename``, ``adopt`` (a row of that name without
    an external id gets it), ``insert`` or ``conflict``."""
    matched = _two_key_match(source, target, only_unlinked=True)
    by = F.col("by")
    action = (
        F.when((by == "id") & (F.col("target_name") == F.col("name")), "noop")
        .when(by == "id", "rename")
        .when(by == "name", "adopt")
        .when(by == "none", "insert")
        .otherwise(by)
    )
    return matched.withColumn("action", action).drop("by", "target_name")


def upsert_groups(source: DataFrame, groups: DataFrame, superusers: DataFrame) -> DataFrame:
    """Action per source group: ``noop`` / ``rename`` by team id, ``exists`` when the group of that
    name has a team, ``add_team`` when it has none, ``create`` when there is no such group.

    ``groups``: group_id, name, ext_id (the team's). The owner of a new team is the first
    superuser; without one no team is made and the owner is NULL.
    """
    owner = superusers.agg(F.min("user_id").alias("owner")).scalar()
    teams = groups.filter(F.col("ext_id").isNotNull()).select("ext_id", F.col("name").alias("team_name"))
    names = groups.select("name", F.col("ext_id").isNotNull().alias("has_team"))
    rows = source.join(teams, "ext_id", "left").join(names, "name", "left")
    action = (
        F.when(F.col("team_name") == F.col("name"), "noop")
        .when(F.col("team_name").isNotNull(), "rename")
        .when(F.col("has_team").isNull(), "create")
        .when(F.col("has_team"), "exists")
        .otherwise("add_team")
    )
    needs_team = F.col("action").isin("create", "add_team")
    return rows.withColumn("action", action).withColumn("owner", F.when(needs_team, owner)).drop(
        "team_name", "has_team"
    )


def reconcile(desired: DataFrame, current: DataFrame, batch_users: DataFrame, user: str, member_of: str) -> DataFrame:
    """Pairs to insert and to delete so that the target equals the source, for the users of the
    batch only. One grouping of both sides, which also removes repeated pairs on the map side."""
    sides = desired.select(user, member_of, F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(
        current.select(user, member_of, F.lit(0).alias("want"), F.lit(1).alias("have"))
    )
    pairs = sides.groupBy(user, member_of).agg(F.max("want").alias("want"), F.max("have").alias("have"))
    changed = pairs.filter(F.col("want") != F.col("have"))
    action = F.when(F.col("want") == 1, "insert").otherwise("delete")
    return changed.join(batch_users.select(user).distinct(), user, "left_semi").select(
        user, member_of, action.alias("action")
    )


def flag_members(users: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean column: does the user occur in ``members``?"""
    marked = members.select(key).distinct().withColumn("_m", F.lit(True))
    return users.join(marked, key, "left").withColumn(flag, F.coalesce("_m", F.lit(False))).drop("_m")


def user_details(users: DataFrame, related: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Users with one sorted array per relation.

    ``related`` maps the new column to (frame, value column). All relations of one frame come from
    one grouping of it. Values are made distinct on the map side; an array is at most as long as
    there are groups, roles or organizations.
    """
    frames = {id(frame): frame for frame, _ in related.values()}
    out = users
    for one, frame in frames.items():
        sets = [F.sort_array(F.collect_set(value)).alias(name) for name, (of, value) in related.items() if id(of) == one]
        arrays = frame.groupBy(key).agg(*sets)
        out = out.join(arrays, key, "left").withColumns({
            c: F.coalesce(c, F.array().cast(arrays.schema[c].dataType)) for c in arrays.columns if c != key
        })
    return out.select(*users.columns, *related)


def group_members(groups: DataFrame, members: DataFrame, details: DataFrame, group: str, user: str) -> DataFrame:
    """Members of each group with their details, one row per member (a group may hold any number
    of users, so they are not collected in one array); an empty group has one row without member.

    An inner join and an anti join instead of one outer join: AQE can split a group with very
    many members in the first, and the second only sees distinct group names.
    """
    pairs = members.select(group, user).distinct()
    filled = pairs.join(groups, group).join(details, user, "left")
    empty = groups.join(members.select(group).distinct(), group, "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def members_count(organizations: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """Members per organization, 0 included. Members are counted before the join."""
    counts = members.groupBy(key).agg(F.count(member).alias("n"))
    return organizations.join(counts, key, "left").withColumn("members_count", F.coalesce("n", F.lit(0))).drop("n")


def roles_of(assignments: DataFrame, user: str, role: str) -> DataFrame:
    """The distinct roles of each user as an array."""
    return assignments.groupBy(user).agg(F.sort_array(F.collect_set(role)).alias("roles"))


def has_role(roles: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(roles, name), F.lit(False))


def role_members(assignments: DataFrame, role_column: str, user: str, role: str) -> DataFrame:
    """All users that hold a role."""
    return assignments.filter(F.col(role_column) == role).select(user).distinct()


def auth_level(roles: Column, admin: str, privileged: Sequence[str], known: Sequence[str]) -> Column:
    """Privilege level of a set of role names."""
    def any_of(names: Sequence[str]) -> Column:
        return F.arrays_overlap(roles, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(F.array_contains(roles, admin), "ADMIN")
        .when(any_of(privileged), "PRIVILEGED")
        .when(any_of(known), "NON_PRIVILEGED")
        .otherwise("NO_AUTHORIZATION")
    )


def unique_lookup(requests: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """Look up names that must be unique: ``ok``, ``ambiguous`` or ``missing``."""
    counts = entries.groupBy(name).agg(F.count("*").alias("hits"))
    found = requests.join(counts, name, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("hits") == 1, "ok").when(F.col("hits") > 1, "ambiguous").otherwise("missing")
    return found.withColumn("status", status)


def keep_lowest(users: DataFrame, group: str, key: str) -> DataFrame:
    """Flag the row with the lowest ``key`` per ``group`` as kept, the others as removed. The
    winners join back on the unique key, not on the group. Rows without a group are kept."""
    first = users.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias(key)).select(key, F.lit(True).alias("_k"))
    kept = F.coalesce("_k", F.col(group).isNull())
    return users.join(first, key, "left").withColumn("kept", kept).drop("_k")
