"""How the platform's records are derived from the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.plans.spread import parts_of, spread
from tidemark.sources import topics
from tidemark.suite.registry import table

USERS_A_TASK = 20_000
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column: str | Column) -> Column:
    return F.date_format(column, STAMP)


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


# ---- change events from `events`

def cdc(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    operation = (
        F.when(kind == "signup", "create")
        .when(kind.isin("purchase", "click"), "update")
        .when(kind == "error", "delete")
        .otherwise("other")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("offset"),
        text("user_id").alias("uid"),
        "user_id",
        operation.alias("operation"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("message_type"),
        F.concat(F.lit("shop"), text(F.col("user_id") % 3)).alias("app"),
        "ts", "value", "props",
    )


SQL_CDC = """cdc AS (
  SELECT event_id AS "offset", CAST(user_id AS VARCHAR) AS uid, user_id,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update'
              WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'other' END AS operation,
         CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS message_type,
         'shop' || (user_id % 3) AS app, ts, value, props
  FROM events)"""


def cdc_topic(spark: SparkSession, sf: str) -> DataFrame:
    """The events as topic messages. Some are bad: cut JSON (offset mod 83 = 0), no operation
    (mod 97 = 0), an unknown operation (mod 89 = 0)."""
    rows = cdc(spark, sf)
    offset = F.col("offset")
    operation = F.when(offset % 97 == 0, F.lit(None)).when(offset % 89 == 0, "merge").otherwise(F.col("operation"))
    sent = ev.envelope(rows, F.col("app"), F.col("message_type"), operation, F.col("uid"), ["value", "props"])
    cut = F.expr("left(value, length(value) - 7)")
    return sent.select(
        text("uid").alias("key"),
        F.when(offset % 83 == 0, cut).otherwise(F.col("value")).alias("value"),
        topics.topic_id(F.col("app"), F.lit("cdc"), F.col("message_type")).alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        "offset",
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


SQL_GOOD = SQL_CDC + """, good AS (
  SELECT * FROM cdc WHERE "offset" % 83 <> 0 AND "offset" % 97 <> 0 AND "offset" % 89 <> 0)"""


# ---- operations from `orders`

def operations(spark: SparkSession, sf: str) -> DataFrame:
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when(state == "F", F.when(key % 5 == 0, "Error").otherwise("Failed"))
        .when(state == "O", F.when(key % 3 == 0, "Pending").otherwise("Running"))
        .when(state == "P", F.when(key % 7 == 0, "Skipped").otherwise("Succeeded"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("op-"), text(key)).alias("name"),
        status.alias("status"),
        F.col("o_orderdate").alias("create_time"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=(key % 100).cast("int"))).alias("end_time"),
        F.col("o_custkey"), F.col("o_orderpriority"),
    )


SQL_OPS = """ops AS (
  SELECT o_orderkey, 'op-' || o_orderkey AS name,
         CASE o_orderstatus
           WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Error' ELSE 'Failed' END
           WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Pending' ELSE 'Running' END
           WHEN 'P' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'Skipped' ELSE 'Succeeded' END END AS status,
         o_orderdate AS create_time,
         o_orderdate + (o_orderkey % 100) * INTERVAL 1 MINUTE AS end_time,
         o_custkey, o_orderpriority
  FROM orders)"""


def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes of the operations: one per distinct line number; the highest carries the
    operation's own status. Every tenth operation repeats its last row half an hour later."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_line"))
    ops = operations(spark, sf).join(last, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    rows = lines.join(ops, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.col("l_linenumber")
    is_last = seq == F.col("last_line")
    repeats = F.when(is_last & (F.col("o_orderkey") % 10 == 0), F.array(F.lit(0), F.lit(30))).otherwise(
        F.array(F.lit(0))
    )
    return rows.select(
        F.col("o_orderkey").alias("op"),
        seq.alias("seq"),
        F.when(is_last, F.col("status")).when(seq == 1, "Pending").otherwise("Running").alias("status"),
        "create_time",
        F.explode(repeats).alias("extra"),
    ).select("op", "seq", "status", (F.col("create_time") + F.make_dt_interval(mins=F.col("seq") + F.col("extra"))).alias("ts"))


SQL_CHANGES = SQL_OPS + """, pairs AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
lasts AS (SELECT l_orderkey, max(l_linenumber) AS last_line FROM pairs GROUP BY 1),
once AS (
  SELECT o_orderkey AS op, p.l_linenumber AS seq, last_line,
         CASE WHEN p.l_linenumber = last_line THEN status WHEN p.l_linenumber = 1 THEN 'Pending' ELSE 'Running' END AS status,
         create_time + p.l_linenumber * INTERVAL 1 MINUTE AS ts
  FROM pairs p JOIN lasts USING (l_orderkey) JOIN ops ON o_orderkey = l_orderkey),
changes AS (
  SELECT op, seq, status, ts FROM once
  UNION ALL
  SELECT op, seq, status, ts + INTERVAL 30 MINUTE FROM once WHERE seq = last_line AND op % 10 = 0)"""


# ---- users from `customer`

def identity_source(spark: SparkSession, sf: str, shared_names: bool = True) -> DataFrame:
    """Source users. Some have no user name (e-mail is used), some neither, and with
    ``shared_names`` some carry the name of another user."""
    key = F.col("c_custkey")
    name = F.when(key % 13 == 0, "").otherwise(F.col("c_name"))
    if shared_names:
        name = F.when(key % 50 == 49, F.format_string("Customer#%09d", key - 1)).otherwise(name)
    return table(spark, sf, "customer").select(
        key.alias("seq"),
        F.format_string("u%09d", key).alias("ext_id"),
        F.when(key % 17 == 0, F.lit(None)).otherwise(name).alias("username"),
        F.when(key % 17 == 0, F.lit(None)).otherwise(F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"),
    )


def sql_source(shared_names: bool = True) -> str:
    shared = "WHEN c_custkey % 50 = 49 THEN printf('Customer#%09d', c_custkey - 1)" if shared_names else ""
    return f"""src0 AS (
  SELECT c_custkey, printf('u%09d', c_custkey) AS ext_id,
         CASE WHEN c_custkey % 17 = 0 THEN NULL {shared}
              WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS username,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE lower(c_name) || '@example.com' END AS email
  FROM customer),
src AS (SELECT *, coalesce(nullif(username, ''), nullif(email, '')) AS name FROM src0)"""


def identity_target(spark: SparkSession, sf: str) -> DataFrame:
    """Target users: two thirds of the source, some without external id, some renamed."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").filter(key % 3 != 0).select(
        F.format_string("t%09d", key).alias("target_id"),
        F.when(key % 7 == 0, F.concat("c_name", F.lit("-old"))).otherwise(F.col("c_name")).alias("username"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.format_string("u%09d", key)).alias("ext_id"),
    )


SQL_TARGET = """tgt AS (
  SELECT printf('t%09d', c_custkey) AS target_id,
         CASE WHEN c_custkey % 7 = 0 THEN c_name || '-old' ELSE c_name END AS username,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE printf('u%09d', c_custkey) END AS ext_id
  FROM customer WHERE c_custkey % 3 <> 0)"""


# ---- admin events, and what the identity provider and the target hold

SYNC_STEPS = 4


def admin_events(spark: SparkSession, sf: str) -> DataFrame:
    """Admin events in four arrival steps: every user once, some again, some deleted, every nation's
    group, and kinds that nobody listens to."""
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    user = F.format_string("users/u%09d", key)
    step = (key * 7919 + 13) % SYNC_STEPS

    def event(kind: str, operation: Column, path: Column, seq: Column, at: Column, given: Column) -> Column:
        return F.when(given, F.struct(
            F.lit(kind).alias("resource_type"), operation.alias("operation_type"), path.alias("resource_path"),
            seq.cast("long").alias("seq"), at.cast("int").alias("step")))

    def rows(frame: DataFrame, *sent: Column) -> DataFrame:
        return frame.select(F.explode(F.filter(F.array(*sent), lambda e: e.isNotNull())).alias("e")).select("e.*")

    update = F.lit("UPDATE")
    users = rows(
        table(spark, sf, "customer"),
        event("USER", F.when(key % 29 == 0, "DELETE").otherwise("UPDATE"), user, key * 10, step, F.lit(True)),
        event("GROUP_MEMBERSHIP", update, F.concat(user, F.lit("/groups/x")), key * 10 + 1, (step + 2) % SYNC_STEPS, key % 10 == 0),
        event("CLIENT_ROLE_MAPPING", update, F.concat(user, F.lit("/role-mappings")), key * 10 + 2, step, key % 15 == 0),
        event("CLIENT", update, user, key * 10 + 3, step, key % 11 == 0),
    )
    group = F.concat(F.lit("groups/g"), text(nation))
    groups = rows(
        table(spark, sf, "nation"),
        event("GROUP", update, group, nation * 10 + 4, nation % SYNC_STEPS, F.lit(True)),
        event("GROUP", update, group, nation * 10 + 5, (nation + 1) % SYNC_STEPS, nation % 5 == 0),
    )
    return users.unionByName(groups)


def provider_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the provider; some carry the name of another one."""
    key = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    other = nation.select((key + 1).alias("n_nationkey"), F.col("n_name").alias("before"))
    return nation.join(other, "n_nationkey", "left").select(
        F.concat(F.lit("g"), text("n_nationkey")).alias("ext_id"),
        F.when(key % 6 == 5, F.col("before")).otherwise(F.col("n_name")).alias("name"))


def provider_members(spark: SparkSession, sf: str) -> DataFrame:
    """Memberships of the provider's users in a nation's and a region's group and in an organization."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), USERS_A_TASK)
    rows = customers.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    org = F.when(F.col("c_custkey") % 4 != 0, F.struct(
        F.lit("organization").alias("kind"), F.concat(F.lit("o"), "c_mktsegment").alias("ext_id"), F.col("c_mktsegment").alias("name")))
    groups = [F.struct(F.lit("group").alias("kind"), none.alias("ext_id"), F.col(c).alias("name")) for c in ("n_name", "r_name")]
    return rows.select(
        F.format_string("u%09d", "c_custkey").alias("user_ext"),
        F.explode(F.filter(F.array(*groups, org), lambda m: m.isNotNull())).alias("m")).select("user_ext", "m.*")


def target_groups(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").filter(key % 3 != 0).select(
        F.concat(F.lit("tg"), text(key)).alias("target_id"),
        F.when(key % 4 == 0, F.concat("n_name", F.lit("-old"))).otherwise(F.col("n_name")).alias("name"),
        F.when(key % 5 != 0, F.concat(F.lit("g"), text(key))).alias("ext_id"))


def target_organizations(spark: SparkSession, sf: str) -> DataFrame:
    """Organizations with an even number of letters wait for a link, the others have one and an old name."""
    even = F.length("s") % 2 == 0
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct().select(
        F.concat(F.lit("to"), "s").alias("target_id"),
        F.when(even, F.col("s")).otherwise(F.concat("s", F.lit("-old"))).alias("name"),
        F.when(~even, F.concat(F.lit("o"), "s")).alias("ext_id"))


def sql_directory(p: str, init: str, asked: dict[int, str]) -> str:
    """The states ``{p}s0`` to ``{p}s4`` of a directory and the labels ``{p}t0`` to ``{p}t3`` of each step's rows."""
    parts = [f"{p}s0 AS MATERIALIZED ({init})"]
    for b in range(SYNC_STEPS):
        parts.append(f"""{p}a{b} AS MATERIALIZED ({asked[b]}),
{p}k{b} AS (SELECT a.ext_id, a.name, a.active, s.name AS old_name, s.target_id AS own FROM {p}a{b} a LEFT JOIN {p}s{b} s ON s.ext_id = a.ext_id),
{p}w{b} AS (SELECT name, min(ext_id) AS winner FROM {p}k{b} WHERE ext_id IS NOT NULL AND name IS NOT NULL AND old_name IS DISTINCT FROM name GROUP BY name),
{p}r{b} AS MATERIALIZED (SELECT k.*, o.target_id AS owner, winner, CASE
    WHEN k.ext_id IS NULL THEN CASE WHEN o.target_id IS NOT NULL THEN 'there' WHEN winner IS NULL THEN 'insert' ELSE 'claimed' END
    WHEN old_name IS NOT NULL AND (k.name IS NULL OR k.name = old_name) THEN 'noop'
    WHEN k.name IS NULL THEN 'rejected' WHEN winner <> k.ext_id THEN 'conflict'
    WHEN o.target_id IS NULL THEN CASE WHEN old_name IS NULL THEN 'insert' ELSE 'rename' END
    WHEN o.ext_id IS NULL AND old_name IS NULL THEN 'adopt' ELSE 'conflict' END AS label
  FROM {p}k{b} k LEFT JOIN {p}s{b} o ON o.name = k.name LEFT JOIN {p}w{b} w ON w.name = k.name),
{p}t{b} AS MATERIALIZED (SELECT r.ext_id, r.name, r.old_name, r.active, r.label, CASE
    WHEN r.label IN ('noop', 'rename') THEN r.own WHEN r.label IN ('adopt', 'there') THEN r.owner
    WHEN r.label = 'insert' THEN 'new-' || coalesce(r.ext_id, r.name) WHEN r.label = 'claimed' THEN coalesce(c.own, 'new-' || c.ext_id) END AS target_id
  FROM {p}r{b} r LEFT JOIN {p}r{b} c ON r.label = 'claimed' AND c.ext_id = r.winner),
{p}s{b + 1} AS MATERIALIZED (
  SELECT s.target_id, CASE WHEN t.label IN ('rename', 'adopt') THEN t.name ELSE s.name END AS name, coalesce(t.ext_id, s.ext_id) AS ext_id, coalesce(t.active, s.active) AS active
  FROM {p}s{b} s LEFT JOIN {p}t{b} t ON t.target_id = s.target_id AND t.label IN ('noop', 'rename', 'adopt')
  UNION ALL SELECT target_id, name, ext_id, active FROM {p}t{b} WHERE label = 'insert')""")
    return ",\n".join(parts)


def _sql_sync() -> str:
    steps = range(SYNC_STEPS)
    users = {b: f"SELECT e.ext_id, s.name, coalesce(s.enabled, NOT e.deleted) AS active FROM ev{b} e LEFT JOIN usrc s USING (ext_id)" for b in steps}
    groups = {b: f"""SELECT ext_id, name, true AS active FROM gsrc WHERE gkey % 4 = {b} OR gkey % 5 = 0 AND (gkey + 1) % 4 = {b}
    UNION ALL SELECT DISTINCT NULL, name, true FROM want{b} WHERE kind = 'group'""" for b in steps}
    orgs = {b: f"SELECT ext_id, min(name) AS name, true AS active FROM want{b} WHERE kind = 'organization' GROUP BY ext_id" for b in steps}
    events = ",\n".join(f"""ev{b} AS MATERIALIZED (SELECT ext_id, max_by(del, seq) AS deleted FROM aev WHERE step = {b} GROUP BY ext_id)""" for b in steps)
    wants = ",\n".join(
        f"want{b} AS MATERIALIZED (SELECT m.* FROM msrc m JOIN ut{b} t ON t.ext_id = m.user_ext AND t.label IN ('noop', 'rename', 'adopt', 'insert'))"
        for b in steps)
    last = " UNION ALL ".join(f"SELECT ext_id, {b} AS b FROM ut{b} WHERE label IN ('noop', 'rename', 'adopt', 'insert')" for b in steps)
    members = " UNION ALL ".join(f"""SELECT DISTINCT {b} AS b, w.user_ext, w.kind, coalesce(g.target_id, o.target_id) AS target_id FROM want{b} w
      LEFT JOIN gt{b} g ON w.kind = 'group' AND g.ext_id IS NULL AND g.name = w.name
      LEFT JOIN ot{b} o ON w.kind = 'organization' AND o.ext_id = w.ext_id AND o.label IN ('noop', 'rename', 'adopt', 'insert')""" for b in steps)
    refused = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {b} AS b, ext_id, name, label FROM {p}t{b} WHERE label IN ('conflict', 'rejected')"
        for p, kind in (("u", "user"), ("g", "group"), ("o", "organization")) for b in steps)
    n = SYNC_STEPS
    return f"""WITH {sql_source()}, {SQL_TARGET},
usrc AS (SELECT ext_id, name, CASE WHEN c_custkey % 31 = 0 THEN true END AS enabled FROM src),
aev AS (
  SELECT c_custkey, printf('u%09d', c_custkey) AS ext_id, unnest([0, 1, 2]) AS j, (c_custkey * 7919 + 13) % 4 AS st FROM customer),
{events.replace("FROM aev WHERE step", "FROM (SELECT ext_id, j = 0 AND c_custkey % 29 = 0 AS del, c_custkey * 10 + j AS seq, CASE j WHEN 1 THEN (st + 2) % 4 ELSE st END AS step FROM aev WHERE j = 0 OR j = 1 AND c_custkey % 10 = 0 OR j = 2 AND c_custkey % 15 = 0) WHERE step")},
gsrc AS (SELECT n.n_nationkey AS gkey, 'g' || n.n_nationkey AS ext_id, CASE WHEN n.n_nationkey % 6 = 5 THEN b.n_name ELSE n.n_name END AS name
  FROM nation n LEFT JOIN nation b ON b.n_nationkey = n.n_nationkey - 1),
msrc AS MATERIALIZED (
  SELECT printf('u%09d', c_custkey) AS user_ext, 'group' AS kind, NULL AS ext_id, unnest([n_name, r_name]) AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT printf('u%09d', c_custkey), 'organization', 'o' || c_mktsegment, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0),
{sql_directory("u", "SELECT target_id, username AS name, ext_id, true AS active FROM tgt", users)},
{wants},
{sql_directory("g", "SELECT 'tg' || n_nationkey AS target_id, CASE WHEN n_nationkey % 4 = 0 THEN n_name || '-old' ELSE n_name END AS name, CASE WHEN n_nationkey % 5 <> 0 THEN 'g' || n_nationkey END AS ext_id, true AS active FROM nation WHERE n_nationkey % 3 <> 0", groups)},
{sql_directory("o", "SELECT DISTINCT 'to' || c_mktsegment AS target_id, CASE WHEN length(c_mktsegment) % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || '-old' END AS name, CASE WHEN length(c_mktsegment) % 2 = 1 THEN 'o' || c_mktsegment END AS ext_id, true AS active FROM customer", orgs)},
last AS (SELECT ext_id, max(b) AS b FROM ({last}) GROUP BY ext_id),
members AS ({members}),
refused AS ({refused})
SELECT 'user' AS kind, target_id AS id, name, ext_id, active, NULL AS label FROM us{n}
UNION ALL SELECT 'group', target_id, name, ext_id, active, NULL FROM gs{n}
UNION ALL SELECT 'organization', target_id, name, ext_id, active, NULL FROM os{n}
UNION ALL SELECT 'member of ' || m.kind, m.user_ext, m.target_id, NULL, NULL, NULL FROM members m JOIN last l ON l.ext_id = m.user_ext AND l.b = m.b WHERE m.target_id IS NOT NULL
UNION ALL SELECT 'refused ' || kind, CAST(b AS VARCHAR), name, ext_id, NULL, label FROM refused"""


SQL_SYNC = _sql_sync()


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """Role assignments: the order priorities of a customer."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("role"))


def admins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an urgent order in 2001."""
    orders = table(spark, sf, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 2001)
    return orders.filter(urgent).select(F.col("o_custkey").alias("user"))


# ---- groups from `region`, `nation` and `customer`

def user_groups(spark: SparkSession, sf: str) -> DataFrame:
    """(user, path, attributes) rows: region, nation and segment groups of two branches."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # a user's rows are expanded in one task of few users; equal rows leave before, so a user has few
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    parts = parts_of(customers, USERS_A_TASK)
    customers = customers.repartition(parts).distinct().repartition(parts, "c_custkey").select(
        "c_custkey", "c_mktsegment",
        F.explode(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 25)).alias("n_nationkey"),
    )
    # named, as the planner may else send the customers, a small file of many rows, and have one task do the rest
    rows = customers.join(F.broadcast(nations), "n_nationkey")
    region = F.concat(F.lit("/"), F.col("r_name"))
    nation = F.concat(region, F.lit("/"), F.col("n_name"))
    segment = F.concat(nation, F.lit("/"), F.col("c_mktsegment"))

    def group(path: Column, value: Column, given: Column) -> Column:
        key = F.when(given, "quota-max").otherwise("other")
        return F.struct(path.alias("path"), key.alias("key"), F.when(given, value).otherwise("x").alias("value"))

    levels = F.array(
        group(region, F.concat(text(F.col("r_regionkey") * 10), F.lit("Gb")), F.lit(True)),
        group(nation, text("n_nationkey"), F.col("n_nationkey") % 3 != 0),
        group(segment, text(F.length("c_mktsegment")), F.col("n_nationkey") % 4 == 0),
    )
    found = rows.select(F.col("c_custkey").alias("user"), F.explode(levels).alias("g")).select("user", "g.*").distinct()
    return found.select("user", "path", F.create_map("key", F.array("value")).alias("attributes"))


SQL_GROUPS = """br AS (
  SELECT c_custkey, c_mktsegment, unnest([c_nationkey, (c_nationkey + 7) % 25]) AS nk FROM customer),
places AS (SELECT br.*, n_nationkey, n_name, r_regionkey, r_name FROM br JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey),
groups AS (
  SELECT DISTINCT c_custkey AS "user", '/' || r_name AS path, (r_regionkey * 10) || 'Gb' AS q FROM places
  UNION SELECT c_custkey, '/' || r_name || '/' || n_name,
        CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS VARCHAR) END FROM places
  UNION SELECT c_custkey, '/' || r_name || '/' || n_name || '/' || c_mktsegment,
        CASE WHEN n_nationkey % 4 = 0 THEN CAST(length(c_mktsegment) AS VARCHAR) END FROM places)"""


# ---- dependency edges from `part`

def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each part depends on the part with half its key; some also on an unknown part."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("hard"), F.lit("soft"), F.lit("build")), (key % 3 + 1).cast("int"))
    unknown = F.when(key % 31 == 0, F.array(F.floor(key / 2), -key)).otherwise(F.array(F.floor(key / 2)))
    return table(spark, sf, "part").filter(key > 0).select(
        key.alias("src"), F.explode(unknown).alias("dst"), kind.alias("kind")
    )


SQL_EDGES = """edges AS (
  SELECT p_partkey AS src, p_partkey // 2 AS dst,
         CASE p_partkey % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' ELSE 'build' END AS kind
  FROM part WHERE p_partkey > 0
  UNION ALL
  SELECT p_partkey, -p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' ELSE 'build' END
  FROM part WHERE p_partkey > 0 AND p_partkey % 31 = 0)"""


# ---- application configurations from `nation` and `region`

def app_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON configuration per nation; some members are null or missing."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    auto = F.when(key % 4 == 0, "true").when(key % 4 == 1, "false").when(key % 4 == 2, "null")
    deployment = F.when(auto.isNull(), "{}").otherwise(F.concat(F.lit('{"auto":'), auto, F.lit("}")))
    sub = F.when(key % 5 == 0, '""').otherwise(F.concat(F.lit('"'), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit('"')))
    aliases = F.when(key % 3 == 0, F.concat(F.lit('["www'), text(key), F.lit('","'), F.lower("r_name"), F.lit('"]'))).otherwise("null")
    body = F.concat(
        F.lit('{"name":"'), F.col("n_name"), F.lit('","harness":{"name":"'), F.lower("n_name"),
        F.lit('","deployment":'), deployment, F.lit(',"service":{"port":'), text(key + 8000),
        F.lit('},"port":'), text(key + 8000), F.lit(',"subdomain":'), sub, F.lit(',"aliases":'), aliases, F.lit("}}"),
    )
    return nations.select("n_nationkey", "n_name", body.alias("config"))
