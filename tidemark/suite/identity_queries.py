"""Identity, attributes and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import attributes as at
from tidemark.operators import identity, layers, picks
from tidemark.plans.spread import spread
from tidemark.suite import derive as d
from tidemark.suite.registry import query, table

# One row per source user: by id, else by the name's lowest claimant, else new or conflict.
SQL_RESOLVED = f"""WITH {d.sql_source()}, {d.SQL_TARGET},
byid AS (SELECT src.*, tgt.target_id AS tid FROM src LEFT JOIN tgt USING (ext_id)),
claim AS (SELECT name, min(ext_id) AS ext_id FROM byid WHERE tid IS NULL AND name IS NOT NULL GROUP BY name)"""
SQL_LABELS = SQL_RESOLVED + """,
res AS (SELECT b.ext_id, b.name,
  CASE WHEN b.tid IS NOT NULL THEN 'matched_id' WHEN b.name IS NULL THEN 'rejected'
       WHEN c.ext_id IS NULL THEN 'conflict' WHEN t.target_id IS NULL THEN 'new'
       WHEN t.target_id IN (SELECT tid FROM byid WHERE tid IS NOT NULL) THEN 'conflict'
       ELSE 'matched_name' END AS label, b.tid, t.target_id AS name_tid
FROM byid b LEFT JOIN claim c ON c.ext_id = b.ext_id LEFT JOIN tgt t ON t.username = b.name)"""


@query("resolve_users", SQL_LABELS + """
SELECT ext_id, name, label, CASE label WHEN 'matched_id' THEN tid WHEN 'matched_name' THEN name_tid END AS target_id FROM res""")
def resolve_users(spark, sf):
    rows = identity.resolve_users(d.identity_source(spark, sf), d.identity_target(spark, sf))
    return rows.select("ext_id", "name", "label", "target_id")


@query("map_users", """
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 13 <> 0 THEN c_name END, lower(c_name) || '@example.com') AS username,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS first_name, '' AS last_name,
       lower(c_name) || '@example.com' AS email, c_acctbal > 9000 AS is_staff, c_acctbal > 9000 AS is_superuser,
       CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 <> 0 ELSE c_custkey % 2 = 0 END AS is_active
FROM customer""")
def map_users(spark, sf):
    key = F.col("c_custkey")
    users = table(spark, sf, "customer").select(
        key.alias("id"),
        F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("username"),
        F.when(key % 4 != 0, F.col("c_mktsegment")).alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(key % 3 != 0, key % 2 == 0).alias("enabled"),
        (F.col("c_acctbal") > 9000).alias("admin"), (key % 10 == 0).alias("deleted"),
    )
    return identity.map_user(users, F.col("admin"), F.col("deleted"))


@query("upsert_orgs", """
WITH s AS (SELECT s_suppkey, printf('o%06d', s_suppkey) AS ext_id, n_name || '/' || s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT ext_id, name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'insert'
       WHEN s_suppkey % 4 = 1 THEN CASE WHEN s_suppkey % 5 = 0 THEN 'insert' ELSE 'adopt' END
       WHEN s_suppkey % 5 = 0 THEN 'rename' ELSE 'noop' END AS action,
  CASE WHEN s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey % 5 = 0) THEN NULL ELSE printf('t%06d', s_suppkey) END AS target_id
FROM s""")
def upsert_orgs(spark, sf):
    key = F.col("s_suppkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    named = table(spark, sf, "supplier").join(nations, "s_nationkey").withColumn("name", F.concat("n_name", F.lit("/"), "s_name"))
    ext = F.format_string("o%06d", key)
    source = named.select(ext.alias("ext_id"), "name")
    target = named.filter(key % 4 != 0).select(
        F.format_string("t%06d", key).alias("target_id"),
        F.when(key % 5 == 0, F.concat("name", F.lit(" old"))).otherwise(F.col("name")).alias("name"),
        F.when(key % 4 != 1, ext).alias("ext_id"),
    )
    return identity.upsert_organizations(source, target).select("ext_id", "name", "action", "target_id")


@query("upsert_groups", """
WITH own AS (SELECT min(c_custkey) AS o FROM customer WHERE c_acctbal > 9000),
g AS (SELECT 'g' || n_nationkey AS ext_id, n_name AS name, n_nationkey % 5 AS m FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 4 FROM region)
SELECT ext_id, name, CASE m WHEN 0 THEN 'noop' WHEN 1 THEN 'rename' WHEN 2 THEN 'exists' WHEN 3 THEN 'add_team' ELSE 'create' END AS action,
       CASE WHEN m >= 3 THEN (SELECT o FROM own) END AS owner
FROM g""")
def upsert_groups(spark, sf):
    key = F.col("n_nationkey")
    nations = table(spark, sf, "nation")
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), d.text("r_regionkey")).alias("ext_id"), F.col("r_name").alias("name"))
    source = nations.select(F.concat(F.lit("g"), d.text(key)).alias("ext_id"), F.col("n_name").alias("name")).unionByName(regions)
    case = key % 5
    groups = nations.filter(case < 4).select(
        key.alias("group_id"),
        F.when(case == 1, F.concat("n_name", F.lit(" old"))).otherwise(F.col("n_name")).alias("name"),
        F.when(case < 2, F.concat(F.lit("g"), d.text(key))).when(case == 2, F.concat(F.lit("x"), d.text(key))).alias("ext_id"),
    )
    superusers = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"))
    return identity.upsert_groups(source, groups, superusers).select("ext_id", "name", "action", "owner")


@query("reconcile_members", """
WITH des AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')),
cur AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')),
ins AS (SELECT * FROM des EXCEPT SELECT * FROM cur), del AS (SELECT * FROM cur EXCEPT SELECT * FROM des)
SELECT *, 'insert' AS action FROM ins UNION ALL SELECT *, 'delete' FROM del""")
def reconcile_members(spark, sf):
    orders = table(spark, sf, "orders")
    new = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    batch = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return identity.reconcile(orders.filter(new), orders.filter(~new), batch, "o_custkey", "o_orderpriority")


@query("flag_admins", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 2001) AS is_superuser
FROM customer""")
def flag_admins(spark, sf):
    admins = d.admins(spark, sf).withColumnRenamed("user", "c_custkey")
    return identity.flag_members(table(spark, sf, "customer").select("c_custkey"), admins, "c_custkey", "is_superuser")


@query("user_details", """
SELECT c_custkey, c_name,
  coalesce((SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS roles,
  coalesce((SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey), '') AS groups,
  (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS organizations
FROM customer""")
def user_details(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    related = {
        "roles": (orders, "o_orderpriority"), "groups": (orders, "o_orderstatus"),
        "organizations": (customers.join(nations, "c_nationkey").select("c_custkey", "n_name"), "n_name"),
    }
    rows = identity.user_details(customers.select("c_custkey", "c_name"), related, "c_custkey")
    return rows.select("c_custkey", "c_name", *[F.array_join(c, ",").alias(c) for c in related])


@query("group_members", """
SELECT n_name, CAST(c_custkey AS VARCHAR) AS member,
  (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS roles
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey""")
def group_members(spark, sf):
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    details = identity.roles_of(d.roles(spark, sf), "user", "role").withColumnRenamed("user", "c_custkey")
    rows = identity.group_members(groups, table(spark, sf, "customer"), details, "c_nationkey", "c_custkey")
    return rows.select("n_name", d.text("c_custkey").alias("member"), F.array_join("roles", ",").alias("roles"))


@query("members_count", """
SELECT name, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS members_count
FROM (SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region)""")
def members_count(spark, sf):
    orgs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("org"), F.col("n_name").alias("name")).unionByName(
        table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("org"), F.col("r_name").alias("name"))
    )
    members = table(spark, sf, "customer").select(F.col("c_nationkey").alias("org"), "c_custkey")
    return identity.members_count(orgs, members, "org", "c_custkey").select("name", "members_count")


@query("role_members", """
SELECT DISTINCT o_custkey AS "user" FROM orders WHERE o_orderpriority = '2-HIGH'""")
def role_members(spark, sf):
    return identity.role_members(d.roles(spark, sf), "role", "user", "2-HIGH")


@query("auth_level", """
WITH r AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS rs FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY 1)
SELECT c_custkey, CASE WHEN list_contains(rs, '1-URGENT') THEN 'ADMIN'
    WHEN list_contains(rs, '2-HIGH') OR list_contains(rs, '3-MEDIUM') THEN 'PRIVILEGED'
    WHEN list_contains(rs, '5-LOW') THEN 'NON_PRIVILEGED' ELSE 'NO_AUTHORIZATION' END AS level
FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def auth_level(spark, sf):
    recent = table(spark, sf, "orders").filter(F.year("o_orderdate") >= 2000)
    roles = identity.roles_of(recent, "o_custkey", "o_orderpriority").withColumnRenamed("o_custkey", "c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey").join(roles, "c_custkey", "left")
    return rows.select("c_custkey", identity.auth_level(F.col("roles"), "1-URGENT", ["2-HIGH", "3-MEDIUM"], ["5-LOW"]).alias("level"))


@query("lookup_unique", """
WITH e AS (SELECT p_name || '-' || p_brand || '-' || p_size AS name FROM part),
q AS (SELECT DISTINCT name FROM e UNION ALL SELECT s_name FROM supplier)
SELECT q.name, count(e.name) AS hits, CASE count(e.name) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status
FROM q LEFT JOIN e ON e.name = q.name GROUP BY q.name""")
def lookup_unique(spark, sf):
    entries = table(spark, sf, "part").select(F.concat_ws("-", "p_name", "p_brand", d.text("p_size")).alias("name"))
    requests = entries.distinct().unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return identity.unique_lookup(requests, entries, "name").select("name", "hits", "status")


@query("lookup_chain", """
SELECT p_partkey, b AS base_name, CASE WHEN p_partkey % 3 = 0 THEN 'app/' || b WHEN p_partkey % 3 = 1 THEN 'task/' || b ELSE b END AS image
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN s_name ELSE 'ext-' || p_name END AS b
      FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))""")
def lookup_chain(spark, sf):
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    count = supplier.agg(F.count("*").alias("n")).scalar()
    suppliers = supplier.select(F.col("s_suppkey").alias("sk"), "s_name")
    key = F.col("p_partkey")
    base = F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 1, F.col("s_name")).otherwise(F.concat(F.lit("ext-"), "p_name"))
    names = part.withColumn("sk", key % count).join(suppliers, "sk").select("p_partkey", base.alias("base_name"))
    apps = part.select(F.col("p_brand").alias("base_name")).distinct().withColumn("image", F.concat(F.lit("app/"), "base_name"))
    tasks = supplier.select(F.col("s_name").alias("base_name")).distinct().withColumn("image", F.concat(F.lit("task/"), "base_name"))
    return layers.lookup_chain(names, apps, tasks, "base_name").select("p_partkey", "base_name", "image")


APPS = [("m", "mobile", 8080, 0), ("www", "web", 80, 1), ("www", "web-old", 81, 2), ("shop", "shop", 9000, 3), ("hub", "hub", 8000, 4)]


@query("lookup_default", """
WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '.', 1) AS sub FROM pages)
SELECT page_id, sub AS subdomain, CASE sub WHEN 'm' THEN 'mobile' WHEN 'www' THEN 'web' WHEN 'shop' THEN 'shop' ELSE 'hub' END AS app,
       CAST(CASE sub WHEN 'm' THEN 8080 WHEN 'www' THEN 80 WHEN 'shop' THEN 9000 ELSE 8000 END AS BIGINT) AS port
FROM p""")
def lookup_default(spark, sf):
    apps = spark.createDataFrame(APPS, "subdomain string, name string, port long, seq int")
    host = F.split(F.regexp_replace("url", "^https?://", ""), "/")[0]
    requests = table(spark, sf, "pages").select("page_id", F.split(host, r"\.")[0].alias("subdomain"))
    rows = layers.lookup_default(requests, apps, "subdomain", ["port"], "hub")
    return rows.select("page_id", "subdomain", F.col("name").alias("app"), "port")


@query("dedup_keep_first", """
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey // 3 END IS NULL OR NOT EXISTS (
  SELECT 1 FROM customer o WHERE o.c_custkey // 3 = c.c_custkey // 3 AND o.c_custkey < c.c_custkey AND o.c_custkey % 50 <> 0) AS kept
FROM customer c""")
def dedup_keep_first(spark, sf):
    key = F.col("c_custkey")
    users = table(spark, sf, "customer").select("c_custkey", F.when(key % 50 != 0, F.floor(key / 3)).alias("external"))
    return identity.keep_lowest(users, "external", "c_custkey").select("c_custkey", "kept")


# ---- attributes and quotas

DEFAULTS = {"quota-max": "3", "quota-cpu": "0.4", "quota-mem": "0.5 Gb", "quota-storage": 1.25}


def _attributes(spark, sf):
    rows = d.user_groups(spark, sf).select("user", "path", F.explode("attributes").alias("key", "values"))
    return rows.select("user", "path", "key", F.col("values")[0].alias("value"))


SQL_LIVE = f"""{d.SQL_GROUPS},
live AS (SELECT g."user", max(CAST(regexp_replace(g.q, '[^0-9.]', '', 'g') AS DOUBLE)) AS value FROM groups g
  WHERE g.q IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM groups x WHERE x."user" = g."user" AND x.q IS NOT NULL AND starts_with(x.path, g.path || '/'))
  GROUP BY 1)"""


@query("attr_resolve", f"WITH {SQL_LIVE} SELECT \"user\", 'quota-max' AS \"key\", value FROM live")
def attr_resolve(spark, sf):
    return at.resolve_groups(_attributes(spark, sf))


SQL_HOOK = f"""{d.SQL_GROUPS},
num AS (SELECT "user", path, CASE WHEN q LIKE '%Gb' THEN CAST(replace(q, 'Gb', '') AS DOUBLE) * 1024
    WHEN CAST(q AS INTEGER) % 5 = 0 THEN NULL ELSE CAST(q AS DOUBLE) END AS v FROM groups WHERE q IS NOT NULL)"""


@query("attr_resolve_hook", f"""WITH {SQL_HOOK}
SELECT "user", 'quota-max' AS "key", max(v) AS value FROM num g WHERE v IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM num x WHERE x."user" = g."user" AND starts_with(x.path, g.path || '/')) GROUP BY 1""")
def attr_resolve_hook(spark, sf):
    """Values through a Python function that fails on some of them."""
    def megabytes(value):
        if value.endswith("Gb"):
            return float(value[:-2]) * 1024
        if int(value) % 5 == 0:
            raise ValueError(value)
        return float(value)

    return at.resolve_groups_with(_attributes(spark, sf), megabytes)


@query("quota_effective", f"""WITH {SQL_LIVE},
own AS (SELECT c_custkey AS "user", 'quota-max' AS "key", CAST(c_custkey % 40 AS DOUBLE) AS v FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey, 'quota-cpu', 2.5 FROM customer WHERE c_custkey % 22 = 0),
k("key", def) AS (VALUES ('quota-max', 3.0), ('quota-cpu', 0.4), ('quota-mem', 0.5), ('quota-storage', 1.25))
SELECT c_custkey AS "user", k."key", CAST(coalesce(own.v, live.value, k.def) AS DOUBLE) AS value,
       CASE WHEN own.v IS NOT NULL THEN 'user' WHEN live.value IS NOT NULL THEN 'group' ELSE 'default' END AS origin
FROM customer CROSS JOIN k LEFT JOIN own ON own."user" = c_custkey AND own."key" = k."key"
LEFT JOIN live ON live."user" = c_custkey AND k."key" = 'quota-max'""")
def quota_effective(spark, sf):
    users = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("user")), d.USERS_A_TASK)
    key = F.col("user")
    own = users.filter(key % 11 == 0).select("user", F.lit("quota-max").alias("key"), d.text(key % 40).alias("value")).unionByName(
        users.filter(key % 22 == 0).select("user", F.lit("quota-cpu").alias("key"), F.lit("2.5").alias("value"))
    )
    rows = at.effective(users, own, at.resolve_groups(_attributes(spark, sf)), DEFAULTS)
    return rows.withColumn("value", F.col("value").cast("double"))


@query("group_quotas", """
SELECT '/' || r_name || '/' || n_name AS path, 'quota-max' AS "key", CAST(n_nationkey AS VARCHAR) AS value
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
UNION ALL SELECT '/' || r_name, 'quota-max', (r_regionkey * 10) || 'Gb' FROM region
  WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)""")
def group_quotas(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.concat(F.lit("/"), "r_name")
    given = F.create_map(F.lit("quota-max"), F.array(d.text("n_nationkey")), F.lit("color"), F.array(F.lit("red")))
    own = F.when(F.col("n_nationkey") % 3 != 0, given)
    groups = nations.select(F.concat(region, F.lit("/"), "n_name").alias("path"), own.alias("attributes")).unionByName(
        nations.select("r_regionkey", region.alias("path")).distinct().select(
            "path", F.create_map(F.lit("quota-max"), F.array(F.concat(d.text(F.col("r_regionkey") * 10), F.lit("Gb")))).alias("attributes")
        )
    )
    return at.group_values(groups, DEFAULTS)


@query("quota_check", """
SELECT c_custkey AS "user", CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(q <> 0 AND coalesce(n, 0) > floor(q), false) AS rejected
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 12) * 1.5 END AS q FROM customer)
LEFT JOIN (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def quota_check(spark, sf):
    active = table(spark, sf, "events").select(F.col("user_id").alias("user"), (F.col("event_type") == "click").alias("active"))
    key = F.col("c_custkey")
    quotas = table(spark, sf, "customer").select(key.alias("user"), F.when(key % 7 != 0, (key % 12) * 1.5).alias("quota"))
    return at.over_quota(active, quotas).select("user", "n_active", "rejected")


@query("format_limits", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS VARCHAR) || 'G' END AS mem,
       CASE WHEN c_custkey % 4 = 2 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1' ELSE '2.5' END END AS cpu
FROM customer""")
def format_limits(spark, sf):
    key = F.col("c_custkey")
    step = (key % 4).cast("int")
    cpu = F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(2.5)), step + 1)
    return table(spark, sf, "customer").select(
        "c_custkey", tx.with_unit(step, "G").alias("mem"), tx.with_unit(cpu, "").alias("cpu")
    )


# ---- first of group, ids, tasks

@query("pick_default", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderpriority FROM r WHERE rn = 1""")
def pick_default(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return picks.pick_default(orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT", "o_orderkey")


@query("first_match", """
SELECT c_nationkey, c_custkey, c_name FROM customer c WHERE c_custkey = (SELECT min(c_custkey) FROM customer o WHERE o.c_nationkey = c.c_nationkey)""")
def first_match(spark, sf):
    return picks.first_match(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey")


@query("assign_ids", """
SELECT s_suppkey AS old_key, s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_nationkey, s_name) AS new_id
FROM supplier""")
def assign_ids(spark, sf):
    existing = table(spark, sf, "customer").select(F.col("c_custkey").alias("new_id"))
    new_rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("old_key"), "s_name", "s_nationkey")
    return picks.assign_ids(existing, new_rows, "new_id", ["s_nationkey", "s_name"]).select("old_key", "s_name", "new_id")


@query("apply_task", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net,
       l_quantity >= 25 AS bulk
FROM lineitem""")
def apply_task(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity"]

    def price(frame):
        out = frame[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]].copy()
        out["net"] = frame["l_extendedprice"] * (1 - frame["l_discount"])
        out["bulk"] = frame["l_quantity"] >= 25
        return out

    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, net double, bulk boolean"
    return picks.run_task(table(spark, sf, "lineitem").select(*columns), price, schema)


@query("apply_task_isolated", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_orderkey % 2003 = 5 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS net,
       CASE WHEN l_orderkey % 2003 = 5 THEN 'ValueError: order ' || l_orderkey END AS error
FROM lineitem""")
def apply_task_isolated(spark, sf):
    """A task that fails on some orders: their lines go out with the error, all others arrive."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]

    def price(frame):
        bad = frame["l_orderkey"][frame["l_orderkey"] % 2003 == 5]
        if len(bad):
            raise ValueError(f"order {bad.iloc[0]}")
        return frame[columns[:4]].assign(net=frame["l_extendedprice"] * (1 - frame["l_discount"]))

    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, net double"
    rows = table(spark, sf, "lineitem").select(*columns)
    return picks.run_task_isolated(rows, price, schema, keys=columns[:4])


@query("match_email", """
WITH src AS (SELECT printf('u%09d', c_custkey) AS ext_id, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN ''
    ELSE 'mail' || (c_custkey - CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 0 END) END AS email FROM customer),
f AS (SELECT email, min(ext_id) AS ext_id FROM src WHERE email <> '' GROUP BY 1)
SELECT c_custkey AS "user", ext_id FROM customer LEFT JOIN f ON f.email = CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'mail' || c_custkey END""")
def match_email(spark, sf):
    """Target users by their address; some addresses are shared, empty or missing."""
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    shared = F.concat(F.lit("mail"), d.text(key - F.when(key % 5 == 4, 1).otherwise(0)))
    source = customers.select(
        F.format_string("u%09d", key).alias("ext_id"),
        F.when(key % 17 == 0, F.lit(None)).when(key % 19 == 0, "").otherwise(shared).alias("email"))
    target = customers.select(key.alias("user"), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("mail"), d.text(key))).alias("email"))
    return identity.match_by_email(target, source).select("user", "ext_id")
