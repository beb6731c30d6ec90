"""Operation history, retention, sessions, layers, graphs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import graph, history, layers, retention, textset
from tidemark.plans.numbering import number_rows
from tidemark.suite import derive as d
from tidemark.suite.registry import query, table


@query("ops_page", f"""WITH {d.SQL_OPS},
n AS (SELECT *, row_number() OVER (ORDER BY create_time, name) AS rn FROM ops WHERE status = 'Succeeded')
SELECT CAST((rn - 1) // 10 + 1 AS BIGINT) AS page, name, status, {d.sql_stamp('create_time')} AS create_time FROM n WHERE rn <= 30""")
def ops_page(spark, sf):
    """Three pages, each found with the token of the one before."""
    ops = d.operations(spark, sf).select("name", "status", "create_time")
    out, token = None, None
    for number in (1, 2, 3):
        rows, token = history.page(ops, "Succeeded", 10, token)
        rows = rows.select(F.lit(number).cast("long").alias("page"), "name", "status", d.stamp("create_time").alias("create_time"))
        out = rows if out is None else out.unionByName(rows)
        if token is None:
            break
    return out


@query("concat_logs", """
SELECT conv_id, turn // 10000 AS part, length(string_agg(text, chr(10) ORDER BY turn)) AS n, sha1(string_agg(text, chr(10) ORDER BY turn)) AS log_hash
FROM conversations GROUP BY 1, 2""")
def concat_logs(spark, sf):
    logs = history.concat_logs(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return logs.select("conv_id", "part", F.length("log").cast("long").alias("n"), F.sha1("log").alias("log_hash"))


@query("duplicate_names", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1""")
def duplicate_names(spark, sf):
    tasks = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"
    )
    return history.duplicate_names(tasks, "l_orderkey", "l_linenumber")


@query("leaf_nodes", f"""WITH {d.SQL_EDGES}
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)""")
def leaf_nodes(spark, sf):
    links = d.part_edges(spark, sf).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return history.leaf_nodes(d.part_nodes(spark, sf), links)


SQL_FIRST = f"""WITH {d.SQL_CHANGES}
SELECT op, status, {d.sql_stamp('ts')} AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts) AS rn FROM changes
  WHERE status IN ('Error', 'Succeeded', 'Skipped', 'Failed')) WHERE rn = 1"""


@query("first_terminal", SQL_FIRST)
def first_terminal(spark, sf):
    return history.first_terminal(d.status_changes(spark, sf)).select("op", "status", d.stamp("ts").alias("ts"))


@query("ttl_expired", f"""WITH {d.SQL_OPS},
t AS (SELECT *, CASE status WHEN 'Succeeded' THEN 1200 WHEN 'Failed' THEN 7200 WHEN 'Error' THEN 7200 WHEN 'Skipped' THEN 3600 END AS ttl FROM ops)
SELECT name, status, CAST(ttl AS BIGINT) AS ttl FROM t
WHERE end_time + ttl * INTERVAL 1 SECOND < CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-06-01 00:45:00' ELSE create_time + INTERVAL 90 MINUTE END""")
def ttl_expired(spark, sf):
    asof = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1998-06-01 00:45:00").cast("timestamp_ntz")).otherwise(
        F.col("create_time") + F.make_dt_interval(mins=F.lit(90))
    )
    return history.expired(d.operations(spark, sf), asof).select("name", "status", F.col("ttl").cast("long").alias("ttl"))


# ---- snapshots and sessions

SQL_TIERS = """WITH snaps AS (
  SELECT DISTINCT 'events' AS kind, ts, TIMESTAMP '2024-01-31' AS seen_at FROM events
  UNION ALL SELECT DISTINCT 'orders', o_orderdate, TIMESTAMP '2001-08-01' FROM orders),
tiers AS (
  SELECT kind, seen_at, 'daily' AS tier, strftime(ts, '%Y-%m-%d-%H%M%S.%f') AS bucket, ts FROM snaps
  UNION ALL SELECT kind, seen_at, 'weekly', strftime(ts, '%G-%V'), max(ts) FROM snaps GROUP BY ALL
  UNION ALL SELECT kind, seen_at, 'monthly', strftime(ts, '%Y-%m'), max(ts) FROM snaps GROUP BY ALL),
aged AS (SELECT *, CAST(floor(epoch_us(seen_at) / 86400000000.0 - epoch_us(ts) / 86400000000.0) AS BIGINT) AS age_days FROM tiers)
SELECT kind, tier, bucket, """ + d.sql_stamp("ts") + """ AS ts, age_days FROM aged
WHERE age_days <= CASE tier WHEN 'daily' THEN 7 WHEN 'weekly' THEN 29 ELSE 187 END"""


def _retention(spark, sf):
    snaps = {"events": ("ts", "2024-01-31"), "orders": ("o_orderdate", "2001-08-01")}
    out = None
    for name, (column, asof) in snaps.items():
        rows = table(spark, sf, name).select(F.lit(name).alias("kind"), F.col(column).alias("ts"))
        rows = retention.retention(rows, F.lit(asof).cast("timestamp"), "kind")
        out = rows if out is None else out.unionByName(rows)
    return out.select("kind", "tier", "bucket", d.stamp("ts").alias("ts"), "age_days", "keep")


@query("retention_keep", SQL_TIERS)
def retention_keep(spark, sf):
    return _retention(spark, sf).filter("keep").drop("keep")


@query("retention_expired", SQL_TIERS.replace("WHERE age_days <=", "WHERE age_days >"))
def retention_expired(spark, sf):
    return _retention(spark, sf).filter("NOT keep").drop("keep")


def _activity(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("user"), "ts")


@query("idle_sessions", f"""
SELECT user_id AS "user", {d.sql_stamp('max(ts)')} AS last_ts,
       epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(date_trunc('second', max(ts))) > 3600
       OR epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(date_trunc('second', min(ts))) > 2556000 AS idle
FROM events GROUP BY 1""")
def idle_sessions(spark, sf):
    rows = retention.idle(_activity(spark, sf), F.lit("2024-01-30 23:00:00").cast("timestamp"), max_age=2_556_000)
    return rows.select("user", d.stamp("last_ts").alias("last_ts"), "idle")


SESSION_GAP = 21_600
SQL_SESSIONS = f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {SESSION_GAP} SECOND THEN 0 ELSE 1 END AS st
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
sess AS (SELECT user_id AS "user", min(ts) AS lo, max(ts) AS hi, count(*) AS n_events FROM n GROUP BY user_id, s)
SELECT "user", {d.sql_stamp('lo')} AS start_ts, {d.sql_stamp('hi')} AS end_ts, n_events FROM sess"""


@query("session_stats", SQL_SESSIONS)
def session_stats(spark, sf):
    rows = retention.sessions(_activity(spark, sf), SESSION_GAP)
    return rows.select("user", d.stamp("start_ts").alias("start_ts"), d.stamp("end_ts").alias("end_ts"), "n_events")


# ---- layers

@query("layer_overlay", """
SELECT p_partkey, 'brand' AS path, p_brand AS value, 0 AS rank FROM part
UNION ALL SELECT p_partkey, 'type', p_type, 0 FROM part
UNION ALL SELECT p_partkey, 'size', CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END,
  CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END FROM part
UNION ALL SELECT p_partkey, 'extra', 'x', 2 FROM part WHERE p_partkey % 5 = 0""")
def layer_overlay(spark, sf):
    key = F.col("p_partkey")

    def setting(path, value, rank):
        return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(rank).alias("rank"))

    none = F.lit(None).cast("string")
    base = F.array(setting("brand", F.col("p_brand"), 0), setting("type", F.col("p_type"), 0), setting("size", F.col("p_size"), 0))
    empty = F.filter(base, lambda _x: F.lit(False))
    second = F.when(key % 2 == 0, F.array(setting("size", F.col("p_size") + 1, 1))).otherwise(empty)
    third = F.when(key % 5 == 0, F.array(setting("size", none, 2), setting("extra", F.lit("x"), 2))).otherwise(empty)
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.concat(base, second, third)).alias("s"))
    return layers.overlay(rows.select("p_partkey", "s.*"), "p_partkey")


# ---- graphs

def _seeds(spark, sf):
    return table(spark, sf, "part").filter("p_size = 50").select(F.col("p_partkey").alias("node"))


@query("closure_apps", f"""WITH RECURSIVE {d.SQL_EDGES},
c(node) AS (SELECT p_partkey FROM part WHERE p_size = 50
  UNION SELECT dst FROM c JOIN edges ON src = node WHERE kind IN ('hard', 'soft'))
SELECT node FROM c""")
def closure_apps(spark, sf):
    edges = d.part_edges(spark, sf).filter(F.col("kind").isin("hard", "soft"))
    return graph.closure(_seeds(spark, sf), edges).select("node")


@query("closure_builds", f"""WITH RECURSIVE {d.SQL_EDGES},
c(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM c JOIN edges ON src = node)
SELECT node FROM c""")
def closure_builds(spark, sf):
    return graph.closure(_seeds(spark, sf), d.part_edges(spark, sf)).select("node")


@query("include_exclude", f"""WITH RECURSIVE {d.SQL_EDGES},
a(node) AS (SELECT p_partkey FROM part WHERE p_size = 50
  UNION SELECT dst FROM a JOIN edges ON src = node WHERE kind IN ('hard', 'soft')),
b(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM b JOIN edges ON src = node)
SELECT node, CASE WHEN node IN (SELECT node FROM a) THEN 'app' ELSE 'build_only' END AS label
FROM b WHERE node IN (SELECT p_partkey FROM part) AND node NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')""")
def include_exclude(spark, sf):
    excluded = table(spark, sf, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node"))
    return graph.included(_seeds(spark, sf), d.part_edges(spark, sf), excluded, d.part_nodes(spark, sf))


@query("include_images", """WITH RECURSIVE
apps AS (SELECT 'p' || p_partkey AS node, p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN 'img' || p_partkey END AS image FROM part),
images AS (
  SELECT node AS app, node || '-t' AS name, 'task' || k AS image FROM apps WHERE k % 4 < 2
  UNION ALL SELECT node, node || '-u', 'util' || k FROM apps WHERE k % 4 = 1),
edges AS (
  SELECT node AS src, 'p' || (k // 2) AS dst, k % 3 <> 2 AS runs FROM apps WHERE k > 0
  UNION ALL SELECT node, 'p' || (k // 3) || '-t', false FROM apps WHERE k % 5 = 0
  UNION ALL SELECT node, 'none-' || k, false FROM apps WHERE k % 31 = 0),
gone AS (SELECT node FROM apps JOIN part ON p_partkey = k WHERE p_brand = 'Brand#7' UNION SELECT name FROM images WHERE image LIKE '%7'),
a(node) AS (SELECT 'p' || p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM a JOIN edges ON src = node WHERE runs),
b(node) AS (SELECT 'p' || p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM b JOIN edges ON src = node),
f AS (SELECT node FROM a WHERE node IN (SELECT node FROM apps) AND node NOT IN (SELECT node FROM gone)),
o AS (SELECT node FROM b WHERE node IN (SELECT node FROM apps) AND node NOT IN (SELECT node FROM f)
  UNION SELECT split_part(node, '-', 1) FROM b WHERE node NOT IN (SELECT node FROM apps) AND contains(node, '-')),
r AS (
  SELECT name, app, image FROM images WHERE app IN (SELECT node FROM f)
  UNION SELECT apps.node, apps.node, apps.image FROM apps WHERE apps.image IS NOT NULL AND apps.node IN (SELECT node FROM b) AND apps.node NOT IN (SELECT node FROM f)
  UNION SELECT name, app, image FROM images WHERE app IN (SELECT node FROM o) AND name IN (SELECT node FROM b))
SELECT name, app, image FROM r WHERE name NOT IN (SELECT node FROM gone)""")
def include_images(spark, sf):
    """Parts as applications with images inside them; some are only needed for a build."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    name = F.concat(F.lit("p"), d.text(key))

    def to(target, given, runs):
        return F.when(given, F.struct(target.alias("dst"), F.lit(runs).alias("kind")) if isinstance(runs, str) else F.struct(target.alias("dst"), runs.alias("kind")))

    inside = F.filter(F.array(
        F.when(key % 4 < 2, F.struct(F.concat(name, F.lit("-t")).alias("name"), F.concat(F.lit("task"), d.text(key)).alias("image"))),
        F.when(key % 4 == 1, F.struct(F.concat(name, F.lit("-u")).alias("name"), F.concat(F.lit("util"), d.text(key)).alias("image")))),
        lambda i: i.isNotNull())
    links = F.filter(F.array(
        to(F.concat(F.lit("p"), d.text(F.floor(key / 2))), key > 0, F.when(key % 3 == 2, "build").otherwise("hard")),
        to(F.concat(F.lit("p"), d.text(F.floor(key / 3)), F.lit("-t")), key % 5 == 0, "build"),
        to(F.concat(F.lit("none-"), d.text(key)), key % 31 == 0, "build")), lambda e: e.isNotNull())
    apps = part.select(name.alias("node"), F.when(key % 3 != 0, F.concat(F.lit("img"), d.text(key))).alias("image"))
    images = part.select(name.alias("app"), F.explode(inside).alias("i")).select("app", "i.*")
    edges = part.select(name.alias("src"), F.explode(links).alias("e")).select("src", "e.*")
    excluded = part.filter("p_brand = 'Brand#7'").select(name.alias("node")).union(images.filter("image like '%7'").select("name"))
    seeds = part.filter("p_size = 50").select(name.alias("node"))
    return graph.included_images(seeds, edges, excluded, apps, images)


@query("dep_levels", f"""WITH RECURSIVE
l(node, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT p_partkey, level + 1 FROM l JOIN part ON p_partkey // 2 = node AND p_partkey > 0)
SELECT node, CAST(level AS BIGINT) AS level, 'placed' AS status FROM l""")
def dep_levels(spark, sf):
    rows = graph.levels(d.part_nodes(spark, sf), d.part_edges(spark, sf))
    return rows.select("node", F.col("level").cast("long").alias("level"), "status")


@query("ref_integrity", f"""WITH {d.SQL_EDGES}
SELECT src, dst, kind, CASE WHEN kind = 'soft' THEN 'warning' ELSE 'error' END AS severity FROM edges
WHERE dst NOT IN (SELECT p_partkey FROM part) AND NOT (kind = 'build' AND dst IN (SELECT -s_suppkey FROM supplier))""")
def ref_integrity(spark, sf):
    images = table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("node"))
    return graph.broken_references(d.part_edges(spark, sf), d.part_nodes(spark, sf), images)


@query("mark_existing", """
WITH r AS (
  SELECT 'app' AS kind, 'reg.io/' || p_brand || ':' || p_size AS ref, 'reg.io' AS g, p_brand AS n, CAST(p_size AS VARCHAR) AS t FROM part
  UNION SELECT 'task', p_brand, 'docker.io', p_brand, 'latest' FROM part
  UNION SELECT 'test', 'test/' || l_returnflag || ':' || l_linenumber, 'docker.io', 'test/' || l_returnflag, CAST(l_linenumber AS VARCHAR) FROM lineitem),
have AS (SELECT DISTINCT 'reg.io' AS g, p_brand AS n, CAST(p_size AS VARCHAR) AS t FROM part WHERE p_retailprice > 1000
  UNION SELECT 'docker.io', 'test/' || l_returnflag, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A')
SELECT kind, ref, CASE WHEN (g, n, t) IN (SELECT (g, n, t) FROM have) THEN '_EXISTS' ELSE '_NEW' END AS mark FROM r""")
def mark_existing(spark, sf):
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")

    def refs(df, kind, ref):
        return df.select(F.lit(kind).alias("kind"), ref.alias("ref"))

    app = F.concat(F.lit("reg.io/"), "p_brand", F.lit(":"), d.text("p_size"))
    test = F.concat(F.lit("test/"), "l_returnflag", F.lit(":"), d.text("l_linenumber"))
    all_refs = refs(part, "app", app).unionByName(refs(part, "task", F.col("p_brand"))).unionByName(refs(lines, "test", test)).distinct()
    have = refs(part.filter("p_retailprice > 1000"), "", app).unionByName(refs(lines.filter("l_returnflag = 'A'"), "", test)).distinct()

    def parsed(df):
        return df.withColumn("p", tx.reference_parts(F.col("ref"))).select("kind", "ref", "p.*")

    return graph.mark_existing(parsed(all_refs), parsed(have)).select("kind", "ref", "mark")


def _sql_tree(rows):
    return f"""l AS (SELECT g, substr(sha1(p), 1, 5) AS k, sha1(string_agg(p || ':' || sha1(c), chr(10) ORDER BY p || ':' || sha1(c))) AS h FROM ({rows}) GROUP BY 1, 2),
b AS (SELECT g, substr(k, 1, 2) AS k, sha1(string_agg(k || ':' || h, chr(10) ORDER BY k)) AS h FROM l GROUP BY 1, 2),
tree AS (SELECT g, sha1(string_agg(k || ':' || h, chr(10) ORDER BY k)) AS fingerprint FROM b GROUP BY 1)"""


IGNORE = ["/de/", "[e-f]*/*7", "!en/*17", "**/1?"]


@query("fingerprint", "WITH " + _sql_tree("""SELECT source AS g, lang || '/' || doc_id AS p, text AS c FROM documents
    WHERE NOT (lang = 'de' OR length(doc_id::VARCHAR) = 2 AND doc_id::VARCHAR LIKE '1_' AND NOT false
      OR regexp_matches(lang, '^[e-f]') AND doc_id::VARCHAR LIKE '%7' AND NOT (lang = 'en' AND doc_id::VARCHAR LIKE '%17'))""")
       + " SELECT g AS source, fingerprint FROM tree")
def fingerprint(spark, sf):
    """Sources as directories, with an ignore list of four patterns."""
    docs = table(spark, sf, "documents").select("source", F.concat_ws("/", "lang", d.text("doc_id")).alias("path"), "text")
    return graph.fingerprint(docs, "source", "path", "text", IGNORE)


@query("fingerprint_wide", """WITH t AS (
  SELECT source, sha1(sha1(text)) AS tag, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, row_number() OVER (ORDER BY doc_id) - 1 AS every FROM documents),
n AS (SELECT source AS node, pos, tag FROM t UNION ALL SELECT 'all', every, tag FROM t),
c AS (SELECT node, pos // 16 AS chunk, string_agg(tag, '' ORDER BY pos) AS s FROM n GROUP BY 1, 2),
j AS (SELECT node, CASE WHEN count(*) = 1 THEN min(s) ELSE string_agg(sha1(s), '' ORDER BY chunk) END AS s FROM c GROUP BY 1)
SELECT node, sha1(node || s) AS tag FROM j""")
def fingerprint_wide(spark, sf):
    """Each source depends on all its documents, and one node on every document there is."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("own"))
    leaf = F.concat(F.lit("doc"), d.text("doc_id"))
    docs = number_rows(docs.withColumn("node", leaf), ["source", "doc_id"], "n", 0)
    first = docs.groupBy("source").agg(F.min("n").alias("first"))
    edges = docs.join(first, "source").select(F.col("source").alias("src"), F.col("node").alias("dst"), (F.col("n") - F.col("first")).alias("pos"))
    every = number_rows(docs.select("doc_id", "node"), ["doc_id"], "pos", 0)
    edges = edges.unionByName(every.select(F.lit("all").alias("src"), F.col("node").alias("dst"), "pos"))
    nodes = docs.select("node", "own").unionByName(edges.select(F.col("src").alias("node"), F.col("src").alias("own")).distinct())
    return graph.chained_tags(nodes, edges, chunk=16).filter(~F.col("node").startswith("doc")).select("node", "tag")


@query("fingerprint_chain", "WITH RECURSIVE " + _sql_tree("SELECT source AS g, CAST(doc_id AS VARCHAR) AS p, text AS c FROM documents")
       + """, own AS (SELECT CAST(substr(g, 4) AS BIGINT) AS i, fingerprint AS f FROM tree),
t(i, tag) AS (SELECT i, sha1(f) FROM own WHERE i = 0
  UNION ALL SELECT own.i, sha1(f || t.tag) FROM t JOIN own ON own.i // 2 = t.i AND own.i > 0)
SELECT 'src' || i AS source, tag FROM t""")
def fingerprint_chain(spark, sf):
    """Each source depends on the source with half its number and on one that does not exist."""
    own = graph.fingerprint(table(spark, sf, "documents"), "source", "doc_id", "text")
    nodes = own.select(F.col("source").alias("node"), F.col("fingerprint").alias("own"))
    number = F.substring("node", 4, 9).cast("int")
    deps = F.array(F.concat(F.lit("src"), d.text(F.floor(number / 2))), F.lit("unknown"))
    edges = nodes.filter(number > 0).select(F.col("node").alias("src"), F.posexplode(deps).alias("pos", "dst"))
    return graph.chained_tags(nodes, edges).select(F.col("node").alias("source"), "tag")


# ---- texts

@query("dedup_keep_best", """
WITH r AS (SELECT user_id || '/' || event_type[1] AS name, event_id, event_type, row_number() OVER (
    PARTITION BY user_id || '/' || event_type[1] ORDER BY CASE WHEN event_type = 'error' OR value < 20 THEN 1 ELSE 0 END, event_id) AS rn
  FROM events WHERE regexp_matches(event_type, '^[a-p]'))
SELECT name, event_id, event_type FROM r WHERE rn = 1""")
def dedup_keep_best(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(d.text("user_id"), F.lit("/"), F.substring("event_type", 1, 1)).alias("name"), "event_id", "event_type", "value"
    )
    skipped = (F.col("event_type") == "error") | (F.col("value") < 20)
    best = textset.keep_best(rows, "name", "event_id", skipped, pattern="^[0-9]+/[a-p]")
    return best.select("name", "event_id", "event_type")


@query("line_dedup", """
WITH t AS (SELECT doc_id, str_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM t)
SELECT doc_id, pos, sha1(line) AS line_hash FROM x
WHERE doc_id = (SELECT min(doc_id) FROM x o WHERE o.line = x.line)""")
def line_dedup(spark, sf):
    rows = textset.new_lines(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha1("line").alias("line_hash"))


@query("leading_run", """
SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (
  SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn <= c.turn AND o.role = 'assistant')""")
def leading_run(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return textset.leading_run(rows, "conv_id", "turn", F.col("role") != "assistant")


@query("argument_names", """
WITH c AS (SELECT p_partkey, p_partkey % 4 AS n, upper(replace(p_name, ' ', '_')) AS w FROM part)
SELECT p_partkey, i AS pos, lower(replace(w, '_', '-')) || '-' || i AS name FROM c, range(4) r(i) WHERE i < n""")
def argument_names(spark, sf):
    """Build files with 0 to 3 leading arguments, then another line and one more argument."""
    word = F.upper(F.translate("p_name", " ", "_"))
    count = (F.col("p_partkey") % 4).cast("int")
    some = F.slice(F.array(*[F.concat(F.lit("ARG "), word, F.lit(f"_{i}")) for i in range(3)]), F.lit(1), count)
    body = F.array_join(F.concat(some, F.array(F.lit("ARG TAG=1"), F.lit("FROM base"), F.lit("ARG LATE"))), "\n")
    rows = textset.argument_names(table(spark, sf, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")
    return rows.withColumn("pos", F.col("pos").cast("long"))
