"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import jsontree, maps
from tidemark.functions import text as tx
from tidemark.operators import events as ev
from tidemark.operators import history, identity, layers, textset
from tidemark.plans.spread import spread
from tidemark.suite import derive as d
from tidemark.suite.registry import query, table


@query("nested_filter", """
SELECT n_name AS app, f AS filter FROM nation, (VALUES ('auto=true'), ('auto=false'), ('name'), ('port'), ('port=8003'), ('alias present')) v(f)
WHERE (f = 'auto=true' AND n_nationkey % 4 IN (0, 1)) OR (f = 'auto=false' AND n_nationkey % 4 IN (1, 2))
   OR (f = 'name' AND n_name = 'NATION_7') OR (f = 'port') OR (f = 'port=8003' AND n_nationkey = 3)
   OR (f = 'alias present' AND n_nationkey % 3 = 0)""")
def nested_filter(spark, sf):
    filters = {
        "auto=true": (["harness", "deployment", "auto"], True),
        "auto=false": (["harness", "deployment", "auto"], False),
        "name": (["name"], "NATION_7"),
        "port": (["harness", "service", "port"], True),
        "port=8003": (["harness", "service", "port"], 8003),
        "alias present": (["harness", "aliases"], True),
    }
    apps = d.app_configs(spark, sf).select("n_name", F.parse_json("config").alias("v"))
    hits = [F.when(jsontree.nested_matches(F.col("v"), p, w), F.lit(n)) for n, (p, w) in filters.items()]
    found = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("filter")
    return apps.select(F.col("n_name").alias("app"), found)


@query("path_lookup", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing,
       json_extract_string(props, '$.k') AS nested
FROM events""")
def path_lookup(spark, sf):
    nested = F.concat(F.lit('{"a":{"b":'), F.col("props"), F.lit("}}"))
    return table(spark, sf, "events").select(
        "event_id", jsontree.lookup(F.col("props"), "k").alias("k"),
        jsontree.lookup(F.col("props"), "k.x").alias("missing"),
        jsontree.lookup(nested, "a.b.k").alias("nested"),
    )


@query("ops_by_status", f"""WITH {d.SQL_OPS}
SELECT name, status FROM ops WHERE status = 'Failed'""")
def ops_by_status(spark, sf):
    return history.search(d.operations(spark, sf), "Failed", ["name", "status"])


@query("ops_flags", f"""WITH {d.SQL_OPS}
SELECT name, status IN ('Error', 'Succeeded', 'Skipped', 'Failed') AS finished,
       status IN ('Running', 'Pending') AS running, status IN ('Error', 'Failed') AS error,
       status = 'Succeeded' AS succeeded, status = 'Failed' AS failed
FROM ops""")
def ops_flags(spark, sf):
    return history.with_flags(d.operations(spark, sf)).select("name", "finished", "running", "error", "succeeded", "failed")


def _admin_events(spark, sf):
    kind = F.col("event_type")
    rtype = (
        F.when(kind.isin("signup", "error"), "USER").when(kind == "purchase", "GROUP_MEMBERSHIP")
        .when(kind == "click", "GROUP").otherwise("REALM_ROLE")
    )
    op = F.when((kind == "error") | (F.col("value") < 5), "DELETE").when(kind == "signup", "CREATE").otherwise("UPDATE")
    return table(spark, sf, "events").select(
        "event_id", rtype.alias("resource_type"), op.alias("operation_type"),
        F.concat(F.lit("users/"), d.text("user_id"), F.lit("/x")).alias("resource_path"),
    )


@query("route_events", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'sync_group' ELSE 'sync_user' END AS action,
       event_type = 'error' OR (event_type = 'signup' AND value < 5) AS is_delete, CAST(user_id AS VARCHAR) AS entity_id
FROM events WHERE event_type <> 'view'""")
def route_events(spark, sf):
    return identity.route_admin_events(_admin_events(spark, sf)).select("event_id", "action", "is_delete", "entity_id")


def _uuid(col):
    h = F.md5(col)
    return F.concat_ws("-", *[F.substring(h, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@query("lookup_id_or_name", """
WITH u AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h, 'user' || (c_custkey // 2) AS username FROM customer),
v AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id FROM u),
q AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'nobody' || c_custkey WHEN c_custkey % 2 = 0 THEN id ELSE username END AS arg FROM v)
SELECT q.c_custkey, arg, f.id AS found, CASE WHEN f.id IS NULL THEN 'not_found' ELSE 'found' END AS status
FROM q LEFT JOIN (SELECT id AS k, id FROM v UNION ALL SELECT username, min(id) FROM v GROUP BY username) f ON f.k = q.arg""")
def lookup_id_or_name(spark, sf):
    key = F.col("c_custkey")
    users = table(spark, sf, "customer").select(
        key, _uuid(d.text(key)).alias("id"), F.concat(F.lit("user"), d.text(F.floor(key / 2))).alias("username")
    )
    arg = F.when(key % 13 == 0, F.concat(F.lit("nobody"), d.text(key))).when(key % 2 == 0, F.col("id")).otherwise(F.col("username"))
    requests = users.select("c_custkey", arg.alias("arg"))
    return identity.find_users(requests, users.select("id", "username")).select("c_custkey", "arg", "found", "status")


@query("has_role", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent,
       EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AS low
FROM customer""")
def has_role(spark, sf):
    roles = identity.roles_of(d.roles(spark, sf), "user", "role").withColumnRenamed("user", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey").join(roles, "c_custkey", "left").select(
        "c_custkey", identity.has_role(F.col("roles"), "1-URGENT").alias("urgent"),
        identity.has_role(F.col("roles"), "5-LOW").alias("low"),
    )


@query("admin_search", """
SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE (c_name ILIKE '%00042%' OR n_name ILIKE '%nation_1%') AND NOT (c_mktsegment = 'MACHINERY')""")
def admin_search(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    link = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").join(nations, "c_nationkey", "left")
    hit = tx.any_contains([F.col("c_name"), F.col("n_name")], "NATION_1") | tx.any_contains([F.col("c_name")], "00042")
    return rows.filter(hit & ~tx.is_empty(link)).select("c_custkey", "c_name", "n_name")


@query("keyword_search", """
SELECT doc_id FROM documents WHERE contains(text, 'the') AND regexp_matches(source, '^src1.*$')""")
def keyword_search(spark, sf):
    return textset.keyword_search(table(spark, sf, "documents"), "text", "the", "source", "src1*").select("doc_id")


def _customer_rules():
    return {
        "name": F.col("c_name").rlike("^Customer#[0-9]{9}$"),
        "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"),
        "balance": F.col("c_acctbal") > 0,
        "short key": F.length(d.text("c_custkey")) <= 3,
    }


SQL_VALIDATE = """WITH f AS (
  SELECT c_custkey, list_filter([CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END,
    CASE WHEN NOT c_acctbal > 0 THEN 'balance' END,
    CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 3 THEN 'short key' END], lambda x: x IS NOT NULL) AS failed
  FROM customer)"""


@query("validate_records", SQL_VALIDATE + """
SELECT 'customer' AS kind, c_custkey AS id, array_to_string(failed, ',') AS failed, len(failed) = 0 AS good FROM f
UNION ALL
SELECT 'part', p_partkey, CASE WHEN p_size >= 25 THEN 'size' ELSE '' END, p_size < 25 FROM part
UNION ALL
SELECT 'page', page_id, CASE WHEN contains(url, '?') THEN 'filename,path' ELSE '' END, NOT contains(url, '?') FROM pages""")
def validate_records(spark, sf):
    def shape(df, kind, key):
        return df.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.array_join("failed", ",").alias("failed"),
            (F.size("failed") == 0).alias("good"),
        )

    customers = ev.validate(table(spark, sf, "customer"), _customer_rules())
    parts = ev.validate(table(spark, sf, "part"), {"size": F.col("p_size") < 25, "type": F.col("p_type").rlike("^[A-Z]+$")})
    place = F.regexp_replace("url", "^https?://", "")
    pages = ev.validate(table(spark, sf, "pages"), {k: ev.matches(place, k) for k in ("filename", "path")})
    return shape(customers, "customer", "c_custkey").unionByName(shape(parts, "part", "p_partkey")).unionByName(
        shape(pages, "page", "page_id")
    )


@query("validate_summary", SQL_VALIDATE + """
SELECT rule, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(failed) = 0 THEN ['ok'] ELSE failed END) AS rule FROM f) GROUP BY rule""")
def validate_summary(spark, sf):
    return ev.validation_summary(ev.validate(table(spark, sf, "customer"), _customer_rules()))


@query("rename_snake", """
SELECT c_custkey, c_name AS user_name, CASE WHEN c_custkey % 4 = 0 THEN 'snake' ELSE c_mktsegment END AS market_segment,
       CAST(c_nationkey AS VARCHAR) AS nation_key, 'market_segment,nation_key,user_name' AS keys
FROM customer""")
def rename_snake(spark, sf):
    """JSON rows with camelCase keys; some also carry the snake form, which wins."""
    quote = F.lit('"')
    both = F.when(F.col("c_custkey") % 4 == 0, '"market_segment":"snake",').otherwise("")
    body = F.concat(
        F.lit('{"userName":"'), F.col("c_name"), F.lit('",'), both, F.lit('"marketSegment":"'), F.col("c_mktsegment"),
        quote, F.lit(',"nationKey":'), d.text("c_nationkey"), F.lit("}"),
    )
    rows = table(spark, sf, "customer").select("c_custkey", F.from_json(body, "map<string,string>").alias("m"))
    named = rows.withColumn("s", maps.snake_keys(F.col("m")))
    return named.select(
        "c_custkey", maps.resolve_key(F.col("m"), "user_name").alias("user_name"),
        maps.resolve_key(F.col("m"), "market_segment").alias("market_segment"),
        F.col("s")["nation_key"].alias("nation_key"),
        F.array_join(F.sort_array(F.map_keys("s")), ",").alias("keys"),
    )


@query("rescue_fields", """
SELECT event_id, event_type AS kind, 'k' AS extra_keys, json_extract_string(props, '$.k') AS k,
       'k,kind,uid' AS out_keys
FROM events""")
def rescue_fields(spark, sf):
    body = F.concat(
        F.lit('{"kind":"'), F.col("event_type"), F.lit('","uid":"'), d.text("user_id"), F.lit('",'),
        F.expr("substring(props, 2)"),
    )
    rows = table(spark, sf, "events").select("event_id", F.from_json(body, "map<string,string>").alias("m"))
    known = ["kind", "uid"]
    split = rows.select(
        "event_id", F.map_filter("m", lambda k, _v: k.isin(*known)).alias("core"),
        maps.extra_fields(F.col("m"), known).alias("extra"),
    )
    out = split.withColumn("out", maps.with_extra(F.col("core"), F.col("extra")))
    return out.select(
        "event_id", F.col("core")["kind"].alias("kind"), F.array_join(F.map_keys("extra"), ",").alias("extra_keys"),
        F.col("out")["k"].alias("k"), F.array_join(F.sort_array(F.map_keys("out")), ",").alias("out_keys"),
    )


@query("attr_filter", f"""WITH {d.SQL_GROUPS}
SELECT "user", path, q AS quota FROM groups""")
def attr_filter(spark, sf):
    kept = maps.filter_attributes(F.col("attributes"), ["quota-max", "quota-min"])
    return d.user_groups(spark, sf).select("user", "path", F.try_element_at(kept, F.lit("quota-max")).alias("quota"))


MERGES_A_TASK = 2_500


@query("deep_merge", """
SELECT p_partkey, p_brand AS plain_brand, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS plain_size,
       CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '"' || p_type || '"' END AS plain_type,
       'x' AS plain_extra, CAST(NULL AS VARCHAR) AS keys_extra,
       '"' || p_type || '"' AS none_type,
       CASE WHEN p_partkey % 3 = 0 THEN '7' ELSE '{"a":1,"b":2}' END AS plain_box,
       CASE WHEN p_partkey % 3 = 0 THEN '7' ELSE '{"a":1}' END AS keys_box,
       CASE WHEN p_partkey % 7 = 0 THEN repeat('{"d":', 20) || '{"l":' || p_size || ',"r":1}' || repeat('}', 20) END AS plain_deep
FROM part""")
def deep_merge(spark, sf):
    key = F.col("p_partkey")
    keep = {"ignoreNullFields": "false"}
    left = F.to_json(F.struct(
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("core"),
        F.col("p_type").alias("type"), F.struct(F.lit(1).alias("a")).alias("box"),
    ), keep)

    def deep(name, value):
        """One part in seven also holds a document of more than twenty levels."""
        body = F.concat(F.lit(',"deep":' + '{"d":' * 20 + '{"' + name + '":'), value, F.lit("}" * 21))
        return F.when(key % 7 == 0, body).otherwise("")

    left = F.concat(F.substring(left, F.lit(1), F.length(left) - 1), deep("l", d.text("p_size")), F.lit("}"))
    size = F.when(key % 2 == 0, F.concat(F.lit('{"size":'), d.text(F.col("p_size") + 1), F.lit("}"))).otherwise("{}")
    kind = F.when(key % 5 == 0, ',"type":null').otherwise("")
    box = F.when(key % 3 == 0, "7").otherwise('{"b":2}')
    right = F.concat(F.lit('{"core":'), size, kind, F.lit(',"box":'), box, deep("r", F.lit("1")), F.lit(',"extra":"x"}'))
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type"), MERGES_A_TASK)
    rows = parts.select("p_partkey", F.parse_json(left).alias("l"), F.parse_json(right).alias("r"))
    left, right = F.col("l"), F.col("r")
    merged = rows.select(
        "p_partkey",
        jsontree.deep_merge(left, right).alias("plain"),
        jsontree.deep_merge(left, right, add_keys=False).alias("keys"),
        jsontree.deep_merge(left, right, merge_none=False).alias("none"),
    )

    def as_text(column, path):
        return F.variant_get(F.col(column), path, "string")

    def as_json(column, path):
        return F.to_json(F.variant_get(F.col(column), path, "variant"))

    return merged.select(
        "p_partkey", as_text("plain", "$.core.brand").alias("plain_brand"), as_text("plain", "$.core.size").alias("plain_size"),
        as_json("plain", "$.type").alias("plain_type"), as_text("plain", "$.extra").alias("plain_extra"),
        as_text("keys", "$.extra").alias("keys_extra"), as_json("none", "$.type").alias("none_type"),
        as_json("plain", "$.box").alias("plain_box"), as_json("keys", "$.box").alias("keys_box"),
        as_json("plain", "$.deep").alias("plain_deep"),
    )


@query("replace_values", """
SELECT page_id AS id, replace(url, 'example', 'sample') AS url, CAST(page_id AS VARCHAR) AS number,
       replace(url, 'example', 'sample') AS nested, 'example' AS key, sha1(replace(html, 'example', 'sample')) AS html
FROM pages
UNION ALL
SELECT event_id, replace(event_type, 'example', 'sample'), json_extract_string(props, '$.k'), event_type, 'example', sha1(event_type) FROM events""")
def replace_values(spark, sf):
    def body(name, number, html):
        nested = F.struct(F.array(F.struct(name.alias("u"))).alias("list"))
        return F.to_json(F.struct(name.alias("example"), number.cast("long").alias("n"), nested.alias("in"), html.alias("html")))

    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), body(F.col("url"), F.col("page_id"), F.col("html")).alias("j"))
    kinds = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        body(F.col("event_type"), F.get_json_object("props", "$.k"), F.col("event_type")).alias("j"),
    )
    rows = pages.unionByName(kinds).select("id", F.parse_json("j").alias("v"))
    out = rows.select("id", jsontree.replace_strings(F.col("v"), "example", "sample").alias("v"))

    def get(path):
        return F.variant_get(F.col("v"), path, "string")

    return out.select(
        "id", get("$.example").alias("url"), get("$.n").alias("number"), get("$.in.list[0].u").alias("nested"),
        F.when(F.array_contains(F.json_object_keys(F.to_json("v")), "example"), "example").alias("key"),
        F.sha1(get("$.html")).alias("html"),
    )


RULES = [
    {"keyword": "the", "to_be_replaced": [("the", "THE"), ("THE ", "the-")]},
    {"keyword": "en", "patterns": ["src1*", "src?"], "to_be_replaced": [("en", "EN")]},
    {"keyword": "no such words", "to_be_replaced": [("a", "b")]},
]


@query("rule_replace", """
WITH a AS (SELECT doc_id, source, CASE WHEN contains(text, 'the') THEN replace(replace(text, 'the', 'THE'), 'THE ', 'the-') ELSE text END AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN contains(t, 'en') AND regexp_matches(source, '^(src1.*|src.)$') THEN replace(t, 'en', 'EN') ELSE t END AS t FROM a)
SELECT doc_id, length(t) AS n, sha1(t) AS body_hash FROM b""")
def rule_replace(spark, sf):
    docs = table(spark, sf, "documents")
    out = docs.select("doc_id", textset.bulk_replace(F.col("text"), F.col("source"), RULES).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("n"), F.sha1("t").alias("body_hash"))


@query("parse_quantity", """
SELECT c_custkey, TRY_CAST(regexp_replace(c_acctbal || 'Gb', '[^0-9.]', '', 'g') AS DOUBLE) AS with_unit,
       round(abs(c_acctbal), 2) AS plain, CAST(NULL AS DOUBLE) AS broken, CAST(regexp_replace(c_name, '[^0-9.]', '', 'g') AS DOUBLE) AS of_name
FROM customer""")
def parse_quantity(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", tx.to_number(F.concat(d.text("c_acctbal"), F.lit("Gb"))).alias("with_unit"),
        F.round(tx.to_number(F.col("c_acctbal")), 2).alias("plain"),
        tx.to_number(F.concat(F.lit("1.2."), d.text("c_acctbal"))).alias("broken"),
        tx.to_number(F.col("c_name")).alias("of_name"),
    )


@query("attr_upsert", """
SELECT c_custkey, c_mktsegment AS after_put, CASE WHEN c_custkey % 3 = 0 THEN 'level,segment' ELSE 'segment' END AS keys_after_put,
       c_custkey % 3 = 0 AS was_there, 'segment' AS keys_after_remove
FROM customer""")
def attr_upsert(spark, sf):
    key = F.col("c_custkey")
    attrs = F.when(key % 3 == 0, F.create_map(F.lit("segment"), F.lit("old"), F.lit("level"), F.lit("1"))).otherwise(
        F.create_map(F.lit("segment"), F.lit("old"))
    )
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", attrs.alias("m"))
    out = rows.withColumn("p", maps.put(F.col("m"), "segment", F.col("c_mktsegment"))).withColumn(
        "r", maps.remove(F.col("m"), "level")
    )
    return out.select(
        "c_custkey", F.col("p")["segment"].alias("after_put"),
        F.array_join(F.sort_array(F.map_keys("p")), ",").alias("keys_after_put"),
        F.map_contains_key("m", "level").alias("was_there"),
        F.array_join(F.sort_array(F.map_keys("r")), ",").alias("keys_after_remove"),
    )


@query("flatten_vars", """
SELECT 'CH_' || n_name || '_NAME' AS name, lower(n_name) AS value FROM nation
UNION ALL SELECT 'CH_' || n_name || '_PORT', CAST(n_nationkey + 8000 AS VARCHAR) FROM nation
UNION ALL SELECT 'CH_' || n_name || '_SUBDOMAIN', CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE replace(lower(n_name), '_', '-') END FROM nation""")
def flatten_vars(spark, sf):
    harness = F.from_json(F.get_json_object("config", "$.harness"), "map<string,string>")
    prefix = F.concat(F.lit("CH_"), F.replace(F.col("n_name"), F.lit("_"), F.lit("-")))
    rows = d.app_configs(spark, sf).select(F.explode(maps.variables(prefix, harness)).alias("v"))
    return rows.select("v.name", "v.value")


@query("normalise_names", """
SELECT 'customer' AS kind, c_custkey AS id, lower(replace('Task ' || c_name, ' ', '-')) AS task,
       lower(replace(replace('/' || c_mktsegment || '/' || c_name, '/', ''), '_', '')) AS of_path,
       replace('mod-' || c_custkey || '-x', '-', '_') AS module,
       trim(regexp_replace(lower('-' || c_name || '_v1-'), '[^a-z0-9-]', '', 'g'), '-') AS image,
       'run-' || c_custkey AS family
FROM customer
UNION ALL
SELECT 'part', p_partkey, lower(replace('Task ' || p_name, ' ', '-')), lower(replace(replace('/' || p_type || '/' || p_name, '/', ''), '_', '')),
       replace('mod-' || p_partkey || '-x', '-', '_'), trim(regexp_replace(lower('-' || p_name || '_v1-'), '[^a-z0-9-]', '', 'g'), '-'), 'run-' || p_partkey
FROM part""")
def normalise_names(spark, sf):
    def names(df, kind, key, name, folder):
        key, name, folder = F.col(key), F.col(name), F.col(folder)
        return df.select(
            F.lit(kind).alias("kind"), key.alias("id"),
            tx.task_name(F.concat(F.lit("Task "), name)).alias("task"),
            tx.name_of_path(F.concat(F.lit("/"), folder, F.lit("/"), name)).alias("of_path"),
            tx.module_name(F.concat(F.lit("mod-"), d.text(key), F.lit("-x"))).alias("module"),
            tx.image_name(F.concat(F.lit("-"), name, F.lit("_v1-"))).alias("image"),
            tx.run_family(F.concat(F.lit("run-"), d.text(key), F.lit("-abc12"))).alias("family"),
        )

    return names(table(spark, sf, "customer"), "customer", "c_custkey", "c_name", "c_mktsegment").unionByName(
        names(table(spark, sf, "part"), "part", "p_partkey", "p_name", "p_type")
    )


SQL_REFS = """WITH r AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS ref FROM pages),
s AS (SELECT page_id, ref, split_part(ref, ':', 1) AS front,
             CASE WHEN contains(ref, ':') THEN split_part(ref, ':', 2) ELSE 'latest' END AS tag FROM r)"""


@query("parse_refs", SQL_REFS + """
SELECT page_id, tag, CASE WHEN contains(split_part(front, '/', 1), '.') THEN split_part(front, '/', 1) ELSE 'docker.io' END AS registry,
       CASE WHEN contains(split_part(front, '/', 1), '.') THEN CASE WHEN contains(front, '/') THEN regexp_replace(front, '^[^/]*/', '') ELSE '' END ELSE front END AS name
FROM s""")
def parse_refs(spark, sf):
    ref = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").withColumn("p", tx.reference_parts(ref)).select("page_id", "p.tag", "p.registry", "p.name")


@query("path_id", """
SELECT page_id, CASE WHEN contains(p, '/') THEN split_part(p, '/', 2) END AS id
FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def path_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.path_id(F.regexp_replace("url", "^https?://", "")).alias("id"))


@query("hosts", """
WITH s AS (SELECT replace(lower(n_name), '_', '-') AS subdomain FROM nation WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'www' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
SELECT subdomain, subdomain || '.example.org' AS host FROM s""")
def hosts(spark, sf):
    apps = d.app_configs(spark, sf)
    aliases = F.from_json(F.get_json_object("config", "$.harness.aliases"), "array<string>")
    return layers.host_names(apps, jsontree.lookup(F.col("config"), "harness.subdomain"), aliases, "example.org")
