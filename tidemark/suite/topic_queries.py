"""Sources, sinks and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.jsontree import compact_json
from tidemark.operators import events as ev
from tidemark.operators import history, notify
from tidemark.session import cut_lineage, scratch
from tidemark.sources import files, store, topics
from tidemark.suite import derive as d
from tidemark.suite.registry import query, table

def _written_topic(spark, sf):
    path = scratch(spark, "topic")
    topics.write_topic(d.cdc_topic(spark, sf), path)
    return path


@query("topic_read", f"""WITH {d.SQL_CDC}
SELECT "offset", user_id % 4 AS "partition", app || '.cdc.' || message_type AS topic, uid AS "key",
       CASE WHEN "offset" % 83 = 0 THEN NULL ELSE round(value, 2) END AS value
FROM cdc""")
def topic_read(spark, sf):
    rows = topics.read_topic(spark, _written_topic(spark, sf))
    value = F.round(F.get_json_object("value", "$.resource.value").cast("double"), 2)
    whole = F.col("offset") % 83 != 0
    return rows.select(
        "offset", F.col("partition").cast("long").alias("partition"), "topic", "key", F.when(whole, value).alias("value")
    )


@query("topic_write_roundtrip", f"""WITH {d.SQL_CDC}
SELECT app || '.cdc.' || message_type AS topic, count(*) AS n, min("offset") AS first_offset,
       max("offset") AS last_offset, count(DISTINCT uid) AS n_keys
FROM cdc GROUP BY 1""")
def topic_write_roundtrip(spark, sf):
    rows = topics.read_topic(spark, _written_topic(spark, sf))
    return rows.groupBy("topic").agg(
        F.count("*").alias("n"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"), F.countDistinct("key").alias("n_keys"),
    )


@query("topic_routing", f"""WITH {d.SQL_CDC}
SELECT app || '.cdc.' || message_type AS topic, operation, count(*) AS n FROM cdc GROUP BY 1, 2""")
def topic_routing(spark, sf):
    rows = d.cdc(spark, sf)
    topic = topics.topic_id(F.col("app"), F.lit("cdc"), F.col("message_type"))
    return rows.groupBy(topic.alias("topic"), "operation").agg(F.count("*").alias("n"))


SQL_PARSED = f"""WITH {d.SQL_GOOD}
SELECT "offset", app || '.cdc.' || message_type AS topic, message_type, operation, uid, app AS app_name,
       message_type || ' - ' || uid AS description, round(value, 2) AS value,
       json_extract_string(props, '$.k') AS k
FROM good"""


def parsed_columns(parsed):
    return parsed.select(
        "offset", "topic", "message_type", "operation", "uid", "meta.app_name", "meta.description",
        F.round(F.get_json_object("resource", "$.value").cast("double"), 2).alias("value"),
        F.get_json_object(F.get_json_object("resource", "$.props"), "$.k").alias("k"),
    )


@query("cdc_parse", SQL_PARSED)
def cdc_parse(spark, sf):
    return parsed_columns(topics.good_events(d.cdc_topic(spark, sf)))


@query("cdc_quarantine", f"""WITH {d.SQL_CDC}
SELECT "offset", CASE WHEN "offset" % 83 = 0 THEN 'not_json' WHEN "offset" % 97 = 0 THEN 'no_operation'
       ELSE 'bad_operation' END AS reason
FROM cdc WHERE "offset" % 83 = 0 OR "offset" % 97 = 0 OR "offset" % 89 = 0""")
def cdc_quarantine(spark, sf):
    return topics.quarantine(d.cdc_topic(spark, sf)).select("offset", "reason")


@query("cdc_envelope", """
SELECT o_orderkey AS uid, 'orders - ' || o_orderkey AS description, 'shop' AS app_name,
       CASE o_orderstatus WHEN 'O' THEN 'create' WHEN 'P' THEN 'update' ELSE 'other' END AS operation,
       o_orderpriority AS priority, round(o_totalprice, 2) AS total, CAST(o_custkey AS VARCHAR) AS user_id,
       'save_order' AS func, o_orderstatus AS arg,
       CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS kwarg
FROM orders""")
def cdc_envelope(spark, sf):
    state = F.col("o_orderstatus")
    operation = F.when(state == "O", "create").when(state == "P", "update").otherwise("other")
    sent = ev.envelope(
        table(spark, sf, "orders"), F.lit("shop"), F.lit("orders"), operation, F.col("o_orderkey"),
        ["o_orderkey", "o_orderpriority", "o_totalprice"],
        user=F.struct(d.text("o_custkey").alias("id")), func="save_order", args=[state],
        kwargs={"notify": F.col("o_orderkey") % 2 == 0},
    )
    schema = (
        "uid bigint, operation string, meta struct<app_name:string,description:string,func:string,"
        "args:array<string>,kwargs:array<map<string,string>>,user:struct<id:string>>, resource struct<o_orderpriority:string,o_totalprice:double>"
    )
    v = sent.select(F.from_json("value", schema).alias("v"))
    return v.select(
        "v.uid", "v.operation", "v.meta.app_name", "v.meta.description", "v.meta.func",
        F.col("v.meta.args")[0].alias("arg"), F.col("v.meta.kwargs")[0]["notify"].alias("kwarg"), F.col("v.meta.user.id").alias("user_id"),
        F.col("v.resource.o_orderpriority").alias("priority"),
        F.round("v.resource.o_totalprice", 2).alias("total"),
    )


@query("json_no_nulls", """
SELECT event_id,
       CASE WHEN event_id % 5 = 0 THEN 'explicit null' WHEN event_id % 7 = 0 THEN 'absent' ELSE 'set' END AS uid_state,
       CASE WHEN value >= 10 THEN 'present' ELSE 'absent' END AS value_state,
       event_type AS kind
FROM events""")
def json_no_nulls(spark, sf):
    rows = table(spark, sf, "events")
    key = F.col("event_id")
    fields = {
        "kind": F.col("event_type"),
        "uid": F.when((key % 5 != 0) & (key % 7 != 0), F.col("user_id")),
        "value": F.when(F.col("value") >= 10, F.col("value")),
    }
    out = rows.select("event_id", compact_json(fields, {"uid": key % 5 == 0}).alias("j"))
    keys = F.json_object_keys("j")
    uid = F.get_json_object("j", "$.uid")
    has_uid = F.array_contains(keys, "uid")
    return out.select(
        "event_id",
        F.when(uid.isNotNull(), "set").when(has_uid, "explicit null").otherwise("absent").alias("uid_state"),
        F.when(F.array_contains(keys, "value"), "present").otherwise("absent").alias("value_state"),
        F.get_json_object("j", "$.kind").alias("kind"),
    )


@query("cdc_latest", f"""WITH {d.SQL_CDC},
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY "offset" DESC) AS rn FROM cdc)
SELECT uid, "offset", operation, message_type, app, round(value, 2) AS value, props
FROM r WHERE rn = 1 AND operation <> 'delete'""")
def cdc_latest(spark, sf):
    state = ev.latest_state(d.cdc(spark, sf).drop("user_id", "ts"))
    return state.withColumn("value", F.round("value", 2))


@query("result_messages", """
SELECT 'out/' || source || '/' || doc_id || '.txt' AS path, 'ok' AS status, doc_id || '.txt' AS name, sha1(text) AS body_hash
FROM documents
UNION ALL
SELECT 'out/' || source || '/' || doc_id || '.txt', 'too_large', 'out/' || source || '/' || doc_id || '.txt', sha1('Error: size exceeded')
FROM documents WHERE octet_length(encode(text)) > 16384""")
def result_messages(spark, sf):
    path = F.concat(F.lit("out/"), F.col("source"), F.lit("/"), d.text("doc_id"), F.lit(".txt"))
    sent = files.result_messages(table(spark, sf, "documents"), path, F.col("text"), cap=16_384)
    message = F.map_entries(F.from_json("value", "map<string,string>"))[0]
    return sent.select("path", "status", message["key"].alias("name"), F.sha1(message["value"]).alias("body_hash"))


@query("exit_notifications", f"""WITH {d.SQL_OPS}
SELECT name, CASE WHEN o_orderkey % 2 = 0 THEN 'even-queue' ELSE 'odd-queue' END AS topic, status,
       name AS workflow, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS payload,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n_keys
FROM ops WHERE status IN ('Error', 'Succeeded', 'Skipped', 'Failed') AND o_orderkey % 11 <> 0""")
def exit_notifications(spark, sf):
    key = F.col("o_orderkey")
    queue = F.when(key % 11 == 0, F.lit(None)).when(key % 2 == 0, "even-queue").otherwise("odd-queue")
    payload = F.when(key % 3 != 0, F.col("o_orderpriority"))
    sent = notify.exit_notices(d.operations(spark, sf), queue, payload)
    parsed = F.from_json("value", "status string, payload string, workflow string")
    return sent.withColumn("v", parsed).select(
        "name", "topic", "v.status", "v.workflow", "v.payload",
        F.size(F.json_object_keys("value")).cast("long").alias("n_keys"),
    )


@query("layer_merge_files", """
WITH a AS (SELECT p_brand, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi, min(p_type) AS t FROM part GROUP BY 1)
SELECT p_brand AS brand, CAST(lo AS VARCHAR) AS lo, CAST(hi + 100 AS VARCHAR) AS hi, t AS kind,
       'null' AS n, 'x' AS extra, 'test' AS env, CAST(5 AS BIGINT) AS n_layers
FROM a""")
def layer_merge_files(spark, sf):
    """Two roots of one JSON file per brand, with overlays for two environments."""
    part = table(spark, sf, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_type").alias("t")
    )
    keep = {"ignoreNullFields": "false"}
    size = F.struct(F.col("lo").alias("min"), F.col("hi").alias("max"))
    bodies = {
        "root=0/suffix=": F.to_json(F.struct("n", size.alias("size"), F.col("t").alias("type")), keep),
        "root=1/suffix=": F.to_json(F.struct(F.struct((F.col("hi") + 100).alias("max")).alias("size"), F.lit("x").alias("extra")), keep),
        "root=0/suffix=-dev": F.to_json(F.struct(F.lit("dev").alias("env"), F.lit(0).alias("n")), keep),
        "root=1/suffix=-dev": F.to_json(F.struct(F.lit(None).cast("int").alias("n")), keep),
        "root=1/suffix=-test": F.to_json(F.struct(F.lit("test").alias("env")), keep),
    }
    rows = F.array(*[
        F.struct(F.lit(int(place[5])).alias("root"), F.lit(place.split("suffix=")[1]).alias("suffix"), body.alias("value"))
        for place, body in bodies.items()
    ])
    path = scratch(spark, "layers")
    long = part.select("p_brand", F.explode(rows).alias("f")).select(
        "f.root", F.concat("p_brand", "f.suffix", F.lit(".json")).alias("file"), "f.value"
    )
    long.repartition("root", "file").write.partitionBy("root", "file").text(path)
    found = files.read_files(spark, path).select(
        F.regexp_extract("path", r"root=(\d+)", 1).cast("int").alias("root"),
        F.url_decode(F.regexp_extract("path", r"file=([^/]+)/", 1)).alias("file"),
        "content",
    )
    merged = files.merge_layers(found, ["dev", "test"]).filter(~F.col("file").rlike(r"-(dev|test)\.json$"))
    v = F.parse_json("content")

    def leaf(json_path):
        return F.to_json(F.variant_get(v, json_path, "variant"))

    return merged.select(
        F.regexp_replace("file", r"\.json$", "").alias("brand"),
        leaf("$.size.min").alias("lo"), leaf("$.size.max").alias("hi"),
        F.variant_get(v, "$.type", "string").alias("kind"), leaf("$.n").alias("n"),
        F.variant_get(v, "$.extra", "string").alias("extra"), F.variant_get(v, "$.env", "string").alias("env"),
        F.col("n_layers").cast("long").alias("n_layers"),
    )


@query("layer_merge_cases", """
WITH a AS (SELECT p_partkey AS k, p_size AS s, p_name AS n FROM part)
SELECT k, 'app.json' AS file, '{"a":{"deep":{"x":' || s || '.12345678901234567890123,"y":1}},"n":2}' AS content, CAST(NULL AS VARCHAR) AS raw FROM a WHERE k % 6 = 0
UNION ALL SELECT k, 'app.json', '{"a":' || s || '}', NULL FROM a WHERE k % 6 = 1
UNION ALL SELECT k, 'app.json', '{oops', NULL FROM a WHERE k % 6 = 2
UNION ALL SELECT k, 'app.json', '{"a":1,"b":null}', NULL FROM a WHERE k % 6 = 3
UNION ALL SELECT k, 'image.bin', NULL, 'FFFE' || lower(hex(CAST(s AS VARCHAR))) FROM a WHERE k % 6 = 4
UNION ALL SELECT k, 'sub/kept.txt', 'second ' || n, NULL FROM a WHERE k % 6 = 5""")
def layer_merge_cases(spark, sf):
    """One case per part and two roots: exact deep numbers, a broken overlay and an empty layer, a
    broken base file, a null value, a file that is no text, and folders and files that are skipped."""
    key = F.col("p_partkey")
    size = d.text("p_size")

    def layer(root, file, content):
        return F.struct(F.lit(root).alias("root"), F.lit(file).alias("file"), F.encode(content, "utf-8").alias("raw"))

    deep = F.concat(F.lit('{"a":{"deep":{"x":'), size, F.lit('.12345678901234567890123}},"n":1}'))
    binary = F.struct(F.lit(1).alias("root"), F.lit("image.bin").alias("file"), F.concat(F.unhex(F.lit("FFFE")), F.encode(size, "utf-8")).alias("raw"))
    cases = [
        [layer(0, "app.json", deep), layer(1, "app.json", F.lit('{"a":{"deep":{"y":1}},"n":2}'))],
        [layer(0, "app.json", F.concat(F.lit('{"a":'), size, F.lit("}"))), layer(0, "app-dev.json", F.lit("{broken")), layer(1, "app.json", F.lit("{}"))],
        [layer(0, "app.json", F.lit('{"a":1}')), layer(1, "app.json", F.lit("{oops"))],
        [layer(0, "app.json", F.lit('{"a":1,"b":2}')), layer(1, "app.json", F.lit("null")), layer(1, "app-dev.json", F.lit('{"b":null}'))],
        [layer(0, "image.bin", F.lit("old")), binary],
        [layer(0, "sub/kept.txt", F.lit("first")), layer(1, "sub/kept.txt", F.concat(F.lit("second "), "p_name")),
         layer(1, "x/node_modules/y/a.json", F.lit("{}")), layer(0, ".git/config", F.lit("x")), layer(0, "sub/node_modules", F.lit("x"))],
    ]
    rows = F.when(F.lit(False), F.array(*cases[0]))
    for n, case in enumerate(cases):
        rows = F.when(key % len(cases) == n, F.array(*case)).otherwise(rows)
    found = table(spark, sf, "part").select("p_partkey", F.explode(rows).alias("f"))
    text = F.col("f.raw").cast("string")
    long = found.select(
        "f.root", F.concat(d.text("p_partkey"), F.lit("/"), F.col("f.file")).alias("file"),
        F.when(F.is_valid_utf8(text), text).alias("content"), F.col("f.raw").alias("raw"))
    merged = files.merge_layers(files.mergeable(long), ["dev"]).filter(~F.col("file").endswith("-dev.json"))
    # the bytes are of interest where there is no text
    return merged.select(
        F.substring_index("file", "/", 1).cast("long").alias("k"), F.regexp_replace("file", "^[0-9]+/", "").alias("file"), "content",
        F.when(F.col("content").isNull(), F.concat(F.lit("FFFE"), F.lower(F.hex(F.substring("raw", 3, 9))))).alias("raw"))


def _results(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber",
        F.round("l_extendedprice", 2).alias("price"),
    )


@query("op_results", """
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'ok' END AS result_status,
       CAST(l_linenumber AS VARCHAR) AS line, round(l_extendedprice, 2) AS price
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def op_results(spark, sf):
    rows = history.results_of(d.operations(spark, sf), _results(spark, sf), "o_orderkey")
    return rows.select("o_orderkey", "result_status", d.text("l_linenumber").alias("line"), "price")


@query("op_results_missing", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def op_results_missing(spark, sf):
    return history.missing_results(d.operations(spark, sf), _results(spark, sf), "o_orderkey")


STORE_FIELDS = ["a", "b"]


def _store_inputs(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b")
    )
    changes = d.cdc(spark, sf).select(
        "offset", "operation", (F.col("user_id") * 11 + F.col("offset") % 11).alias("id"),
        F.col("value").alias("a"), (F.col("offset") % 100).cast("double").alias("b"),
    )
    return base, cut_lineage(changes)


# creates get new ids by offset; an edit is valid when its id is there at that moment
SQL_STORE = f"""WITH {d.SQL_CDC},
ch AS (SELECT "offset", operation, user_id * 11 + "offset" % 11 AS id, value AS a, CAST("offset" % 100 AS DOUBLE) AS b FROM cdc),
born AS (
  SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS born_at, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer
  UNION ALL
  SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY "offset"), "offset", a, b FROM ch WHERE operation = 'create'),
edits AS (SELECT ch.*, born.born_at FROM ch LEFT JOIN born USING (id) WHERE operation IN ('update', 'delete')),
gone AS (SELECT id, min("offset") AS dead FROM edits WHERE operation = 'delete' AND "offset" > born_at GROUP BY id)"""


@query("store_apply", SQL_STORE + """,
ups AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "offset" DESC) AS rn
        FROM edits WHERE operation = 'update' AND "offset" > born_at)
SELECT born.id, round(coalesce(ups.a, born.a), 2) AS a, coalesce(ups.b, born.b) AS b
FROM born LEFT JOIN ups ON ups.id = born.id AND ups.rn = 1
WHERE born.id NOT IN (SELECT id FROM gone)""")
def store_apply(spark, sf):
    base, changes = _store_inputs(spark, sf)
    kept, _ = store.apply_changes(base, changes, STORE_FIELDS)
    return kept.select("id", F.round("a", 2).alias("a"), "b")


@query("store_apply_rejects", SQL_STORE + """
SELECT "offset", operation, edits.id, 'not_found' AS reason FROM edits LEFT JOIN gone USING (id)
WHERE born_at IS NULL OR "offset" <= born_at OR "offset" > dead""")
def store_apply_rejects(spark, sf):
    base, changes = _store_inputs(spark, sf)
    _, rejects = store.apply_changes(base, changes, STORE_FIELDS)
    return rejects
