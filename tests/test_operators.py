"""Golden cases, edge rows and brute-force comparisons on small fixtures."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsontree, maps
from tidemark.functions import text as tx
from tidemark.operators import attributes, events, graph, history, identity, layers, notify, picks, retention, textset
from tidemark.plans.numbering import number_rows
from tidemark.sources import files, store, topics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- attributes and quotas

QUOTAS = {
    "quota-ws-open": 3, "quota-ws-max": 3, "quota-ws-maxcpu": 0.4, "quota-ws-maxmem": 0.5,
    "quota-ws-guaranteecpu": 0.1, "quota-ws-guaranteemem": 0.1, "quota-storage-max": 1.25,
}


def test_quota_golden_case(spark):
    groups = {
        "/Base": {"quota-ws-maxmem": 2.5, "quota-ws-maxcpu": 1, "quota-ws-open": 3, "quota-ws-guaranteemem": 0.1},
        "/Base/Base 1/Base 1 1": {"quota-ws-maxcpu": 2, "quota-ws-open": 10},
        "/Base/Base 2": {"quota-ws-maxmem": 8, "quota-ws-maxcpu": 0.25, "quota-ws-guaranteecpu": 0.25},
        "/Low CU": {"quota-ws-maxmem": 3, "quota-ws-maxcpu": 2.5, "quota-ws-open": 1},
    }
    attrs = spark.createDataFrame(
        [("123", p, k, str(v)) for p, kv in groups.items() for k, v in kv.items()],
        "user string, path string, key string, value string",
    )
    own = spark.createDataFrame([("123", "quota-ws-guaranteemem", "0.5")], "user string, key string, value string")
    users = spark.createDataFrame([("123",), ("nobody",)], "user string")
    got = {
        (r["user"], r["key"]): float(r["value"])
        for r in attributes.effective(users, own, attributes.resolve_groups(attrs), QUOTAS).collect()
    }
    expected = {
        "quota-ws-maxmem": 8.0, "quota-ws-maxcpu": 2.5, "quota-ws-open": 10.0,
        "quota-ws-guaranteecpu": 0.25, "quota-ws-guaranteemem": 0.5, "quota-storage-max": 1.25,
    }
    assert {k: got["123", k] for k in expected} == expected
    assert {k: got["nobody", k] for k in QUOTAS} == {k: float(v) for k, v in QUOTAS.items()}


def test_attribute_resolution_against_brute_force(spark):
    rng = random.Random(5)
    data = set()
    for user in range(60):
        for _ in range(rng.randint(1, 9)):
            path = "/" + "/".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 4)))
            data.add((user, path, rng.choice(["x", "y"]), rng.choice(["1", "2.5Gb", "30", "n/a"])))
    data = sorted(data)
    df = spark.createDataFrame(data, "user int, path string, key string, value string")

    def number(text):
        digits = "".join(c for c in text if c in "0123456789.")
        return float(digits) if digits else None

    want = {}
    for user, path, key, value in data:
        covered = any(u == user and k == key and p.startswith(path + "/") for u, p, k, _ in data)
        if not covered and number(value) is not None:
            want[user, key] = max(want.get((user, key), 0.0), number(value))
    got = {(r["user"], r["key"]): r["value"] for r in attributes.resolve_groups(df).collect()}
    assert got == want


def test_path_prefix_is_not_an_ancestor(spark):
    df = spark.createDataFrame([(1, "/a/b", "k", "9"), (1, "/a/bc", "k", "1")], "user int, path string, key string, value string")
    assert rows(attributes.resolve_groups(df)) == [(1, "k", 9.0)]


def test_unconvertible_descendant_hides_its_ancestor(spark):
    df = spark.createDataFrame([(1, "/a", "k", "9"), (1, "/a/b", "k", "none")], "user int, path string, key string, value string")
    assert rows(attributes.resolve_groups(df)) == []


def test_quota_check_rules(spark):
    active = spark.createDataFrame([("u", True)] * 3 + [("u", False)] * 5 + [("v", True)], "user string, active boolean")
    quotas = spark.createDataFrame([("u", 2.9), ("v", 0.0), ("w", None)], "user string, quota double")
    got = {r["user"]: (r["n_active"], r["rejected"]) for r in attributes.over_quota(active, quotas).collect()}
    assert got == {"u": (3, True), "v": (1, False), "w": (0, False)}


# ---- JSON trees

def merge(left, right, add_keys=True, merge_none=True):
    out = dict(left)
    for key, value in right.items():
        if key not in left and not add_keys:
            continue
        if key in out and isinstance(out[key], dict) and isinstance(value, dict):
            out[key] = merge(out[key], value, add_keys)
        elif merge_none or value is not None:
            out[key] = value
    return out


def tree(rng, depth=0):
    def leaf():
        return rng.choice([1, 2.5, None, True, False, "s", "", [1, "s"], {}])

    return {k: tree(rng, depth + 1) if depth < 3 and rng.random() < 0.4 else leaf() for k in rng.sample("abcd", rng.randint(0, 4))}


@pytest.mark.parametrize("add_keys,merge_none", [(True, True), (False, True), (True, False), (False, False)])
def test_deep_merge_against_brute_force(spark, add_keys, merge_none):
    rng = random.Random(11)
    pairs = [(tree(rng), tree(rng)) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    merged = jsontree.deep_merge(F.parse_json("a"), F.parse_json("b"), add_keys, merge_none)
    for i, text in df.select("i", F.to_json(merged)).collect():
        assert json.loads(text) == merge(*pairs[i], add_keys, merge_none), pairs[i]


def test_deep_merge_sides_and_depth(spark):
    df = spark.createDataFrame([('{"a":1}', None)], "a string, b string")
    a, b = F.parse_json("a"), F.parse_json("b")
    assert df.select(F.to_json(jsontree.deep_merge(a, b)), F.to_json(jsontree.deep_merge(b, a))).first() == ('{"a":1}', '{"a":1}')
    for x, y, want in (("7", '{"a":1}', '{"a":1}'), ('{"a":1}', "[1]", "[1]"), ("{}", "{}", "{}"), ("null", "{}", "{}"), ('{"a":{"b":1}}', '{"a":{}}', '{"a":{"b":1}}'),
                       ('{"a:1":{"":1},"é\\"":2}', '{"a:1":{"1:":3},"é\\"":{"x":[]}}', '{"a:1":{"":1,"1:":3},"é\\"":{"x":[]}}')):
        df = spark.createDataFrame([(x, y)], "a string, b string")
        assert df.select(F.to_json(jsontree.deep_merge(a, b))).first()[0] == want
        plan = df.select(jsontree.deep_merge(a, b), jsontree.replace_strings(a, "x", "y"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan


@pytest.mark.parametrize("levels", [2, 8, 40, 200])
def test_numbers_stay_exact_at_any_depth(spark, levels):
    number = "0.12345678901234567890123"
    nest = lambda inner: '{"d":' * levels + inner + "}" * levels
    df = spark.createDataFrame([(nest(f'{{"l":{number},"s":"old"}}'), nest('{"r":12345678901234567890123}'))], "a string, b string")
    a, b = F.parse_json("a"), F.parse_json("b")
    got = df.select(F.to_json(jsontree.deep_merge(a, b)), F.to_json(jsontree.replace_strings(a, "old", "new"))).first()
    assert got[0] == nest(f'{{"l":{number},"r":12345678901234567890123,"s":"old"}}')
    assert got[1] == nest(f'{{"l":{number},"s":"new"}}')


def test_documents_of_twenty_levels(spark):
    def nest(inner, n=20):
        return '{"d":[' * n + inner + "]}" * n

    df = spark.createDataFrame([('{"d":' * 20 + '{"l":"é s"}' + "}" * 20, '{"d":' * 20 + '{"r":null}' + "}" * 20, nest('"a s \\\" ] s"'))], "a string, b string, c string")
    a, b, c = (F.parse_json(x) for x in "abc")
    got = df.select(F.to_json(jsontree.deep_merge(a, b)), F.to_json(jsontree.replace_strings(c, "s", "t"))).first()
    assert got[0] == '{"d":' * 20 + '{"l":"é s","r":null}' + "}" * 20
    assert got[1] == nest('"a t \\\" ] t"')
    layers = df.select(F.explode(F.array(F.struct(F.lit(0).alias("root"), F.col("a").alias("content")), F.struct(F.lit(1).alias("root"), F.col("b").alias("content")))).alias("x"))
    merged = files.merge_layers(layers.select("x.root", F.lit("a.json").alias("file"), "x.content")).first()["content"]
    assert merged == got[0]


def test_replace_of_texts_that_json_escapes(spark):
    value = {'a"b': 'say "hi"\\ \n and/or é', "k": ["\n", 'a"b', {"a": "\t"}]}
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    for old, new in (('"', "'"), ("\n", "<br>"), ("\\", "/"), ("é", '"'), ("n", "\\n"), ("", "x")):
        got = json.loads(df.select(F.to_json(jsontree.replace_strings(F.parse_json("j"), old, new))).first()[0])
        swap = (lambda t: t.replace(old, new)) if old else (lambda t: t)
        assert got == {'a"b': swap(value['a"b']), "k": [swap("\n"), swap('a"b'), {"a": swap("\t")}]}


def test_replace_strings_at_any_depth(spark):
    def walk(value):
        if isinstance(value, str):
            return value.replace("s", "__")
        if isinstance(value, list):
            return [walk(x) for x in value]
        if isinstance(value, dict):
            return {k: walk(v) for k, v in value.items()}
        return value

    rng = random.Random(3)
    trees = [{"s": [tree(rng), "sos"], "n": tree(rng)} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, j string")
    for i, text in df.select("i", F.to_json(jsontree.replace_strings(F.parse_json("j"), "s", "__"))).collect():
        assert json.loads(text) == walk(trees[i])


def test_nested_filter_tells_missing_from_null_and_false(spark):
    docs = ['{"h":{"a":true}}', '{"h":{"a":false}}', '{"h":{"a":null}}', '{"h":{}}', '{"h":null}', '{"h":{"a":"x"}}', '{"h":{"a":0}}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")

    def hits(wanted):
        return [r[0] for r in df.filter(jsontree.nested_matches(F.parse_json("j"), ["h", "a"], wanted)).sort("i").collect()]

    assert hits(True) == [0, 1, 5, 6]
    assert hits(False) == [1, 2, 6]
    assert hits("x") == [5]
    assert hits(None) == [2]


def test_compact_json_keeps_an_explicit_null(spark):
    df = spark.createDataFrame([(None, 1, True), (None, 1, False), ("x", None, True), (None, None, True)], "uid string, n int, was_set boolean")
    out = jsontree.compact_json({"uid": F.col("uid"), "n": F.col("n")}, {"uid": F.col("was_set")})
    assert [json.loads(r[0]) for r in df.select(out).collect()] == [{"uid": None, "n": 1}, {"n": 1}, {"uid": "x"}, {"uid": None}]


# ---- maps and text

def test_key_styles_and_collisions(spark):
    df = spark.createDataFrame([({"userName": "a", "user_name": "b", "lastSeenAt": "c"},)], "m map<string,string>")
    got = df.select(maps.snake_keys(F.col("m")), maps.resolve_key(F.col("m"), "last_seen_at"), maps.resolve_key(F.col("m"), "user_name")).first()
    assert got[0] == {"user_name": "b", "last_seen_at": "c"} and got[1] == "c" and got[2] == "b"


def test_filter_attributes_of_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ({"a": ["1", "2"], "b": []},)], "m map<string,array<string>>")
    got = [r[0] for r in df.select(maps.filter_attributes(F.col("m"))).collect()]
    assert got == [{}, {"a": "1", "b": None}]


def test_render_is_one_pass(spark):
    df = spark.createDataFrame([("{{ b }}", "B", None)], "a string, b string, c string")
    template = "New {{ a }} - {{b}} {{ missing }}{{ c }}!"
    out = df.select(tx.render(template, {x: F.col(x) for x in "abc"})).first()[0]
    assert out == "New {{ b }} - B !"


def test_reference_parts(spark):
    cases = {
        "reg.io/a/b:1": ("reg.io", "a/b", "1"), "a/b": ("docker.io", "a/b", "latest"),
        "ubuntu": ("docker.io", "ubuntu", "latest"), "reg.io/x": ("reg.io", "x", "latest"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    assert {r["r"]: tuple(r["p"]) for r in df.select("r", tx.reference_parts(F.col("r")).alias("p")).collect()} == cases


def test_name_rules(spark):
    df = spark.createDataFrame([("My Task", "wf-a-b7", "/a_B/c", "x-y", "-My_App/1-")], "t string, r string, p string, m string, i string")
    got = df.select(
        tx.task_name(F.col("t")), tx.run_family(F.col("r")), tx.name_of_path(F.col("p")), tx.module_name(F.col("m")), tx.image_name(F.col("i"))
    ).first()
    assert tuple(got) == ("my-task", "wf-a", "abc", "x_y", "myapp1")


def test_quantities_and_units(spark):
    df = spark.createDataFrame([("1.5Gb",), ("abc",), ("1.2.3",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.to_number(F.col("v"))).collect()] == [1.5, None, None, None]
    df = spark.createDataFrame([(0.5,), (2.0,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(tx.with_unit(F.col("v"), "Gi")).collect()] == ["0.5Gi", "2Gi", None, None]


def test_glob(spark):
    df = spark.createDataFrame([("a.py",), ("b.txt",), ("c/a.py",), ("xa.pyc",)], "f string")
    assert rows(df.filter(tx.matches_glob(F.col("f"), "?.py"))) == [("a.py",)]
    assert len(rows(df.filter(tx.matches_glob(F.col("f"), "*.py")))) == 2


# ---- events

def _topic(spark, values):
    return spark.createDataFrame(
        [(str(i), v, "t", 0, i, dt.datetime(2024, 1, 1)) for i, v in enumerate(values)], topics.TOPIC_SCHEMA
    )


def test_bad_records_do_not_stop_the_good_ones(spark):
    good = '{"message_type":"jobs","operation":"create","uid":1,"resource":{"a":1},"meta":{"app_name":"x","args":[{"b":2}]},"more":true}'
    values = [
        good, "{not json", '{"a":1}', '{"operation":"merge","message_type":"j","meta":{"app_name":"x"}}',
        '{"operation":null,"message_type":"j"}', '{"operation":"create","meta":{"app_name":"x"}}',
        '{"operation":"create","message_type":"j","meta":{}}', '{"operation":"create","message_type":"j"}',
    ]
    got = {r["offset"]: r["reason"] for r in topics.parse_cdc(_topic(spark, values)).collect()}
    assert got == {0: None, 1: "not_json", 2: "no_operation", 3: "bad_operation", 4: "bad_operation", 5: "schema", 6: "schema", 7: "schema"}
    event = topics.good_events(_topic(spark, values)).first()
    assert (event["uid"], json.loads(event["resource"]), event["meta"]["args"]) == ("1", {"a": 1}, ['{"b":2}'])


def test_latest_state_by_offset_not_by_arrival(spark):
    df = spark.createDataFrame([("a", 2, "delete"), ("a", 1, "create"), ("b", 5, "update"), ("b", 4, "delete")], "uid string, offset long, operation string")
    assert rows(events.latest_state(df)) == [("b", 5, "update")]


def test_topic_directory_roundtrip_and_empty(spark, tmp_path):
    df = _topic(spark, ['{"a":1}', '{"a":2}'])
    path = str(tmp_path / "topic")
    topics.write_topic(df, path)
    topics.write_topic(df.withColumn("topic", F.lit("u")), path)
    assert topics.read_topic(spark, path).count() == 4
    assert rows(topics.decode(topics.read_topic(spark, path, "t"), "a int").select("a")) == [(1,), (2,)]
    assert topics.read_topic(spark, path, "none").count() == 0
    assert topics.read_topic(spark, str(tmp_path / "new")).count() == 0
    assert [r["offset"] for r in topics.read_topic(spark, path, "u", in_order=True).collect()] == [0, 1]


def test_store_against_sequential_run(spark):
    rng = random.Random(9)
    base = {i: (float(i),) for i in range(5)}
    changes = [(o, rng.choice(["create", "update", "update", "delete"]), rng.randint(0, 14), o * 1.0) for o in range(80)]
    state, counter, rejected = dict(base), max(base), []
    for offset, operation, key, value in changes:
        if operation == "create":
            counter += 1
            state[counter] = (value,)
        elif key not in state:
            rejected.append(offset)
        elif operation == "update":
            state[key] = (value,)
        else:
            del state[key]
    b = spark.createDataFrame([(k, v[0]) for k, v in base.items()], "id long, a double")
    c = spark.createDataFrame(changes, "offset long, operation string, id long, a double")
    kept, bad = store.apply_changes(b, c, ["a"])
    assert rows(kept) == sorted((k, v[0]) for k, v in state.items())
    assert sorted(r["offset"] for r in bad.collect()) == rejected


# ---- notifications

def test_rules_fire_per_entry_and_failures_stay_apart(spark):
    ev = spark.createDataFrame([("t", "create", "1", "app", "t - 1")], "message_type string, operation string, uid string, app_name string, description string")
    rules = notify.rule_frame(spark, [{"app": "other", "message_type": "t", "events": ["create", "create"]}, {"app": "x", "message_type": "u", "events": ["create"]}])
    setup = (
        {"create": {"subject": "New {{ message_type }} - {{ domain }}", "template": "{{ description }}", "channels": ["m", "c", "gone"]}},
        {"m": {"adapter": "email", "backends": ["email"], "from": "f", "to": ["a", "b"]}, "c": {"adapter": "chat", "backends": ["console"], "from": "f", "to": []}, "gone": None},
    )
    out = notify.outbox(notify.match_rules(ev, rules), *setup, "d.org").collect()
    assert sorted((r["channel"], r["status"], r["subject"]) for r in out) == [
        ("c", "failed", None), ("c", "failed", None), ("m", "rendered", "New t - d.org"), ("m", "rendered", "New t - d.org"),
    ]


def test_exit_notice_without_payload(spark):
    ops = spark.createDataFrame([("a", "Failed"), ("b", "Running")], "name string, status string")
    got = notify.exit_notices(ops, F.lit("q"), F.lit(None).cast("string")).collect()
    assert [(r["name"], json.loads(r["value"])) for r in got] == [("a", {"status": "Failed", "workflow": "a"})]


# ---- identity

def test_two_key_resolution(spark):
    source = spark.createDataFrame(
        [("e1", "ann", None), ("e2", "bob", None), ("e3", "bob", None), ("e4", None, "dan@x"), ("e5", "", ""), ("e6", "ann", None)],
        "ext_id string, username string, email string",
    )
    target = spark.createDataFrame([("t1", "ann-old", "e1"), ("t2", "bob", None), ("t3", "ann", None)], "target_id string, username string, ext_id string")
    got = {r["ext_id"]: (r["label"], r["target_id"]) for r in identity.resolve_users(source, target).collect()}
    assert got == {
        "e1": ("matched_id", "t1"), "e2": ("matched_name", "t2"), "e3": ("conflict", None),
        "e4": ("new", None), "e5": ("rejected", None), "e6": ("matched_name", "t3"),
    }


def test_organization_of_same_name_with_another_id_is_a_conflict(spark):
    source = spark.createDataFrame([("o1", "A"), ("o2", "B"), ("o3", "C")], "ext_id string, name string")
    target = spark.createDataFrame([("t1", "A", "zz"), ("t2", "B", None)], "target_id string, name string, ext_id string")
    got = {r["ext_id"]: r["action"] for r in identity.upsert_organizations(source, target).collect()}
    assert got == {"o1": "conflict", "o2": "adopt", "o3": "insert"}


def test_group_without_superuser_gets_no_owner(spark):
    source = spark.createDataFrame([("g1", "A")], "ext_id string, name string")
    groups = spark.createDataFrame([], "group_id int, name string, ext_id string")
    none = spark.createDataFrame([], "user_id long")
    row = identity.upsert_groups(source, groups, none).first()
    assert (row["action"], row["owner"]) == ("create", None)


def test_keep_lowest_keeps_rows_without_group(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, ext string")
    assert {r["id"]: r["kept"] for r in identity.keep_lowest(df, "ext", "id").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_group_members_shows_empty_groups(spark):
    groups = spark.createDataFrame([(1, "a"), (2, "b")], "g int, name string")
    members = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "g int, u int")
    details = spark.createDataFrame([(7, ["r"])], "u int, roles array<string>")
    got = sorted((r["name"], r["u"]) for r in identity.group_members(groups, members, details, "g", "u").collect() if r["u"])
    assert got == [("a", 7), ("a", 8)]
    assert identity.group_members(groups, members, details, "g", "u").filter("name = 'b' and u is null").count() == 1


# ---- operation history

def test_pages_meet_without_gap(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(f"op-{i:02d}", "Succeeded", day + dt.timedelta(days=i // 4)) for i in range(23)]
    ops = spark.createDataFrame(data, "name string, status string, create_time timestamp_ntz")
    seen, token, pages = [], None, 0
    while True:
        found, token = history.page(ops, None, 10, token)
        seen += [r["name"] for r in found.collect()]
        pages += 1
        if token is None:
            break
    assert seen == [d[0] for d in data] and pages == 3
    with pytest.raises(ValueError):
        history.page(ops, None, 51)


def test_page_of_nothing(spark):
    ops = spark.createDataFrame([], "name string, status string, create_time timestamp_ntz")
    found, token = history.page(ops, "Failed")
    assert found.count() == 0 and token is None


def test_log_parts_make_the_whole_log(spark):
    lines = spark.createDataFrame([("a", i, f"line {i}") for i in range(25)], "op string, seq int, text string").repartition(5)
    parts = sorted(history.concat_logs(lines, "op", "seq", "text", lines_per_part=10).collect(), key=lambda r: r["part"])
    assert len(parts) == 3
    assert "\n".join(p["log"] for p in parts) == "\n".join(f"line {i}" for i in range(25))


def test_expiry_none_is_for_ever(spark):
    day = dt.datetime(2024, 1, 1)
    ops = spark.createDataFrame([("a", "Succeeded", day), ("b", "Failed", day), ("c", "Running", day)], "name string, status string, end_time timestamp_ntz")
    later = F.lit("2024-01-01 01:30:00").cast("timestamp")
    assert [r["name"] for r in history.expired(ops, later).collect()] == ["a"]
    assert history.expired(ops, later, done=None, success=None, failure=None).count() == 0


# ---- layers and files

def test_layer_files_of_two_roots_and_envs(spark):
    data = [
        (0, "a.json", '{"a":"a","b":{"ba":"ba","bb":"bb"}}'), (1, "a.json", '{"a":"a1","b":{"ba":"ba1","bc":"bc"}}'),
        (0, "a-dev.json", '{"a":"dev"}'), (1, "b-dev.json", '{"x":1}'), (0, "n.txt", "old"), (1, "n.txt", "new"), (0, "bad.json", "{oops"),
    ]
    df = spark.createDataFrame(data, "root int, file string, content string")
    got = {r["file"]: r["content"] for r in files.merge_layers(df, ["dev"]).collect()}
    assert json.loads(got["a.json"]) == {"a": "a1", "b": {"ba": "ba1", "bb": "bb", "bc": "bc"}}
    assert got["n.txt"] == "new" and got["bad.json"] == "{oops" and "b.json" not in got
    alone = {r["file"]: r["content"] for r in files.merge_layers(df.filter("root = 0"), ["dev"]).collect()}
    assert json.loads(alone["a.json"])["a"] == "dev"


def test_result_messages_send_every_content(spark):
    df = spark.createDataFrame([("d/a.txt", "x" * 10), ("d/b.txt", "x" * 11)], "p string, c string")
    got = sorted((r["path"], r["status"], list(json.loads(r["value"]).items())[0]) for r in files.result_messages(df, F.col("p"), F.col("c"), 10).collect())
    assert got == [
        ("d/a.txt", "ok", ("a.txt", "x" * 10)), ("d/b.txt", "ok", ("b.txt", "x" * 11)),
        ("d/b.txt", "too_large", ("d/b.txt", "Error: size exceeded"))]


def test_layers_that_change_nothing(spark):
    data = [(0, "a.json", '{"x":1}'), (0, "a-dev.1.json", "{broken"), (0, "a-devX1.json", '{"x":9}'), (1, "a.json", '{"y":2}'),
            *[(2 + i, "a.json", c) for i, c in enumerate(("null", "[]", '""', "{}"))], (9, "a.json", '{"z":3}')]
    df = spark.createDataFrame(data, "root int, file string, content string")
    got = {r["file"]: r["content"] for r in files.merge_layers(df, ["dev.1"]).collect()}
    assert json.loads(got["a.json"]) == {"x": 1, "y": 2, "z": 3}


def test_binary_layers_keep_their_bytes(spark):
    df = spark.createDataFrame([(0, "a.bin", "t", b"t"), (1, "a.bin", None, b"\xff")], "root int, file string, content string, raw binary")
    row = files.merge_layers(df).first()
    assert row["content"] is None and bytes(row["raw"]) == b"\xff"


def test_final_breaks_of_a_file(spark):
    df = spark.createDataFrame([(1, "a\n\n"), (2, "a\n\n\n"), (3, "a"), (4, "\n"), (5, "")], "k int, c string")
    got = {k: n for k, n in textset.explode_lines(df, "k", "c").groupBy("k").count().collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 1, 5: 1}


def test_nulls_do_not_vanish(spark):
    users = spark.createDataFrame([("u", "ann")], "id string, username string")
    asked = identity.find_users(spark.createDataFrame([(None,), ("ann",)], "arg string"), users)
    assert sorted((r["arg"] or "", r["status"]) for r in asked.collect()) == [("", "not_found"), ("ann", "found")]
    edges = spark.createDataFrame([("a", "gone", None)], "src string, dst string, kind string")
    node = spark.createDataFrame([("a",)], "node string")
    assert [r["severity"] for r in graph.broken_references(edges, node, node).collect()] == ["error"]


def test_camel_request_finds_snake_key(spark):
    df = spark.createDataFrame([({"user_name": "ann"},)], "m map<string,string>")
    assert df.select(maps.resolve_key(F.col("m"), "userName")).first()[0] == "ann"


def test_text_hook(spark):
    df = spark.createDataFrame([("u", "/a", "k", "x"), ("u", "/a/b", "k", "y")], "user string, path string, key string, value string")
    got = attributes.resolve_groups(df, lambda v: F.concat(v, F.lit("!"))).collect()
    assert [tuple(r) for r in got] == [("u", "k", "y!")]


def test_read_files_marks_undecodable(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\xfa")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert (got["a.txt"]["content"], got["a.txt"]["status"]) == ("héllo", "ok")
    assert (got["b.bin"]["content"], got["b.bin"]["status"], bytes(got["b.bin"]["raw"])) == (None, "not_text", b"\xff\xfe\xfa")


def test_overlay_null_wins(spark):
    df = spark.createDataFrame([("k", "p", "a", 0), ("k", "p", None, 1)], "app string, path string, value string, rank int")
    assert layers.overlay(df, "app").first()["value"] is None


def test_lookup_default_takes_the_first(spark):
    apps = spark.createDataFrame([("w", "b", 2, 1), ("w", "a", 1, 2), ("h", "hub", 0, 3)], "sub string, name string, port int, seq int")
    req = spark.createDataFrame([("w",), ("?",)], "sub string")
    assert rows(layers.lookup_default(req, apps, "sub", ["port"], "hub")) == [("?", "hub", 0), ("w", "b", 2)]


# ---- graphs

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("a", "unknown")]


def test_closure_with_cycle_unknown_and_implied(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("w",)], "node string")
    implied = spark.createDataFrame([("d", "accounts")], "src string, dst string")
    got = {r["node"] for r in graph.closure(seeds, edges, implied).collect()}
    assert got == {"a", "b", "c", "d", "unknown", "w", "x", "y", "z", "accounts"}
    assert graph.closure(seeds.limit(0), edges).count() == 0


def test_levels_with_cycle(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdwxyz"], "node string")
    edges = spark.createDataFrame(EDGES + [("a", "b")], "src string, dst string")
    got = {r["node"]: (r["level"], r["status"]) for r in graph.levels(nodes, edges).collect()}
    assert got == {
        "d": (0, "placed"), "b": (1, "placed"), "c": (1, "placed"), "a": (2, "placed"),
        **{n: (None, "cyclic") for n in "wxyz"},
    }


def test_chained_tags_against_brute_force(spark):
    deps = {"a": [], "b": ["a"], "c": ["b", "a", "nope"], "d": ["a", "c", "b"]}
    nodes = spark.createDataFrame([(n, "own" + n) for n in deps], "node string, own string")
    edges = spark.createDataFrame([(n, x, i) for n, xs in deps.items() for i, x in enumerate(xs)], "src string, dst string, pos int")

    def tag(n):
        return hashlib.sha1(("own" + n + "".join(tag(x) for x in deps[n] if x in deps)).encode()).hexdigest()

    assert {r["node"]: r["tag"] for r in graph.chained_tags(nodes, edges).collect()} == {n: tag(n) for n in deps}


def test_fingerprint_changes_with_path_and_content(spark):
    def tag(data, ignore=()):
        df = spark.createDataFrame([("g", p, c) for p, c in data], "g string, p string, c string")
        return graph.fingerprint(df, "g", "p", "c", ignore).first()["fingerprint"]

    base = [(f"f{i}", f"text {i}") for i in range(40)]
    assert tag(base) == tag(list(reversed(base)))
    assert tag(base) != tag([("g0", "text 0"), *base[1:]])
    assert tag(base) != tag([("f0", "other"), *base[1:]])
    assert tag(base[1:]) == tag(base, ignore=["/f0"])


def test_integrity_levels(spark):
    edges = spark.createDataFrame(
        [("a", "b", "hard"), ("a", "no", "hard"), ("a", "no", "soft"), ("a", "img", "build"), ("a", "no", "build"), ("a", "img", "service")],
        "src string, dst string, kind string",
    )
    apps = spark.createDataFrame([("a",), ("b",)], "node string")
    images = spark.createDataFrame([("img",)], "node string")
    got = sorted((r["dst"], r["kind"], r["severity"]) for r in graph.broken_references(edges, apps, images).collect())
    assert got == [("img", "service", "error"), ("no", "build", "error"), ("no", "hard", "error"), ("no", "soft", "warning")]


# ---- texts

def test_line_dedup_against_a_loop(spark):
    texts = {1: "a\nb\na\n", 2: "b\nc", 3: "c\n\nd\n", 4: "", 5: "\nd"}
    seen, want = set(), []
    for key, text in texts.items():
        lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n")
        want += [(key, pos, line) for pos, line in enumerate(lines) if line not in seen]
        seen |= set(lines)
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert rows(textset.new_lines(df, "id", "text")) == want


def test_keep_best_prefers_real_runs(spark):
    df = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("t", 3, False), ("s", 4, True), ("s", 5, True)], "name string, seq int, skipped boolean")
    assert rows(textset.keep_best(df, "name", "seq", F.col("skipped"))) == [("s", 4, True), ("t", 2, False)]


def test_leading_run_with_hot_group(spark):
    data = [("hot", i, i < 700) for i in range(1000)] + [("none", 0, False), ("all", 0, True), ("all", 1, True)]
    df = spark.createDataFrame(data, "k string, pos int, ok boolean")
    got = textset.leading_run(df, "k", "pos", F.col("ok")).groupBy("k").count()
    assert rows(got) == [("all", 2), ("hot", 700)]


def test_argument_lines(spark):
    df = spark.createDataFrame([(1, "ARG Base_Image\nARG B\nARG TAG=1\nARG C"), (2, "FROM x"), (3, "ARG only")], "id int, t string")
    assert rows(textset.argument_names(df, "id", "t")) == [(1, 0, "base-image"), (1, 1, "b"), (3, 0, "only")]


def test_bulk_replace_order_and_patterns(spark):
    df = spark.createDataFrame([("a/x.yaml", "old key"), ("a/x.txt", "old key")], "p string, t string")
    rules = [{"keyword": "old", "patterns": ["*.yaml"], "to_be_replaced": [("old", "new"), ("new key", "done")]}]
    assert rows(df.select("p", textset.bulk_replace(F.col("t"), F.col("p"), rules))) == [("a/x.txt", "old key"), ("a/x.yaml", "done")]


# ---- retention and sessions

def test_retention_limits_are_whole_days(spark):
    asof = dt.datetime(2024, 3, 1)
    data = [(asof - dt.timedelta(days=7, hours=23, minutes=59),), (asof - dt.timedelta(days=8),)]
    df = spark.createDataFrame(data, "ts timestamp_ntz")
    got = retention.retention(df, F.lit("2024-03-01").cast("timestamp")).filter("tier = 'daily'")
    assert sorted((r["age_days"], r["keep"]) for r in got.collect()) == [(7, True), (8, False)]


def test_iso_week_over_new_year(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30),), (dt.datetime(2025, 1, 3),), (dt.datetime(2023, 1, 1),)], "ts timestamp_ntz")
    got = retention.tiers(df).filter("tier = 'weekly'")
    assert {(r["bucket"], r["ts"].date().isoformat()) for r in got.collect()} == {("2025-01", "2025-01-03"), ("2022-52", "2023-01-01")}


def test_sessions_against_a_loop(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    data = sorted({(u, start + dt.timedelta(seconds=rng.randint(0, 60_000))) for u in range(3) for _ in range(60)})
    want, last = [], None
    for user, ts in data:
        if last and last[0] == user and (ts - last[1]).total_seconds() <= 900:
            want[-1] = (user, want[-1][1], ts, want[-1][3] + 1)
        else:
            want.append((user, ts, ts, 1))
        last = (user, ts)
    df = spark.createDataFrame(data, "user int, ts timestamp_ntz")
    got = retention.sessions(df, 900).select("user", "start_ts", "end_ts", "n_events")
    assert rows(got) == sorted(want)


# ---- plans

def test_numbering_sorts_once(spark):
    plan = number_rows(spark.range(100).repartition(4), ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 1 and "hashpartitioning(id" not in plan and "Sort [id" not in plan


def test_numbers_are_consecutive_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = number_rows(df, ["k"], "n", 5).sort("k").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_assign_ids_to_nothing(spark):
    existing = spark.createDataFrame([], "id long")
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    assert rows(picks.assign_ids(existing, new, "id", ["name"]).select("id", "name")) == [(1, "a"), (2, "b")]
    assert picks.assign_ids(existing, new.limit(0), "id", ["name"]).count() == 0


def test_validation_treats_null_as_broken(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "b")], "n int, s string")
    checked = events.validate(df, {"n": F.col("n") > 0, "s": F.col("s").rlike("^[a-z]$")})
    assert {r["rule"]: r["n"] for r in events.validation_summary(checked).collect()} == {"ok": 1, "n": 1, "s": 1}


# ---- ignore lists, hash trees, images, tasks and hooks

def plain_ignored(path, patterns):
    """Segment by segment, without regular expressions over whole paths."""
    import fnmatch

    def segments(parts, pattern):
        if not pattern:
            return True  # what lies inside matches too
        if not parts:
            return pattern == ["**"] and False
        if pattern[0] == "**":
            if len(pattern) == 1:
                return True
            return any(segments(parts[i:], pattern[1:]) for i in range(len(parts)))
        return fnmatch.fnmatchcase(parts[0], pattern[0]) and segments(parts[1:], pattern[1:])

    ignored = False
    for p in patterns:
        if not p.strip("/ ") or p.startswith("#"):
            continue
        again, p = p.startswith("!"), p.lstrip("!")
        folder, body = p.endswith("/"), p.rstrip("/")
        pattern = body.lstrip("/").split("/")
        if "/" not in body:
            pattern = ["**", *pattern]
        parts = path.split("/")
        if folder:
            parts = parts[:-1]  # the folder itself has to match, not the file
        if parts and segments(parts, pattern):
            ignored = not again
    return ignored


def test_ignore_lists_equal_a_plain_matcher(spark):
    from tidemark.functions.text import ignored_path

    rng = random.Random(7)
    paths = sorted({"/".join(rng.choice(["a", "b", "ab", "a.py", "build", "x1"]) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    pool = ["a", "/a", "a/", "b/a", "*.py", "!a.py", "**/b", "a/**/b", "b/**", "!b/a/*", "x?", "x[0-9]", "[!a]", "# a", "", "/", "/build/", "!/build/a", "a*", "**/a/*"]
    for _ in range(40):
        patterns = rng.sample(pool, rng.randint(0, 5))
        got = {r["p"] for r in df.filter(ignored_path(F.col("p"), patterns)).collect()}
        assert got == {p for p in paths if plain_ignored(p, patterns)}, patterns


def test_tag_of_a_node_with_very_many_dependencies(spark):
    import hashlib

    n, chunk = 100_000, 1024
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    leaf = F.concat(F.lit("d"), F.col("id"))
    nodes = spark.range(n).select(leaf.alias("node"), F.lit("x").alias("own")).union(spark.createDataFrame([("top", "o"), ("next", "p")], "node string, own string"))
    edges = spark.range(n).select(F.lit("top").alias("src"), leaf.alias("dst"), F.col("id").alias("pos")).union(
        spark.createDataFrame([("next", "top", 1), ("next", "gone", 0), ("d7", "d7", 0)], "src string, dst string, pos bigint"))
    got = {r["node"]: (r["tag"], r["level"]) for r in graph.chained_tags(nodes, edges.filter("src != 'd7'"), chunk).filter("node in ('top', 'next', 'd0')").collect()}
    tags = [sha("x")] * n
    top = sha("o" + "".join(sha("".join(tags[i:i + chunk])) for i in range(0, n, chunk)))
    assert got == {"d0": (sha("x"), 0), "top": (top, 1), "next": (sha("p" + top), 2)}


def test_images_inside_an_application(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    apps = frame([("web", "web:1"), ("flows", "flows:1"), ("base", "base:1"), ("tools", None), ("idle", "idle:1")], "node string, image string")
    images = frame([("flows", "flows-send", "s"), ("flows", "flows-read", "r"), ("tools", "tools-zip", "z"), ("tools", "tools-tar", "t"), ("idle", "idle-x", "i")],
                   "app string, name string, image string")
    edges = frame([("web", "flows", "hard"), ("web", "base", "build"), ("flows", "tools-zip", "build"), ("tools-zip", "none-such", "build")], "src string, dst string, kind string")
    seeds = frame([("web",)], "node string")

    def found(*gone):
        rows = graph.included_images(seeds, edges, frame([(g,) for g in gone], "node string"), apps, images).collect()
        return sorted((r["name"], r["app"], r["image"]) for r in rows)

    every = [("base", "base", "base:1"), ("flows-read", "flows", "r"), ("flows-send", "flows", "s"), ("tools-zip", "tools", "z")]
    assert found() == every
    assert found("flows-send") == [r for r in every if r[0] != "flows-send"]
    assert found("flows", "base") == [("tools-zip", "tools", "z")]


def test_isolated_task_tries_again(spark, tmp_path):
    seen = str(tmp_path)

    def task(frame):
        import os

        if (frame["a"] == 13).any():
            raise ValueError("thirteen")
        for a in frame["a"][frame["a"] % 50 == 7]:
            mark = f"{seen}/{a}"
            tries = int(open(mark).read()) if os.path.exists(mark) else 0
            open(mark, "w").write(str(tries + 1))
            if tries < 8:
                raise RuntimeError("not yet")
        return frame.assign(b=frame["a"] * 2)[["a", "b"]]

    rows = picks.run_task_isolated(spark.range(200).select(F.col("id").alias("a")).coalesce(1), task, "a long, b long", ["a"]).collect()
    assert sorted((r["a"], r["b"], r["error"]) for r in rows if r["a"] != 13) == [(a, 2 * a, None) for a in range(200) if a != 13]
    assert [(r["b"], r["error"]) for r in rows if r["a"] == 13] == [(None, "ValueError: thirteen")]


def test_python_hook_skips_values_on_which_it_fails(spark):
    rows = spark.createDataFrame([(1, "/a", "k", "2"), (1, "/a/b", "k", "x"), (1, "/c", "k", "7"), (2, "/a", "k", None), (3, "/a", "k", "0")],
                                 "user int, path string, key string, value string")
    got = attributes.resolve_groups_with(rows, lambda v: 10 // int(v), "int").collect()
    assert sorted(map(tuple, got)) == [(1, "k", 1)]


def test_skipped_folders_and_files(spark):
    names = ["a.json", "node_modules/x.json", "d/.git/y", "d/.github/z", "d/node_modules", "e/.tox/1/2.txt", "node_modules.json"]
    df = spark.createDataFrame([(0, n, "") for n in names], "root int, file string, content string")
    assert {r["file"] for r in files.mergeable(df).collect()} == {"a.json", "node_modules.json"}
