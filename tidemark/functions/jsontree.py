"""Nested JSON as VARIANT: lookup, filter, deep merge and value replacement.

All functions are row-local column expressions of built-in functions, for any depth that the JSON
parser takes (1,000 levels; a deeper text does not parse). A merge parts both trees into leaves with
their paths, by as many steps as the deeper one has levels, decides leaf by leaf and writes the tree
again; numbers stay the text they were read as.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"
_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")
# a JSON string, and one with what follows it in compact JSON: a colon after a key
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = _STRING + ':?+|[^"]++'


def as_object(value: Column) -> Column:
    """The members of a JSON object, SQL NULL for anything else."""
    return F.try_variant_get(value, "$", _OBJECT)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _levels(text: Column) -> Column:
    """How deep the braces of a JSON text nest."""
    braces = F.regexp_replace(F.regexp_replace(text, _STRING, ""), "[^{}]++", "")

    def step(seen: Column, brace: Column) -> Column:
        now = seen["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(braces, ""), begin, step)["most"]


def _quoted(key: Column) -> Column:
    return F.to_json(key.cast("variant"))


def leaves(value: Column) -> Column:
    """Array of (path, place, text) of everything in a JSON value that is not an object with members.

    ``path`` holds the keys; ``place`` is the path as one text in which each key comes after its length,
    so one place begins with another exactly where its path does. ``text`` is JSON.
    """
    top = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.lit("").alias("place"), value.alias("leaf")))

    def open_object(node: Column) -> Column:
        def members(held: Column) -> Column:
            inside = F.transform(F.map_entries(held), lambda m: F.struct(
                F.concat(node["path"], F.array(m["key"])).alias("path"),
                F.concat(node["place"], F.length(m["key"]).cast("string"), F.lit(":"), m["key"]).alias("place"),
                m["value"].alias("leaf")))
            return F.when(F.size(held) > 0, inside).otherwise(F.array(node))

        return _let(as_object(node["leaf"]), members)

    opened = F.aggregate(
        F.array_repeat(F.lit(0), _levels(F.to_json(value))), top, lambda nodes, _: F.flatten(F.transform(nodes, open_object)))
    return F.transform(opened, lambda n: F.struct(n["path"].alias("path"), n["place"].alias("place"), F.to_json(n["leaf"]).alias("text")))


def tree_text(found: Column) -> Column:
    """JSON text of leaves as ``leaves`` gives them, with paths that form a tree."""

    def keys(path: Column) -> Column:
        return F.array_join(F.transform(path, lambda k: F.concat(_quoted(k), F.lit(":"))), "{")

    def write(ordered: Column) -> Column:
        def piece(leaf: Column, i: Column) -> Column:
            path, before = leaf["path"], F.get(ordered, i - 1)["path"]
            depth, last = F.size(path), F.size(before)
            shared = F.size(F.filter(
                F.sequence(F.lit(1), F.least(depth, last)), lambda j: F.slice(path, F.lit(1), j) == F.slice(before, F.lit(1), j)))
            next_ = F.concat(
                F.repeat(F.lit("}"), last - 1 - shared), F.lit(","), keys(F.slice(path, shared + 1, depth)), leaf["text"])
            first = F.concat(F.when(depth > 0, "{").otherwise(""), keys(path), leaf["text"])
            return F.when(i == 0, first).otherwise(next_)

        end = F.repeat(F.lit("}"), F.size(F.element_at(ordered, -1)["path"]))
        return F.concat(F.array_join(F.transform(ordered, piece), ""), end)

    return _let(F.sort_array(found), write)


def merge_text(left: Column, right: Column, add_keys: bool = True, merge_none: bool = True) -> Column:
    """JSON text of variant ``right`` merged over variant ``left``, neither of them NULL; may stand in a lambda.

    A leaf of the left side stays unless the right side has a leaf at its place or above it, or one
    below it, which makes an object of it. A row costs the product of both numbers of leaves.
    """

    def meets(a: Column, b: Column) -> Column:
        return a["place"].startswith(b["place"])

    def merge(both: Column) -> Column:
        old, new = both[0], both[1]
        is_empty = lambda leaf: leaf["text"] == "{}"
        # an empty object changes nothing where the left side has an object
        kept = F.filter(new, lambda r: ~(is_empty(r) & F.exists(
            old, lambda l: meets(l, r) & ((l["place"] != r["place"]) | is_empty(l)))))
        if not merge_none:
            top_object = ~F.exists(old, lambda l: (l["place"] == "") & ~is_empty(l))
            kept = F.filter(kept, lambda r: ~(top_object & (F.size(r["path"]) == 1) & (r["text"] == "null")))
        if not add_keys:
            # the left side has the key, or a leaf in the place of an object on the way
            kept = F.filter(kept, lambda r: F.exists(old, lambda l: meets(l, r) | (meets(r, l) & ~is_empty(l))))
        return _let(kept, lambda k: tree_text(F.concat(
            F.filter(old, lambda l: ~F.exists(k, lambda r: meets(l, r) | meets(r, l))), k)))

    return _let(F.array(leaves(left), leaves(right)), merge)


def deep_merge(left: Column, right: Column, add_keys: bool = True, merge_none: bool = True) -> Column:
    """Merge variant ``right`` over variant ``left``.

    Objects merge member by member, anything else is replaced. ``add_keys=False`` keeps only the
    keys of the left side; ``merge_none=False`` ignores JSON nulls at the top level of the right
    side. An SQL NULL side gives the other side.
    """
    merged = F.parse_json(F.when(left.isNotNull() & right.isNotNull(), merge_text(left, right, add_keys, merge_none)))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(merged)


def replace_strings(value: Column, old: str, new: str) -> Column:
    """Replace a substring in every string value at any depth; keys and other types stay.

    The JSON text is cut into strings and the rest; a string that no colon follows is a value.
    """
    plain = old.isascii() and old.isprintable() and not set(old) & set('"\\/')
    if old == "":
        return value

    def changed(token: Column) -> Column:
        text = F.variant_get(F.parse_json(token), "$", "string")
        return F.when(token.startswith('"') & token.endswith('"'), _quoted(F.replace(text, F.lit(old), F.lit(new)))).otherwise(token)

    def walk(text: Column) -> Column:
        done = F.array_join(F.transform(
            F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
            lambda t: F.when(t.contains(old), changed(t)).otherwise(t) if plain else changed(t)), "")
        # texts without it are not cut at all; escapes may hide one that is not plain
        return F.when(text.contains(old), done).otherwise(text) if plain else done

    return F.parse_json(_let(F.to_json(value), walk))


def lookup(json_text: Column, path: str) -> Column:
    """Value at a dotted path, NULL when any step is missing."""
    return F.get_json_object(json_text, "$" + "".join(f"['{step}']" for step in path.split(".")))


def nested_matches(value: Column, path: Sequence[str], wanted: object) -> Column:
    """True when the value at ``path`` passes the filter.

    ``False`` also matches null, ``True`` matches every value that is present and not null. A
    missing key and a null in the middle of the path do not match.
    """
    for step in path:
        value = F.element_at(as_object(value), F.lit(step))
    kind = _kind(value)
    is_null = kind == "VOID"
    number = F.when(kind.isin(*_NUMERIC) | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    if wanted is True:
        hit = ~is_null
    elif wanted is False:
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        hit = is_null | flag.eqNullSafe(F.lit(False)) | number.eqNullSafe(F.lit(0.0))
    elif wanted is None:
        hit = is_null
    elif isinstance(wanted, (int, float)):
        hit = number.eqNullSafe(F.lit(float(wanted)))
    else:
        hit = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(str(wanted)))
    return F.coalesce(value.isNotNull() & hit, F.lit(False))


def compact_json(fields: dict[str, Column], keep_null: dict[str, Column] | None = None) -> Column:
    """JSON object without null members, but with ``keep_null`` names written as null where the
    condition holds (a field that was set to null on purpose)."""
    text = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})
    for name, condition in (keep_null or {}).items():
        body = F.substring(text, F.lit(2), F.length(text))
        comma = F.when(text == "{}", F.lit("")).otherwise(F.lit(","))
        with_null = F.concat(F.lit('{"' + name + '":null'), comma, body)
        text = F.when(condition & fields[name].isNull(), with_null).otherwise(text)
    return text
