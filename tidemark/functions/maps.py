"""Map columns: key filter, upsert, delete, key styles, unknown fields, variables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_attributes(attributes: Column, valid_keys: Sequence[str] = ()) -> Column:
    """Keep valid keys (none given keeps all) and the first item of each value list."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    kept = F.coalesce(attributes, empty)
    if valid_keys:
        kept = F.map_filter(kept, lambda k, _v: k.isin(*valid_keys))
    return F.transform_values(kept, lambda _k, v: F.try_element_at(v, F.lit(1)))


def put(attributes: Column, key: str, value: Column) -> Column:
    """Set one key."""
    rest = F.map_filter(attributes, lambda k, _v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def remove(attributes: Column, key: str) -> Column:
    """Drop one key; ask ``map_contains_key`` first to learn whether it was there."""
    return F.map_filter(attributes, lambda k, _v: k != key)


def snake(name: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def camel_name(name: str) -> str:
    """snake_case to camelCase for a Python string."""
    return re.sub(r"_([a-z0-9])", lambda m: m.group(1).upper(), name)


def snake_name(name: str) -> str:
    """camelCase to snake_case for a Python string."""
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def resolve_key(record: Column, name: str, alias: str | None = None) -> Column:
    """Value of a field under any of its spellings: alias, snake form, camel form."""
    spellings = [s for s in (alias, name, snake_name(name), camel_name(name)) if s]
    return F.coalesce(*[F.try_element_at(record, F.lit(s)) for s in dict.fromkeys(spellings)])


def snake_keys(record: Column) -> Column:
    """All keys in snake_case; a key that already is in that form wins over a renamed one."""
    entries = F.map_entries(record)
    exact = F.filter(entries, lambda e: e["key"] == snake(e["key"]))
    renamed = F.filter(entries, lambda e: e["key"] != snake(e["key"]))
    ordered = F.concat(exact, renamed)
    names = F.transform(ordered, lambda e: snake(e["key"]))
    unique = F.filter(ordered, lambda e, i: F.array_position(names, snake(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(unique, lambda e: F.struct(snake(e["key"]), e["value"])))


def extra_fields(record: Column, known: Sequence[str]) -> Column:
    """The members that are outside the schema."""
    return F.map_filter(record, lambda k, _v: ~k.isin(*known))


def with_extra(core: Column, extra: Column) -> Column:
    """Write rescued members back to the top level."""
    return F.map_concat(core, F.map_filter(extra, lambda k, _v: ~F.map_contains_key(core, k)))


# The only configuration keys that become variables.
VARIABLE_KEYS = ("name", "port", "subdomain")


def variables(prefix: Column, config: Column) -> Column:
    """Array of (name, value) variables from the first level of a configuration map.

    Nested values are taken as text, so deeper levels give no variables.
    """
    picked = F.filter(F.map_entries(config), lambda e: e["key"].isin(*VARIABLE_KEYS))
    return F.transform(
        picked,
        lambda e: F.struct(
            F.upper(F.translate(F.concat(prefix, F.lit("_"), e["key"]), "-", "_")).alias("name"),
            F.coalesce(e["value"], F.lit("None")).alias("value"),
        ),
    )
