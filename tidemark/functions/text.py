"""String rules: names, references, paths, templates, search, quantities."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier pattern and the registry used when a reference names none.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DEFAULT_REGISTRY = "docker.io"
DEFAULT_TAG = "latest"


def task_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))


def run_family(name: Column) -> Column:
    """Drop the last ``-`` segment; a name without one becomes empty."""
    return F.when(name.contains("-"), F.regexp_replace(name, "-[^-]*$", "")).otherwise(F.lit(""))


def name_of_path(path: Column) -> Column:
    return F.lower(F.translate(path, "/_", ""))


def module_name(name: Column) -> Column:
    return F.translate(name, "-", "_")


def image_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9-]", ""), F.lit("-"))


def reference_parts(reference: Column) -> Column:
    """Registry, name and tag of an image reference."""
    pieces = F.split(reference, ":")
    chunks = F.split(pieces[0], "/")
    has_registry = chunks[0].contains(".")
    rest = F.when(has_registry, F.slice(chunks, F.lit(2), F.size(chunks))).otherwise(chunks)
    return F.struct(
        F.when(has_registry, chunks[0]).otherwise(F.lit(DEFAULT_REGISTRY)).alias("registry"),
        F.array_join(rest, "/").alias("name"),
        F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(DEFAULT_TAG)).alias("tag"),
    )


def path_id(path: Column) -> Column:
    """Second segment of a resource path, NULL when there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(2))


PLACEHOLDER = r"\{\{\s*([\w.]+)\s*\}\}"


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Substitute ``{{ name }}``; names without a value render as empty text.

    The template is cut at its placeholders once, on the driver, and becomes one ``concat``; a
    value that itself looks like a placeholder stays as it is.
    """
    parts = []
    for i, piece in enumerate(re.split(PLACEHOLDER, template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in values:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
    return F.concat(*parts)


def any_contains(columns: Sequence[Column], query: str) -> Column:
    """Case-insensitive substring search over several columns."""
    out = F.lit(False)
    for column in columns:
        out = out | F.coalesce(F.contains(F.lower(column), F.lit(query.lower())), F.lit(False))
    return out


def is_empty(column: Column) -> Column:
    return column.isNull() | (column == "")


def matches_glob(column: Column, pattern: str) -> Column:
    """Shell-style file pattern."""
    return column.rlike("^(?:" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + ")$")


def to_number(value: Column) -> Column:
    """Digits and dots of a text as a number; NULL when they do not form one."""
    return F.regexp_replace(value.cast("string"), "[^0-9.]", "").try_cast("double")


def with_unit(value: Column, unit: str) -> Column:
    """Number and unit; NULL for no value and for zero."""
    number = value.cast("double")
    plain = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.when(number.isNotNull() & (number != 0), F.concat(plain, F.lit(unit)))


def _path_pattern(pattern: str) -> str:
    """Regular expression of the paths that an ignore pattern (without ``!``) matches."""
    folder, body = pattern.endswith("/"), pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        else:
            c, i = (body[i + 1], i + 2) if c == "\\" and i + 1 < len(body) else (c, i + 1)
            out += re.escape(c)
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored_path(path: Column, patterns: Sequence[str]) -> Column:
    """Is a relative path on an ignore list? The last pattern that matches decides.

    ``!`` at the front takes a path back in. A ``/`` at the front or inside ties a pattern to the top
    folder, else it holds in every folder; one at the end matches folders only. ``*`` and ``?`` stay in
    one segment, ``**`` stands for any number of them, ``[a-c]`` and ``[!a-c]`` for one character, and a backslash
    takes the next character as it is. What lies in a matching folder matches too. Empty
    patterns and those that begin with ``#`` count for nothing.
    """
    ignored = F.lit(False)
    for pattern in patterns:
        again = pattern.startswith("!")
        body = pattern[1:] if again else pattern
        if body.strip("/ ") and not pattern.startswith("#"):
            ignored = F.when(path.rlike(_path_pattern(body)), F.lit(not again)).otherwise(ignored)
    return F.coalesce(ignored, F.lit(False))
