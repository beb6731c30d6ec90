"""File sets: result messages and layered JSON files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.jsontree import merge_text

# Fixed value: a result file above this size is also reported.
RESULT_CAP = 2**20
# Folders that are not merged (as part of a folder's path), and files that are not.
SKIPPED_FOLDERS = ("node_modules", ".git", ".tox")
SKIPPED_FILES = ("node_modules",)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One (path, content, raw, status) row per file below a folder. A file that is not UTF-8 has the
    status ``not_text``, no ``content`` and its bytes in ``raw``; no file is left out, and one that
    can not be read fails the job."""
    binary = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
    is_text = F.is_valid_utf8(F.col("content").cast("string"))
    return binary.select(
        "path",
        F.when(is_text, F.col("content").cast("string")).alias("content"),
        F.col("content").alias("raw"),
        F.when(is_text, "ok").otherwise("not_text").alias("status"),
    )


def result_messages(files: DataFrame, path: Column, content: Column, cap: int = RESULT_CAP) -> DataFrame:
    """The message ``{basename: content}`` of every file, whatever its size, and for a file above the
    cap also the notice ``{path: "Error: size exceeded"}`` with the status ``too_large``."""
    large = F.octet_length(content) > cap
    name = F.substring_index(path, "/", -1)

    def message(status: str, key: Column, body: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.to_json(F.create_map(key, body)).alias("value"))

    sent = message("ok", name, content)
    notice = message("too_large", path, F.lit("Error: size exceeded"))
    both = F.when(large, F.array(notice, sent)).otherwise(F.array(sent))
    return files.select(path.alias("path"), F.explode(both).alias("m")).select("path", "m.status", "m.value")


def layered_targets(files: DataFrame, envs: Sequence[str]) -> DataFrame:
    """Give each (root, file, content) row its target file and rank.

    A file goes to the target of its own name. ``name-env.json`` next to ``name.json`` also goes
    to ``name.json``, after the base file of that root, in the order of ``envs``.
    """
    body = ["content", *(["raw"] if "raw" in files.columns else [])]
    own = files.select(
        "file", *body, F.struct(F.col("root").alias("root"), F.lit(0).alias("env")).alias("rank")
    )
    if not envs:
        return own
    pattern = r"^(.*)-(" + "|".join(re.escape(e) for e in envs) + r")(\.json)$"
    env = F.regexp_extract("file", pattern, 2)
    overlays = files.filter(env != "").select(
        "root",
        F.concat(F.regexp_extract("file", pattern, 1), F.regexp_extract("file", pattern, 3)).alias("file"),
        *body,
        F.array_position(F.array(*[F.lit(e) for e in envs]), env).cast("int").alias("env"),
    )
    applied = overlays.join(files.select("root", "file"), ["root", "file"], "left_semi").select(
        "file", *body, F.struct(F.col("root"), F.col("env")).alias("rank")
    )
    return own.unionByName(applied)


def mergeable(files: DataFrame, skipped_folders: Sequence[str] = SKIPPED_FOLDERS, skipped_files: Sequence[str] = SKIPPED_FILES) -> DataFrame:
    """(root, file, ...) rows without those in a skipped folder (its path holds one of the names) and
    without skipped files. ``file`` is the path below the root."""
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    name = F.substring_index("file", "/", -1)
    inside = reduce(or_, [folder.contains(part) for part in skipped_folders], F.lit(False))
    return files.filter(~inside & ~name.isin(*skipped_files))


def merge_layers(files: DataFrame, envs: Sequence[str] = ()) -> DataFrame:
    """Merge same-named files of several roots; rows are (root number, file, content).

    JSON files merge key by key. An empty layer (null, false, 0, "", [] or {}) changes nothing, nor
    does an environment's overlay that does not parse; another file that does not parse, and any
    other type, replaces the target whole. With a ``raw`` column the last layer's bytes come too.
    A target has one row per root and environment, so the list that is folded is as long as the
    number of layers.
    """
    body = ["content", *(["raw"] if "raw" in files.columns else [])]
    layers = F.sort_array(F.collect_list(F.struct("rank", *body)))
    grouped = layered_targets(files, envs).groupBy("file").agg(layers.alias("layers"))
    contents = F.transform("layers", lambda x: x["content"])

    def fold(done: Column, layer: Column) -> Column:
        new, overlay = layer["content"], layer["rank"]["env"] > 0
        left, right = F.try_parse_json(done), F.try_parse_json(new)
        merged = merge_text(left, right)
        empty = F.to_json(right).isin("null", "false", "0", '""', "[]", "{}")
        keep = F.coalesce(empty, F.lit(False)) | (overlay & right.isNull())
        return F.when(keep, done).when(left.isNull() | right.isNull(), new).otherwise(merged)

    merged = F.aggregate(F.slice("layers", F.lit(2), F.size("layers")), F.element_at(contents, 1), fold)
    is_json = F.lower(F.col("file")).endswith(".json")
    whole = F.element_at(contents, -1)
    raw = [F.element_at("layers", -1)["raw"].alias("raw")] if "raw" in files.columns else []
    return grouped.select(
        "file",
        F.size("layers").alias("n_layers"),
        *raw,
        F.when(is_json, merged).otherwise(whole).alias("content"),
    )
