"""Files as rows: keyword search, bulk replace, line dedup, keep-best, leading runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import matches_glob


def keyword_search(files: DataFrame, content: str, word: str, path: str | None = None, glob: str | None = None) -> DataFrame:
    """Files that contain the word (case-sensitive); text that is not UTF-8 never matches."""
    found = F.is_valid_utf8(F.col(content)) & F.col(content).contains(word)
    if path and glob:
        found = matches_glob(F.col(path), glob) & found
    return files.filter(found)


def bulk_replace(content: Column, path: Column, rules: Sequence[Mapping]) -> Column:
    """Apply the rules in order: where the text contains ``keyword`` (and the path matches one of
    ``patterns``, if given), do the old-to-new replacements one after the other.

    A text that was changed by one rule is what the next one sees. Replacements go line by line,
    so an ``old`` text with a line break never matches.
    """
    for rule in rules:
        hit = content.contains(rule["keyword"])
        if rule.get("patterns"):
            on_path = F.lit(False)
            for pattern in rule["patterns"]:
                on_path = on_path | matches_glob(path, pattern)
            hit = hit & on_path
        changed = content
        for old, new in rule["to_be_replaced"]:
            if "\n" not in old:
                changed = F.replace(changed, F.lit(old), F.lit(new))
        content = F.when(hit, changed).otherwise(content)
    return content


def explode_lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, line) rows; a final line break does not start another line."""
    text = F.col(content)
    text = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def new_lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """Lines that no earlier file (in ``key`` order) has. Repeats inside one file stay.

    The first file of each line comes from a map-side combined minimum. Lines then join back on
    (file, line), so a line that occurs in very many files meets only its first one, and no
    task gets all copies of it.
    """
    lines = explode_lines(files, key, content)
    first = lines.groupBy("line").agg(F.min(key).alias(key))
    return lines.join(first, [key, "line"], "left_semi").select(key, "pos", "line")


def keep_best(rows: DataFrame, name: str, seq: str, skipped: Column, pattern: str | None = None) -> DataFrame:
    """One row per name: the first that is not skipped, else the first."""
    kept = rows if pattern is None else rows.filter(F.col(name).rlike(pattern))
    rest = [c for c in rows.columns if c != name]
    best = kept.groupBy(name).agg(
        F.min_by(F.struct(*rest), F.struct(F.coalesce(skipped, F.lit(False)), F.col(seq))).alias("_b")
    )
    return best.select(name, "_b.*")


def leading_run(rows: DataFrame, key: str, seq: str, holds: Column) -> DataFrame:
    """The rows of each group from the top while ``holds`` is true."""
    stops = rows.filter(~F.coalesce(holds, F.lit(False))).groupBy(key).agg(F.min(seq).alias("_stop"))
    marked = rows.join(stops, key, "left")
    return marked.filter(F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))).drop("_stop")


def argument_names(files: DataFrame, key: str, content: str) -> DataFrame:
    """Names of the leading ``ARG`` lines without a value of each file."""
    lines = F.split(F.col(content), "\n")
    flags = F.transform(lines, lambda line: line.startswith("ARG") & ~line.contains("="))
    stop = F.array_position(flags, False)
    run = F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), (stop - 1).cast("int")))
    named = files.select(key, F.posexplode(run).alias("pos", "line"))
    word = F.try_element_at(F.split(F.btrim("line"), r"\s+"), F.lit(2))
    return named.select(key, "pos", F.translate(F.lower(word), "_", "-").alias("name"))
