"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared to the histograms of
all acceptable documents of its language by the Jensen-Shannon distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import column
from tidemark.session import cut_lineage

# fixed values: frequent function words of four languages
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was",
    "der", "die", "und", "das", "ist", "nicht", "von", "mit",
    "le", "les", "et", "des", "est", "dans", "que", "pour",
    "el", "los", "y", "del", "las", "por", "con", "para",
)
SPACE = r"[\x20\x09-\x0D]++"
SYMBOLS = r"[#*$%&|<>]++"
CLASSES = ("lower", "space", "symbol", "upper", "digit", "mark", "other")


@dataclass(frozen=True)
class Limits:
    """``char_distance`` and ``word_distance`` are Jensen-Shannon distances (0 to 1, base 2) above
    which a document is rejected. A histogram is judged only with at least ``min_chars``
    characters or ``min_words`` words; shorter documents pass that check. References are made from
    documents that pass the base rules with at most ``model_symbols`` symbols per word."""

    base_min_words: int = 50
    model_symbols: float = 0.1
    char_distance: float = 0.19
    word_distance: float = 0.45
    min_chars: int = 300
    min_words: int = 100


def _removed(before: str, after: str) -> Column:
    return (F.length(before) - F.length(after)).cast("long")


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add one struct column ``f``: ``lang``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``chars`` (counts by class) and ``common`` (counts of each
    common word, then of all other words). Null text has no words; null ``lang`` is a language of
    its own. All other columns pass through inside the struct ``row``.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    df = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
        F.coalesce(column(lang_col).cast("string"), F.lit("")).alias("lang"),
        text.alias("t0"),
    )
    # each step takes one class away, so that the later ones see short remainders
    df = df.select(
        "*",
        F.array_remove(F.split("t0", SPACE), "").alias("w"),
        F.filter(F.split("t0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("t0", "[a-z]++", "").alias("t1"),
    )
    df = df.select("*", F.regexp_replace("t1", SPACE, "").alias("t2"), F.size("w").cast("long").alias("n"))
    df = df.select("*", F.regexp_replace("t2", SYMBOLS, "").alias("t3"))
    df = df.select("*", F.regexp_replace("t3", "[A-Z]++", "").alias("t4"))
    df = df.select("*", F.regexp_replace("t4", "[0-9]++", "").alias("t5"))
    df = df.select("*", F.regexp_replace("t5", r"[\x21-\x7E]++", "").alias("t6"))
    keep = F.col("w")
    df = df.select(
        "*",
        F.transform(
            F.slice(keep, 1, F.greatest(F.size(keep) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(keep, i + 1), F.get(keep, i + 2)),
        ).alias("windows"),
        F.filter(keep, lambda x: x.isin(*COMMON_WORDS)).alias("hits"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.select(
        "*",
        # (hash, position) in hash order: repeated windows are neighbours
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
        F.concat(F.lit(" "), F.array_join("hits", "  "), F.lit(" ")).alias("joined"),
    )
    s = F.col("s")
    df = df.select(
        "*",
        F.array_sort(F.transform(
            F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))),
            lambda x: x["i"],
        )).alias("p"),
    )
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    counts = [
        ((F.length("joined") - F.length(F.replace(F.col("joined"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    df = df.select(
        "*",
        _removed("t1", "t2").alias("space"),
        F.array(*counts, F.col("n") - F.size("hits")).alias("common"),
    )
    out = F.struct(
        F.col("lang"),
        F.col("n").alias("n_words"),
        (F.length("t0") - F.col("space")).cast("long").alias("word_chars"),
        _removed("t2", "t3").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array(
            _removed("t0", "t1"), F.col("space"), _removed("t2", "t3"), _removed("t3", "t4"),
            _removed("t4", "t5"), _removed("t5", "t6"), F.length("t6").cast("long"),
        ).alias("chars"),
        F.col("common"),
    )
    return df.select("row", out.alias("f"))


def _base_failed(limits: Limits) -> Column:
    f = F.col("f")
    return (f["n_words"] < limits.base_min_words) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def references(featured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per language: the shares over all documents fit to be a model."""
    sizes = {"chars": len(CLASSES), "common": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.col("f")[k][i]).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    f = F.col("f")
    fit = ~_base_failed(limits) & (f["n_symbols"] <= limits.model_symbols * f["n_words"])
    out = featured.filter(fit).groupBy(F.col("f.lang").alias("lang")).agg(*sums)
    return out.select(
        "lang", *[shares(F.array(*[F.col(f"{k}{i}") for i in range(n)])).alias(f"ref_{k}") for k, n in sizes.items()]
    )


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; null where there are none."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(F.arrays_zip(counts.alias("x"), F.array_repeat(total, F.size(counts)).alias("n")), lambda z: z["x"] / z["n"]))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null where either is null."""
    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    parts = F.zip_with(left, right, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)) / 2)


def verdict(featured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``char_distance``, ``word_distance``, ``base_failed`` and ``kept`` to featured rows.

    ``featured`` is read twice: write it first (``cut_lineage``). A language without any acceptable
    document has no reference, and its documents are judged by the base rules alone.
    """
    f = F.col("f")
    # written first: the planner then knows that it is small, and whole rows are not shuffled to meet it
    known = cut_lineage(references(featured, limits).withColumnRenamed("lang", "ref_lang"))
    df = featured.join(known, f["lang"] == F.col("ref_lang"), "left")
    df = df.select(
        "row", "f",
        distance(shares(f["chars"]), F.col("ref_chars")).alias("char_distance"),
        distance(shares(f["common"]), F.col("ref_common")).alias("word_distance"),
        _base_failed(limits).alias("base_failed"),
    )
    chars = f["word_chars"] + f["chars"][1]
    far = (
        ((chars >= limits.min_chars) & F.coalesce(F.col("char_distance") > limits.char_distance, F.lit(False)))
        | ((f["n_words"] >= limits.min_words) & F.coalesce(F.col("word_distance") > limits.word_distance, F.lit(False)))
    )
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def assess(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang",
           carry: Sequence[str] | None = None) -> DataFrame:
    """Features and verdict of every document; ``carry`` names the columns kept in ``row``.

    An empty table gives an empty result; repeated rows are judged each.
    """
    featured = features(docs, text_col, lang_col)
    if carry is not None:
        featured = featured.select(F.struct(*[F.col("row").getField(c).alias(c) for c in carry]).alias("row"), "f")
    return verdict(cut_lineage(featured), limits)
