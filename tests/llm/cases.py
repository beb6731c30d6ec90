"""Small frames that every operator must take."""

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} then{i}" for i in range(30_000))
ROWS = [
    (1, "A plain text with a few words.\nAnd a second line of it.", "en", "s1", 55),
    (2, None, "en", "s1", None),
    (3, "", None, None, 0),
    (4, " \n\t \x0b\x0c\r ", "en", "s2", 8),
    (5, LONG, "en", "s1", len(LONG)),
    (6, "same text", "xx", "s2", 9),
    (6, "same text", "xx", "s2", 9),
    (7, "same text", "xx", "s3", 9),
    (None, "a text without an id", "en", "s1", 20),
    (None, None, None, None, None),
    (8, "Zweiter Text mit Ümläuten und ß, 中文 😀  doppelt", "de", "s1", 40),
]
# names the operators use themselves
CLASHES = ("row", "version", "score", "f", "kept", "spans", "fp", "node", "shard", "component_id", "bin_id", "cut", "k_id", "w", "key")


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    frame = spark.createDataFrame(ROWS, COLUMNS)
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def empty(spark):
    return odd(spark).limit(0)


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (99, 1, 1), (None, 1, 0), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "same text"), (2, None), (3, ""), (None, "same text"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")
