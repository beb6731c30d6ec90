"""Connected components of a link table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link every neighbour of a node to the smallest of the node and its neighbours.

    The minimum is combined on the map side; the join that brings it back to the links is one that
    AQE can split on the side of the links, so a hub with a third of all links is no single task.
    """
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if both_ways:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) of every linked node; the component is its smallest node.

    ``links`` has two long columns ``u`` and ``v``; direction, repeats and self-links do not matter,
    rows with a null are ignored. A node links to a smaller one in each round, so chains halve; the
    loop ends when a round changes nothing. Every round is a table in the shared folder.
    """
    links = links.filter("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, before = cut_lineage(links), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        state = cut_lineage(_star(_star(state, True), False))
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
