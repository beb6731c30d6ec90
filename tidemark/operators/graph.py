"""Dependency sets: closure, levels, integrity, image marks, content fingerprints.

Iterative operators keep per round only what that round added, and write it to the shared folder,
so that lineage stays short and the planner knows its size: a small frontier is broadcast to the
edges, which then are not shuffled, a large one joins by sort-merge with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.text import ignored_path
from tidemark.session import Rounds, cut_lineage


def closure(seeds: DataFrame, edges: DataFrame, implied: DataFrame | None = None) -> DataFrame:
    """All nodes reachable from ``seeds`` (node) over ``edges`` (src, dst), with the round that
    added them. Names that are not in the table stay in the set.

    ``implied`` holds (src, dst) pairs that count as edges too, e.g. the accounts service for
    every secured application.
    """
    links = edges.select("src", "dst")
    if implied is not None:
        links = links.unionByName(implied.select("src", "dst"))
    # every round reads the edges: keep them as a table of two columns
    links = cut_lineage(links)
    start = seeds.select("node").distinct()
    reached = Rounds(start.sparkSession, start.schema)
    frontier = reached.add(start)
    while not frontier.isEmpty():
        found = frontier.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node"))
        frontier = reached.add(found.distinct().join(reached.all().select("node"), "node", "left_anti"))
    return reached.all()


def included(
    seeds: DataFrame, edges: DataFrame, excluded: DataFrame, known: DataFrame
) -> DataFrame:
    """Included applications, and images that are only needed to build them.

    Applications: closure over hard and soft edges, less the excluded. Build images: closure over
    all edges. Of a known name: ``app`` when it is included, else ``build_only`` unless excluded.

    """
    return (
        _needed(seeds, edges).join(known.select("node"), "node", "left_semi")
        .join(excluded, "node", "left_anti")
        .select("node", F.when(F.col("app") == 1, "app").otherwise("build_only").alias("label"))
    )


def _needed(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, app) of everything reached: ``app`` is 1 where a way without a build edge leads to it.

    One loop finds both: a node carries whether there is such a way, and goes into the frontier
    again when one is found after another way.
    """
    kept = F.col("kind").isin("hard", "soft").cast("int").alias("runtime")
    links = cut_lineage(edges.filter(F.col("kind").isin("hard", "soft", "build")).select("src", "dst", kept))
    start = seeds.select("node").distinct().withColumn("app", F.lit(1))
    reached = Rounds(start.sparkSession, start.schema)
    frontier = reached.add(start)
    while not frontier.isEmpty():
        found = frontier.withColumnRenamed("node", "src").join(links, "src").groupBy(F.col("dst").alias("node")).agg(
            F.max(F.col("app") * F.col("runtime")).alias("app"))
        before = reached.all().groupBy("node").agg(F.max("app").alias("before"))
        news = found.join(before, "node", "left").filter("before is null or app > before")
        frontier = reached.add(news.select("node", "app"))
    return reached.all().groupBy("node").agg(F.max("app").alias("app"))


def included_images(seeds: DataFrame, edges: DataFrame, excluded: DataFrame, apps: DataFrame, images: DataFrame) -> DataFrame:
    """(name, app, image) of the images to build for the included applications.

    ``apps``: node, image (NULL: none of its own). ``images``: app, name, image of the images inside an
    application. An included application brings all images inside it. One that is only needed for a
    build brings its own image, and of those inside it the ones that are needed too. A needed name that is
    no application is looked up as an image inside the one that its first segment (up to ``-``) names,
    which is then treated the same way. Names on the exclude list are not built, and such an application
    is not included either. ``excluded``: node. Every name comes once, for the lowest application.
    """
    needed = cut_lineage(_needed(seeds, edges))
    names = needed.select(F.col("node").alias("name"))
    known = needed.join(apps, "node")
    full = known.filter("app = 1").join(excluded, "node", "left_anti").select(F.col("node").alias("app"))
    partly = known.join(full.select(F.col("app").alias("node")), "node", "left_anti")
    prefix = F.substring_index("node", "-", 1)
    inside = needed.join(apps.select("node"), "node", "left_anti").filter(F.col("node").contains("-")).select(prefix.alias("app"))
    owners = partly.select(F.col("node").alias("app")).union(inside.join(apps.select(F.col("node").alias("app")), "app")).distinct()
    found = (
        images.join(full, "app").select("name", "app", "image")
        .union(partly.filter("image is not null").select(F.col("node").alias("name"), F.col("node").alias("app"), "image"))
        .union(images.join(owners, "app").join(names, "name", "left_semi").select("name", "app", "image"))
    )
    kept = found.join(excluded.select(F.col("node").alias("name")), "name", "left_anti")
    return kept.groupBy("name").agg(F.min(F.struct("app", "image")).alias("m")).select("name", "m.app", "m.image")


def _waiting(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the number ``need`` of their known dependencies (NULL: none), and the edges to these."""
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    degree = known.groupBy("src").agg(F.count("*").alias("need"))
    todo = nodes.withColumnRenamed("node", "src").join(degree, "src", "left")
    return todo, cut_lineage(known.join(todo.filter(F.col("need").isNotNull()), "src"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parallel level of each node: the round in which its dependencies are all placed.

    Nodes on or behind a cycle never are; they come out with the status ``cyclic``. The first round
    places nodes without known dependencies. Each further round sends the new nodes along the
    edges into them and counts what arrived per waiting node. All rounds together send each edge
    once; what is carried from round to round is one counted row per waiting node.
    """
    names = nodes.select("node").distinct()
    todo, links = _waiting(names, edges.select("src", "dst").distinct())
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    state = todo.filter(F.col("need").isNull()).select(F.col("src").alias("node"), zero.alias("need"), zero.alias("have"))
    complete = F.col("have") == F.col("need")
    rounds = Rounds(names.sparkSession, state.schema)
    state = rounds.add(state)
    placed = state.filter(complete).select("node")
    while not placed.isEmpty():
        arrived = placed.withColumnRenamed("node", "dst").join(links, "dst").select(F.col("src").alias("node"), "need", one.alias("have"))
        state = rounds.add(arrived.unionByName(state.filter(~complete)).groupBy("node", "need").agg(F.sum("have").alias("have")))
        placed = state.filter(complete).select("node")
    done = rounds.all().filter(complete).select("node", F.col("round").alias("level"))
    return names.join(done, "node", "left").withColumn("status", F.when(F.col("level").isNull(), "cyclic").otherwise("placed"))


TAG_CHUNK = 1024


def chained_tags(nodes: DataFrame, edges: DataFrame, chunk: int = TAG_CHUNK) -> DataFrame:
    """Tag of each node: SHA-1 of its own tag and the tags of its dependencies in ``pos`` order.

    ``nodes``: node, own. ``edges``: src, dst, pos (from 0). Unknown dependencies add nothing. Positions are
    cut in chunks of ``chunk``: the tags of a node whose known dependencies are all in one chunk follow its own tag
    as they are; of a node with more chunks the SHA-1 of each chunk's tags does, in their order. So a
    row holds at most ``chunk`` tags, and a node with very many dependencies is the work of many tasks.

    Round by round a node is placed when the tags of all its known dependencies have arrived; what
    waits is one row per node and chunk.
    """
    links = edges.select("src", "dst", F.col("pos").cast("int").alias("pos"))
    todo, links = _waiting(nodes.select("node", "own"), links)
    links = links.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("int"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<pos:int,tag:string>>")
    keys = ["node", "own", "need", "chunk"]
    state = todo.filter(F.col("need").isNull()).select(
        F.col("src").alias("node"), "own", zero.alias("need"), F.lit(0).alias("chunk"), none.alias("deps"), F.lit(False).alias("waits"))
    rounds = Rounds(nodes.sparkSession, state.schema)
    done = Rounds(nodes.sparkSession, StructType([nodes.schema["node"], StructField("tag", StringType())]))

    def finish(complete: DataFrame) -> DataFrame:
        text = F.array_join(F.transform(F.sort_array("deps"), lambda x: x["tag"]), "")
        parts = F.sort_array(F.collect_list(F.struct("chunk", text.alias("text"))))
        joined = F.when(F.size("parts") == 1, F.col("parts")[0]["text"]).otherwise(
            F.array_join(F.transform("parts", lambda p: F.sha1(p["text"])), ""))
        return complete.groupBy("node", "own").agg(parts.alias("parts")).select("node", F.sha1(F.concat("own", joined)).alias("tag"))

    state = rounds.add(state)
    placed = done.add(finish(state.filter("not waits")))
    while not placed.isEmpty():
        arrived = placed.withColumnRenamed("node", "dst").join(links, "dst").select(
            F.col("src").alias("node"), "own", "need", "chunk", F.array(F.struct("pos", "tag")).alias("deps"))
        rows = arrived.unionByName(state.filter("waits").drop("waits")).groupBy(*keys).agg(F.flatten(F.collect_list("deps")).alias("deps"))
        rows = cut_lineage(rows)
        have = rows.groupBy("node").agg(F.sum(F.size("deps")).alias("have"))
        state = rounds.add(rows.join(have, "node").withColumn("waits", F.col("have") < F.col("need")).drop("have"))
        placed = done.add(finish(state.filter("not waits")))
    return done.all().select("node", "tag", F.col("round").alias("level"))


def fingerprint(files: DataFrame, group: str, path: str, content: str, ignore: Sequence[str] = ()) -> DataFrame:
    """SHA-1 over the files of each group; it changes with any path or content.

    ``ignore`` is an ordered list of patterns of paths to leave out (see ``ignored_path``). The hash is a tree, so that no task ever holds
    all files of a group: files with the same first five hex digits of their path hash make a
    leaf, leaves with the same first two digits a branch, the branches the root.
    """
    kept = files.filter(~ignored_path(F.col(path).cast("string"), ignore)) if ignore else files
    name = F.col(path).cast("string")
    entry = F.concat(name, F.lit(":"), F.sha1(F.col(content)))
    leaves = kept.select(group, F.substring(F.sha1(name), 1, 5).alias("k"), entry.alias("e"))
    for digits in (2, 0):
        joined = F.sha1(F.array_join(F.sort_array(F.collect_list("e")), "\n"))
        level = leaves.groupBy(group, "k").agg(joined.alias("h"))
        leaves = level.select(
            group, F.substring("k", 1, digits).alias("k"), F.concat("k", F.lit(":"), "h").alias("e")
        )
    root = F.sha1(F.array_join(F.sort_array(F.collect_list("e")), "\n"))
    return leaves.groupBy(group).agg(root.alias("fingerprint"))


def broken_references(edges: DataFrame, apps: DataFrame, images: DataFrame) -> DataFrame:
    """Dependencies that do not exist. A missing soft one is a warning, the others are errors; a
    build dependency may also be an image."""
    known = apps.select(F.col("node").alias("dst")).distinct()
    buildable = known.unionByName(images.select(F.col("node").alias("dst"))).distinct()
    build = F.coalesce(F.col("kind") == "build", F.lit(False))
    bad = edges.filter(~build).join(known, "dst", "left_anti").unionByName(
        edges.filter(build).join(buildable, "dst", "left_anti")
    )
    severity = F.when(F.col("kind") == "soft", "warning").otherwise("error")
    return bad.select("src", "dst", "kind", severity.alias("severity"))


def mark_existing(references: DataFrame, registry: DataFrame) -> DataFrame:
    """``_EXISTS`` or ``_NEW`` per image reference; ``registry`` has (registry, name, tag)."""
    keys = ["registry", "name", "tag"]
    have = registry.select(*keys).distinct().withColumn("_h", F.lit(True))
    marked = references.join(have, keys, "left")
    return marked.withColumn("mark", F.when(F.col("_h"), "_EXISTS").otherwise("_NEW")).drop("_h")
