"""Parent-child links to full hierarchies.

Splitters are the roots and the nodes whose hash is 0 modulo ``SPACING``. Every node is walked to its next splitter, by
pointer doubling, so a walk of length w takes log2(w) joins. The splitters with their next splitters are the reduced
pointer graph, about 1/SPACING of the nodes; it is solved the same way, and each node adds its walk to its splitter's
result. A round in which no walk ends proves that all that are left run in circles: of the finite walks that are left,
the shortest would have ended. So nodes on or below a loop are known exactly, whether it holds a splitter or not, and are
solved apart, with the minimum over the loop.

A node below a loop has a path too, from the first node of the loop that its parents lead to, which is a loop node's own
path. These paths are those of the trees that are left when the nodes of loops lose their parents. The places of nodes
on their loop come from the loop cut open above its root; with them every pair round the loop has its distance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..staging import Stage
from .orphans import quote_targets

SPACING = 8


def _double(stage: Stage, walk: DataFrame, with_path: bool) -> DataFrame:
    """Jump until every walk has ended or no walk ends any more. Columns node, ptr, dist, fin and, if asked for, seg.

    ``seg`` holds the nodes from ``node`` up to, without, ``ptr``.
    """
    left = walk.where("not fin").count()
    while left:
        to = walk.select(
            F.col("node").alias("_n"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("fin").alias("_f"),
            *([F.col("seg").alias("_s")] if with_path else []),
        )
        going = walk.where("not fin").join(to, F.col("ptr") == F.col("_n")).select(
            "node",
            F.col("_p").alias("ptr"),
            (F.col("dist") + F.col("_d")).alias("dist"),
            F.col("_f").alias("fin"),
            *([F.concat("seg", "_s").alias("seg")] if with_path else []),
        )
        new = stage.cut(walk.where("fin").unionByName(going))
        now = new.where("not fin").count()
        stage.drop(walk)
        walk = new
        if now == left:
            break
        left = now
    return walk


def _loops(stage: Stage, edges: DataFrame, order: str) -> DataFrame:
    """node, root, on of nodes on or below loops; ``edges`` is closed: the parent of a node of it is in it.

    After 2^k jumps a pointer is on its loop. For a node of the loop the minimum over 2^k steps is that of the loop. As
    many jumps take the nodes of a loop to all nodes of it, so those that are pointed at then are the nodes on loops.
    """
    n = edges.count()
    if not n:
        return edges.select("node", F.col("node").alias("root"), F.lit(True).alias("on"))
    w = edges.select("node", F.col("parent").alias("ptr"), F.struct(F.col(order), F.col("node").alias("k")).alias("low"))
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        to = w.select(F.col("node").alias("_n"), F.col("ptr").alias("_p"), F.col("low").alias("_l"))
        new = stage.cut(
            w.join(to, F.col("ptr") == F.col("_n")).select(
                "node", F.col("_p").alias("ptr"), F.least("low", "_l").alias("low")
            )
        )
        stage.drop(w)
        w = new
    on = w.select(F.col("node").alias("_n"), F.col("low.k").alias("root"))
    ring = w.select(F.col("ptr").alias("node")).distinct().withColumn("on", F.lit(True))
    return w.join(on, F.col("ptr") == F.col("_n")).join(ring, "node", "left").select(
        "node", "root", F.coalesce("on", F.lit(False)).alias("on")
    )


def _loop_paths(spark: SparkSession, stage: Stage, circular: DataFrame, loops: DataFrame, order: str) -> DataFrame:
    """node, root, path, turn of nodes on or below loops: see ``solve``."""
    at = stage.cut(circular.join(loops, "node"))
    if not at.limit(1).count():
        return at.select("node", "root", F.array("node").alias("path"), F.lit(0).cast("long").alias("turn"))
    opened = at.where("on").select("node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("parent"), order)
    turns = solve(spark, opened, order).select(F.col("node").alias("_e"), F.col("root").alias("_r"), F.col("depth").alias("turn"))
    trees = at.select("node", F.when(~F.col("on"), F.col("parent")).alias("parent"), order)
    below = solve(spark, trees, order, True).select("node", F.col("root").alias("_e"), "path")
    return below.join(turns, "_e").select("node", F.col("_r").alias("root"), "path", "turn")


def solve(spark: SparkSession, edges: DataFrame, order: str = "num", with_path: bool = False) -> DataFrame:
    """node, root, depth (and path, from the root to the node, and turn) of every node of ``edges``: node, parent, ``order``.

    One row for each node; a null parent, or one that is no node, makes a root, of depth 0. On or below a loop the depth
    is -1, the root is the loop's node of the smallest ``order``, and the path starts at the first node of the loop that
    is met on the way up, so a node of the loop is a path of its own. ``turn`` is the distance of that first node from
    the root, round the loop, and null in trees. Repeated equal rows count once; of differing ones the smallest parent
    is taken. Null nodes take no part. An empty table gives an empty one.
    """
    stage = Stage(spark, "hierarchy")
    seg = lambda c: [F.array(c).alias("seg")] if with_path else []
    flat = edges.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), F.min(order).alias(order))
    known = flat.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    flat = flat.join(known, "parent", "left").select(
        "node", F.when(F.col("known"), F.col("parent")).alias("parent"), order
    )
    flat = stage.cut(flat.withColumn("stop", F.col("parent").isNull() | (F.pmod(F.xxhash64("node"), F.lit(SPACING)) == 0)))

    # the walk of every node that has a parent to its next splitter
    stops = flat.where("stop").select(F.col("node").alias("parent"), F.lit(True).alias("at"))
    first = flat.where("parent is not null").join(stops, "parent", "left").select(
        "node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.coalesce("at", F.lit(False)).alias("fin"),
        *seg("node"),
    )
    walk = _double(stage, stage.cut(first), with_path)

    # the reduced graph of the splitters that have one above them
    roots = flat.where("parent is null").select(F.col("node").alias("ptr"), F.lit(True).alias("at"))
    inner = flat.where("stop and parent is not null").select("node")
    reduced = walk.where("fin").join(inner, "node", "left_semi").join(roots, "ptr", "left").select(
        "node", "ptr", "dist", F.coalesce("at", F.lit(False)).alias("fin"), *(["seg"] if with_path else [])
    )
    reduced = _double(stage, stage.cut(reduced), with_path)

    # what each splitter adds to the walks that end at it
    none = F.array().cast("array<string>")
    top = flat.where("parent is null").select(
        F.col("node").alias("ptr"), F.col("node").alias("root"), F.lit(0).cast("long").alias("up"),
        *([none.alias("above")] if with_path else []),
    ).unionByName(
        reduced.where("fin").select(
            F.col("node").alias("ptr"), F.col("ptr").alias("root"), F.col("dist").alias("up"),
            *([F.col("seg").alias("above")] if with_path else []),
        )
    )
    below = walk.where("fin").join(top, "ptr").select(
        "node", "root", (F.col("dist") + F.col("up")).alias("depth"),
        *([F.reverse(F.concat("seg", "above", F.array("root"))).alias("path")] if with_path else []),
    )
    solved = flat.where("parent is null").select(
        "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"),
        *([F.array("node").alias("path")] if with_path else []),
    ).unionByName(below)
    solved = stage.cut(solved)
    circular = flat.join(solved.select("node"), "node", "left_anti").select("node", "parent", order)
    circular = stage.cut(circular)
    loops = _loops(stage, circular, order)
    stage.drop(walk, reduced)
    if with_path:
        loops = _loop_paths(spark, stage, circular, loops, order)
        solved = solved.withColumn("turn", F.lit(None).cast("long"))
    return solved.unionByName(
        loops.select("node", "root", F.lit(-1).cast("long").alias("depth"), *(["path", "turn"] if with_path else []))
    )


def resto_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hierarchy, key, parent, num: the raw records and what they answer to, of each record's first capture."""
    body = F.col("body")
    one = tables.load(spark, sf_dir, "lynx_posts").select(
        F.col("site_id"), F.lower(F.trim("board")).alias("code"),
        tables.native_number(F.get_json_object(body, "$.no")).alias("number"),
        tables.native_number(F.get_json_object(body, "$.resto")).alias("resto"), "fetched_at", "capture_id",
    )
    return (
        one.select(
            tables.node_key(F.col("site_id"), F.col("code"), F.col("number")).alias("key"),
            tables.node_key(F.col("site_id"), F.col("code"), F.when(F.col("resto") != "0", F.col("resto"))).alias("parent"),
            "number", "fetched_at", "capture_id",
        )
        .where("key is not null")
        .groupBy("key")
        .agg(F.min_by("parent", F.struct("fetched_at", "capture_id")).alias("parent"), F.min("number").alias("number"))
        .select(F.lit("resto").alias("hierarchy"), "key", "parent", _number("number"))
    )


def quote_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hierarchy, key, parent, num: the posts of quotes that find their post; the parent is the smallest quoted id."""
    placed = tables.placed_posts(spark, sf_dir)
    own = tables.node_key(F.col("site_id"), F.col("code"), F.col("number"))
    refs = quote_targets(spark, sf_dir, placed).where("key is not null and own_key is not null")
    by_key = placed.groupBy(own.alias("key")).agg(F.min("post_id").alias("to_id")).where("key is not null")
    # each find makes two nodes: the quoting post with a candidate for its parent, and the quoted post without one
    node = lambda key, parent, to_id, number: F.struct(key.alias("key"), parent.alias("parent"), to_id.alias("to_id"), number.alias("number"))
    nodes = refs.join(by_key, "key").select(
        F.inline(
            F.array(
                node(F.col("own_key"), F.col("key"), F.col("to_id"), F.col("number")),
                node(F.col("key"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.element_at(F.split("key", "/"), -1)),
            )
        )
    )
    return (
        nodes.groupBy("key")
        .agg(F.min_by("parent", "to_id").alias("parent"), F.min("number").alias("number"))
        .select(F.lit("quote").alias("hierarchy"), "key", "parent", _number("number"))
    )


def _number(c: str):
    """Native numbers are ordered by length, then digits, which is their order as numbers of any length."""
    return F.struct(F.length(c).alias("digits"), F.col(c).alias("number")).alias("num")


def reply_trees(spark: SparkSession, sf_dir: str, with_path: bool = False) -> DataFrame:
    """hierarchy, node_key, root_key, depth (and path, turn): both hierarchies, solved in one run, as their keys carry the kind."""
    tag = lambda c: F.concat("hierarchy", F.lit("|"), F.col(c))
    edges = resto_edges(spark, sf_dir).unionByName(quote_edges(spark, sf_dir)).select(
        tag("key").alias("node"), tag("parent").alias("parent"), "num"
    )
    bare = lambda c: F.substring_index(c, "|", -1)
    return solve(spark, edges, "num", with_path).select(
        F.substring_index("node", "|", 1).alias("hierarchy"), bare("node").alias("node_key"), bare("root").alias("root_key"), "depth",
        *([F.transform("path", lambda k: F.substring_index(k, "|", -1)).alias("path"), F.col("turn")] if with_path else []),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """hierarchy, node_key, descendant_key, distance: every pair of a node and a node below it, from the paths.

    The nodes of a loop are above each other and above all that hangs below the loop. Each pair comes once, with its
    shortest distance; a node is no descendant of itself. Paths without ``turn`` are those of trees.
    """
    length = F.size("path") - 1
    inner = paths.where(length > 0).select(
        "hierarchy", F.col("node_key").alias("descendant_key"), length.cast("long").alias("length"), F.posexplode("path").alias("at", "node_key")
    ).where("at < length").select(
        "hierarchy", "node_key", "descendant_key", (F.col("length") - F.col("at")).alias("distance")
    )
    if "turn" not in paths.columns:
        return inner
    looped = paths.where("turn is not null")
    ring = looped.where(length == 0).select("hierarchy", "root_key", "node_key", F.col("turn").alias("place"))
    sizes = ring.groupBy("hierarchy", "root_key").agg(F.count("*").alias("n"))
    around = (
        looped.select("hierarchy", "root_key", F.col("node_key").alias("descendant_key"), length.cast("long").alias("length"), "turn")
        .join(sizes.where("n > 1"), ["hierarchy", "root_key"])
        .join(ring, ["hierarchy", "root_key"])
        .where("place <> turn")
        .select("hierarchy", "node_key", "descendant_key", (F.col("length") + F.pmod(F.col("turn") - F.col("place"), F.col("n"))).alias("distance"))
    )
    return inner.unionByName(around)
