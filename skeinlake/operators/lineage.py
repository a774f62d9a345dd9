"""Copies of files across boards, near copies by perceptual hash, their clusters, and threads that continue others."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc, text, vectors
from ..staging import Stage
from .archive import first_per


def exact_crossposts(uses: DataFrame) -> DataFrame:
    """Blobs used by more than one post or on more than one board: file_hash, their posts, boards, sites, first and last time.

    ``uses``: file_hash, post_id, board_id, site_id, ts.
    """
    sets = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("post_id", "board_id", "site_id")]
    return (
        uses.groupBy("file_hash")
        .agg(*sets, F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
        .where((F.size("post_ids") > 1) | (F.size("board_ids") > 1))
        .withColumn("spread_count", F.size("post_ids").cast("long"))
    )


def code_classes(codes: DataFrame, key: str = "blob_id", code: str = "code") -> DataFrame:
    """rep, member: the class of each key that has a code, named by the smallest key of the same code."""
    own = codes.select(F.col(key).alias("member"), F.col(code).alias("c")).where("c is not null and member is not null").distinct()
    return own.join(own.groupBy("c").agg(F.min("member").alias("rep")), "c").select("rep", "member")


def _bands(n: int, within: int, width: int) -> tuple[int, int]:
    """Bands and flips for codes of ``width`` bits in use: as few flips as leave a bucket few codes, by the pigeonhole."""
    for flips in range(3):
        bands = -(-(within + 1) // (flips + 1))
        if width // bands >= math.log2(max(n, 2)) - 3:
            break
    return bands, flips


def near_pairs(codes: DataFrame, within: int = 8, key: str = "blob_id", code: str = "code") -> DataFrame:
    """a, b, distance: pairs of classes of equal codes (64 bits, as longs) that differ in up to ``within`` bits; a < b.

    Classes are named as in ``code_classes``, which has their members. The bits in which codes differ at all are cut into
    bands, and one side also asks for the values that are a few flips away, so that (bands) * (flips + 1) > within; by the
    pigeonhole principle a pair within reach meets in one of them. Bands are the wider the more codes there are. Null
    keys and codes take no part.
    """
    own = codes.select(F.col(key).alias("k"), F.col(code).alias("c")).where("c is not null and k is not null").groupBy("c").agg(F.min("k").alias("k"))
    n, ones, always = own.agg(F.count("*"), F.expr("bit_or(c)"), F.expr("bit_and(c)")).first()
    used = [i for i in range(64) if n and ((ones & ~always) >> i) & 1]
    if len(used) <= within:  # so few bits in use that any two codes are near
        used = list(range(64))
    bands, flips = _bands(n, within, len(used))
    edges = [round(i * len(used) / bands) for i in range(bands + 1)]

    def spread(most: int) -> DataFrame:
        slices = []
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            value = F.lit(0).cast("long")
            for place, bit in enumerate(used[low:high]):
                value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("c"), bit).bitwiseAND(F.lit(1)), place))
            masks = [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(high - low), r)]
            asked = F.explode(F.lit(np.array(masks, dtype=np.int64))) if most else F.lit(0).cast("long")
            slices.append(own.select("k", "c", F.lit(i).alias("band"), value.alias("v"), asked.alias("mask")).select("k", "c", "band", F.col("v").bitwiseXOR(F.col("mask")).alias("v")))
        return reduce(DataFrame.unionByName, slices)

    x, y = spread(flips).alias("x"), spread(0).alias("y")
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.k") < F.col("y.k")) & (vectors.hamming(F.col("x.c"), F.col("y.c")) <= within))
    return near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), vectors.hamming(F.col("x.c"), F.col("y.c")).cast("int").alias("distance")).distinct()


def clusters(spark: SparkSession, codes: DataFrame, within: int = 8, key: str = "blob_id", code: str = "code") -> tuple[DataFrame, DataFrame]:
    """node, leader of every key with a code, and the pairs of classes; see ``leaders``. Copies share their class's leader."""
    classes = code_classes(codes, key, code)
    pairs = Stage(spark, "near").cut(near_pairs(codes, within, key, code))
    led = leaders(spark, classes.select(F.col("rep").alias("node")).distinct(), pairs)
    return classes.join(led.withColumnRenamed("node", "rep"), "rep").select(F.col("member").alias("node"), "leader"), pairs


def leaders(spark: SparkSession, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, leader: greedy leader clustering in key order, as the lexicographically first maximal independent set.

    Each round, nodes without an undecided smaller neighbour lead, and their neighbours follow; the result is that of the
    one-by-one loop. A follower's leader is its smallest leading neighbour. ``pairs`` (a, b), a < b, are among ``nodes``.
    """
    stage = Stage(spark, "leaders")
    free = stage.cut(nodes.select("node").distinct())
    links = stage.cut(pairs.select("a", "b").distinct())
    led = None
    while not free.isEmpty():
        behind = links.join(free.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        new = stage.cut(free.join(behind, "node", "left_anti"))
        led = new if led is None else stage.cut(led.unionByName(new))
        follow = links.join(new.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        free = stage.cut(free.join(new, "node", "left_anti").join(follow, "node", "left_anti"))
    if led is None:
        return free.select("node", F.col("node").alias("leader"))
    under = links.join(led.select(F.col("node").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    under = under.join(led, "node", "left_anti")
    return led.select("node", F.col("node").alias("leader")).unionByName(under)


def lineage_tree(members: DataFrame, pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """cluster, node, parent, distance, first_seen: the parent is the nearest member of the cluster seen earlier, ties by the earlier.

    ``members``: node, cluster, first_seen. ``pairs`` are of nodes, or with ``classes`` (rep, member) of classes of equal
    codes: a copy's parent is then the earliest of its class, and only that one looks for a parent in other classes.
    """
    if classes is None:
        classes = members.select(F.col("node").alias("rep"), F.col("node").alias("member"))
    own = members.join(classes.withColumnRenamed("member", "node"), "node")
    first = own.groupBy("rep", "cluster").agg(F.min(F.struct("first_seen", "node")).alias("f"))
    a = first.select(F.col("rep").alias("a"), "cluster", F.col("f.first_seen").alias("pt"), F.col("f.node").alias("parent"))
    both = pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = first.join(both, first["rep"] == both["b"]).join(a, ["a", "cluster"]).where(F.struct("pt", "parent") < F.struct(F.col("f.first_seen").alias("pt"), F.col("f.node").alias("parent")))
    best = near.groupBy("rep", "cluster").agg(F.min(F.struct("distance", "pt", "parent")).alias("m"))
    placed = own.join(first, ["rep", "cluster"]).join(best, ["rep", "cluster"], "left")
    leads = F.col("node") == F.col("f.node")
    return placed.select(
        "cluster", "node", F.when(leads, F.col("m.parent")).otherwise(F.col("f.node")).alias("parent"),
        F.when(leads, F.coalesce("m.distance", F.lit(0))).otherwise(F.lit(0)).alias("distance"), "first_seen",
    )


def continuity(threads: DataFrame, hours: float = 48.0, title: float = 0.8, body: float = 0.75, limit: int | None = None) -> DataFrame:
    """Links from an archived thread to a newer one of the board that starts within ``hours`` of its last post.

    ``threads``: thread_id, board_id, subject, archived, first_ts, last_ts, op_text. The join is on the board and a time
    bucket as wide as the gap, of which a thread probes its own and the next, so a busy board is split by time.
    """
    width = hours * 3600
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1e6 / width)
    old = threads.where("archived and last_ts is not null").select(
        F.col("thread_id").alias("prev_thread_id"), "board_id", F.col("subject").alias("s1"), F.col("op_text").alias("t1"), F.col("last_ts").alias("end"),
        F.explode(F.array(bucket("last_ts"), bucket("last_ts") + 1)).alias("bucket"),
    )
    new = threads.where("first_ts is not null").select(
        F.col("thread_id").alias("next_thread_id"), "board_id", F.col("subject").alias("s2"), F.col("op_text").alias("t2"), F.col("first_ts").alias("start"), bucket("first_ts").alias("bucket")
    )
    near = old.join(new, ["board_id", "bucket"]).where("prev_thread_id <> next_thread_id").withColumn("gap", misc.hours_between(F.col("start"), F.col("end"))).where((F.col("gap") > 0) & (F.col("gap") <= hours))
    scored = near.select(
        "prev_thread_id", "next_thread_id", F.round("gap", 6).alias("time_gap_hours"),
        F.round(text.title_similarity(F.col("s1"), F.col("s2")), 6).alias("title_similarity"),
        F.round(text.text_similarity(F.col("t1"), F.col("t2")), 6).alias("op_similarity"),
    )
    found = scored.where((F.col("title_similarity") >= title) | (F.col("op_similarity") >= body)).withColumn("confidence", F.round((F.col("title_similarity") + F.col("op_similarity")) / 2, 6))
    return found if limit is None else found.orderBy("time_gap_hours", "prev_thread_id", "next_thread_id").limit(limit)


def pointers(links: DataFrame) -> DataFrame:
    """prev_thread_id, next_thread_id: the most confident successor of each thread, earliest and smallest among equals."""
    return first_per(links, ["prev_thread_id"], [F.desc("confidence"), F.asc("time_gap_hours"), F.asc("next_thread_id")]).select("prev_thread_id", "next_thread_id")
