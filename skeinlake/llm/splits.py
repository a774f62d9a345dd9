"""Splits that keep related records together.

Related threads are joined by union-find (see ``components``). Groups are then given to splits largest first, each to the
split furthest below its target. The greedy run needs only how many groups there are of each size: the sizes of n posts
take at most sqrt(2 n) different values, so this histogram is small at any scale and is all that reaches the driver. Equal
groups are given out in one step, by the level to which they fill the splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..staging import Stage
from .components import components

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Groups of one size that a task ranks, about; and tasks at most for a size, which bounds the histogram.
PER_TASK, SALTS = 200_000, 1024
#: Threads of a group that one task pairs with as many others.
PART = 2000


def thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: threads of one board code and number, and both ends of each continuity link between stored threads."""
    placed = tables.placed_threads(spark, sf_dir).where("native is not null")
    first = placed.groupBy("code", "native").agg(F.min("thread_id").alias("b"), F.max("thread_id").alias("last"))
    same = placed.join(first.where("b <> last"), ["code", "native"]).where("thread_id <> b").select(F.col("thread_id").alias("a"), "b")
    threads = tables.load(spark, sf_dir, "threads")
    near = threads.select(F.col("id").alias("a"), F.explode(F.array("continuity_prev_id", "continuity_next_id")).alias("b"))
    near = near.where("b is not null and b <> a").distinct()
    return same.unionByName(near.join(threads.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b"))


def share_out(count: int, size: float, below: np.ndarray) -> np.ndarray:
    """How many of ``count`` equal groups each split gets, each group going to the split that is then furthest below.

    ``below`` holds how far each split is below its target, in posts; ties go to the first split.
    """
    got = np.zeros(len(below), dtype=np.int64)
    if count > 64:  # fill to a level a little above the final one, then go on one by one
        lo, hi = below.min() - size * (count + 1), below.max()
        for _ in range(200):
            mid = (lo + hi) / 2
            if np.ceil(np.maximum(below - mid, 0) / size).sum() > count - 2 * len(below):
                lo = mid
            else:
                hi = mid
        got = np.ceil(np.maximum(below - hi, 0) / size).astype(np.int64)
    for _ in range(count - int(got.sum())):
        got[int(np.argmax(below - got * size))] += 1
    return got


def assign(sizes: np.ndarray, counts: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Of each size, from the largest: how many of its groups each split gets. Groups of size 0 are divided by the shares."""
    target = np.array(shares) / sum(shares)
    below, out = target * float((sizes * counts).sum()), []
    for size, count in zip(sizes.tolist(), counts.tolist()):
        if size:
            got = share_out(count, size, below)
            below = below - got * size
        else:
            got = np.diff(np.concatenate([[0], np.floor(np.cumsum(target) * count + 1e-9)])).astype(np.int64)
        out.append(got)
    return out


def group_splits(spark: SparkSession, groups: DataFrame, splits: tuple[str, ...] = SPLITS, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """group, size, split of every row of ``groups`` (group, size). A null size is 0; without rows there are none."""
    stage = Stage(spark, "splits")
    items = stage.cut(groups.select("group", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    salts = int(min(SALTS, 1 + items.count() // PER_TASK))
    items = items.withColumn("_salt", F.pmod(F.xxhash64("group"), F.lit(salts)).cast("int"))
    rows = items.groupBy("size", "_salt").count().toPandas()  # at most sqrt(2 posts) sizes; the rare ones have few salts
    sizes, at = np.unique(rows["size"].to_numpy(dtype=np.int64), return_inverse=True)
    table = np.zeros((len(sizes), salts), dtype=np.int64)
    table[at, rows["_salt"].to_numpy(dtype=np.int64)] = rows["count"]
    offsets = np.cumsum(table, axis=1) - table
    ends = np.cumsum(assign(sizes[::-1], table.sum(1)[::-1], shares)[::-1] or np.zeros((0, len(splits))), axis=1)
    shared = spark.sparkContext.broadcast((sizes, offsets, ends))
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("size", "_salt").orderBy("group")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, offsets, ends = shared.value
        for b in batches:
            size, salt, rank = (b.column(k).to_numpy() for k in (1, 2, 3))
            i = np.searchsorted(sizes, size)
            k = (offsets[i, salt] + rank - 1 >= ends[i].T).sum(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(splits)[k], pa.string())], names=["group", "size", "split"])

    return ranked.mapInArrow(place, f"group {groups.schema['group'].dataType.simpleString()}, size long, split string")


def thread_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, group of every thread; the group is its smallest thread."""
    found = components(spark, thread_links(spark, sf_dir)).select(F.col("node").alias("thread_id"), "root")
    every = tables.load(spark, sf_dir, "threads").select(F.col("id").alias("thread_id")).distinct()
    return every.join(found, "thread_id", "left").select("thread_id", F.coalesce("root", "thread_id").alias("group"))


def thread_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, code, native, group, n_posts, split of every thread."""
    stage = Stage(spark, "threads")
    posts = tables.load(spark, sf_dir, "posts").select("id", "thread_id").distinct().groupBy("thread_id").agg(F.count("*").alias("n_posts"))
    members = stage.cut(thread_groups(spark, sf_dir).join(posts, "thread_id", "left").fillna(0, ["n_posts"]))
    split = group_splits(spark, members.groupBy("group").agg(F.sum("n_posts").alias("size")))
    placed = tables.placed_threads(spark, sf_dir)
    return members.join(split.select("group", "split"), "group").join(placed, "thread_id", "left").select(
        "thread_id", "site_id", "code", "native", "group", "n_posts", "split"
    )


def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_a, thread_b: every pair of threads that must share a split."""
    stage = Stage(spark, "pairs")
    found = stage.cut(components(spark, thread_links(spark, sf_dir)))
    # a large group is divided into parts; each two parts meet under a key of their own
    parts = found.groupBy("root").count().where(F.col("count") > PART).select("root", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    placed = found.join(parts, "root", "left").select("root", "node", F.coalesce("parts", F.lit(1)).alias("parts"))
    placed = stage.cut(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    a = placed.select("root", "own", other, F.col("node").alias("thread_a"))
    b = placed.select("root", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), F.col("node").alias("thread_b"))
    return a.join(b, ["root", "own", "other"]).where("thread_a < thread_b").select("thread_a", "thread_b")
