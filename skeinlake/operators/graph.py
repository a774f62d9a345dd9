"""The reply graph: resolved edges, neighbourhoods, personalised PageRank, structural vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..staging import Stage
from .orphans import quote_targets


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_post_id, target_post_id, key, reference_type of every distinct quote, in both directions on one site.

    One equi-join on site, board and number serves the own and other boards alike. Type: same_board, cross_board, or
    unresolved where no post is found; of posts that share a key the smallest is meant.
    """
    placed = tables.placed_posts(spark, sf_dir)
    refs = quote_targets(spark, sf_dir, placed).select("post_id", "own_key", "key").distinct()
    by_key = placed.select(tables.node_key(F.col("site_id"), F.col("code"), F.col("number")).alias("key"), "post_id").where("key is not null").groupBy("key").agg(F.min("post_id").alias("target_post_id"))
    board = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    kind = F.when(F.col("target_post_id").isNull(), "unresolved").when(board(F.col("own_key")) == board(F.col("key")), "same_board").otherwise("cross_board")
    return refs.join(by_key, "key", "left").select(F.col("post_id").alias("source_post_id"), "target_post_id", "key", kind.alias("reference_type"))


def neighbours(e: DataFrame, of: DataFrame, key: str = "post_id") -> DataFrame:
    """``key``, neighbour: posts that a post quotes or that quote it, each once."""
    both = e.select(F.col("source_post_id").alias(key), F.col("target_post_id").alias("neighbour")).unionByName(e.select(F.col("target_post_id").alias(key), F.col("source_post_id").alias("neighbour")))
    return both.where("neighbour is not null").join(of.select(key), key, "left_semi").distinct()


def within_hops(spark: SparkSession, e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """run_id, node, hop: nodes within so many steps, in either direction, of each run's seeds (run_id, node)."""
    stage = Stage(spark, "hops")
    known = e.where("target_post_id is not null")
    both = stage.cut(known.select(F.col("source_post_id").alias("node"), F.col("target_post_id").alias("to")).unionByName(known.select(F.col("target_post_id").alias("node"), F.col("source_post_id").alias("to"))).distinct())
    seen = stage.cut(seeds.select("run_id", "node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(both, "node").select("run_id", F.col("to").alias("node")).distinct().join(seen, ["run_id", "node"], "left_anti")
        front = stage.cut(nxt.withColumn("hop", F.lit(h)))
        seen = stage.cut(seen.unionByName(front))
    return seen


def pagerank(spark: SparkSession, e: DataFrame, seeds: DataFrame, alpha: float = 0.6, hops: int = 2, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """run_id, node, score: personalised PageRank of each run on the nodes near its seeds (run_id, node, weight).

    Links are quotes in either direction between nodes of the neighbourhood; mass of a node without any returns to the
    seeds. Seeds without a weight count 1. Rounds end when no run's scores move by the tolerance in total.
    """
    stage = Stage(spark, "pagerank")
    near = within_hops(spark, e, seeds, hops)
    known = e.where("target_post_id is not null and source_post_id <> target_post_id")
    both = known.select(F.col("source_post_id").alias("node"), F.col("target_post_id").alias("to")).unionByName(known.select(F.col("target_post_id").alias("node"), F.col("source_post_id").alias("to"))).distinct()
    inside = near.select("run_id", "node")
    links = inside.join(both, "node").join(inside.withColumnRenamed("node", "to"), ["run_id", "to"], "left_semi")
    degree = links.groupBy("run_id", "node").agg(F.count("*").alias("degree"))
    links = stage.cut(links.join(degree, ["run_id", "node"]).select("run_id", "node", "to", (1.0 / F.col("degree")).alias("share")))
    w = seeds.groupBy("run_id", "node").agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("double")).alias("w"))
    start = w.join(w.groupBy("run_id").agg(F.sum("w").alias("all")), "run_id").select("run_id", "node", (F.col("w") / F.col("all")).alias("restart"))
    base = stage.cut(inside.join(start, ["run_id", "node"], "left").fillna(0.0, ["restart"]))
    pi = base.select("run_id", "node", F.col("restart").alias("score"))
    for step in range(rounds):
        moved = pi.join(links, ["run_id", "node"]).groupBy("run_id", F.col("to").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        lost = pi.join(links.select("run_id", "node").distinct(), ["run_id", "node"], "left_anti").groupBy("run_id").agg(F.sum("score").alias("lost"))
        new = base.join(moved, ["run_id", "node"], "left").join(lost, "run_id", "left").join(pi.withColumnRenamed("score", "old"), ["run_id", "node"])
        score = (1 - alpha) * F.col("restart") + alpha * (F.coalesce("in", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("restart"))
        new = stage.cut(new.select("run_id", "node", score.alias("score"), F.abs(score - F.col("old")).alias("moved")))
        stage.drop(pi)
        pi = new.select("run_id", "node", "score")
        pi._stage_path = new._stage_path
        if tolerance and (new.groupBy("run_id").agg(F.sum("moved").alias("m")).agg(F.max("m")).first()[0] or 0.0) < tolerance:
            break
    return pi


def structural_vectors(e: DataFrame, vecs: DataFrame) -> DataFrame:
    """post_id, embedding: the mean of a post's own vector, its first quoted post's and those of all that quote it, scaled
    to length 1. Each task sums the vectors of a post that it meets, so a post has one row a task in the shuffle."""
    known = e.where("target_post_id is not null")
    parent = known.groupBy(F.col("source_post_id").alias("post_id")).agg(F.min("target_post_id").alias("from"))
    children = known.select(F.col("target_post_id").alias("post_id"), F.col("source_post_id").alias("from"))
    own = vecs.select("post_id", F.col("post_id").alias("from"))
    pairs = own.unionByName(parent).unionByName(children).distinct().join(own.select("post_id"), "post_id", "left_semi")
    met = pairs.join(vecs.select(F.col("post_id").alias("from"), "embedding"), "from").select("post_id", F.lit(1).cast("long").alias("n"), F.col("embedding").cast("array<double>").alias("s"))
    part = met.mapInArrow(_sums, _SUMS).repartition("post_id").sortWithinPartitions("post_id").mapInArrow(_sums, _SUMS)
    mean = part.select("post_id", F.transform("s", lambda v: v / F.col("n")).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda t, v: t + v * v))
    return mean.withColumn("l", length).select("post_id", F.transform("m", lambda v: F.when(F.col("l") > 0, v / F.col("l")).otherwise(v)).alias("embedding"))


_SUMS = "post_id long, n long, s array<double>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n and s of each run of a post; what a batch ends with is carried on."""
    key, n, total = None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["post_id", "n", "s"])

    for b in batches:
        if not b.num_rows:
            continue
        ids, counts = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = b.column(2).flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, counts, x = ids[order], counts[order], x[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        ids, counts, x = ids[at], np.add.reduceat(counts, at), np.add.reduceat(x, at)
        if key is not None:
            if key == ids[0]:
                counts[0] += n
                x[0] += total
            else:
                yield row()
        if len(ids) > 1:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) - 1) * x.shape[1] + 1, x.shape[1], dtype=np.int32)), pa.array(x[:-1].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), pa.array(counts[:-1]), lists], names=["post_id", "n", "s"])
        key, n, total = int(ids[-1]), int(counts[-1]), x[-1].copy()
    if key is not None:
        yield row()
