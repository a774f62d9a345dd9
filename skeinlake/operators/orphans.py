"""References to records that do not exist.

Parents and distinct reference targets are range-partitioned on the key. In each range the parents come first, in order,
and form one sorted array; the targets follow in Arrow batches that are probed by binary search. A target that many
references share is aggregated before the shuffle, so that a hot key is one row. Only the misses are joined back to the
references; as a missing key may still hold a third of them, that join is salted on both sides, by the number of its
references.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

#: References of a key that one task joins back, about: a key of more is spread over several tasks.
PER_TASK = 100_000
#: Keys of up to so many bytes are held at a fixed width; a range with a longer one holds its keys one by one.
WIDTH = 64


def _held(keys: pa.Array) -> np.ndarray:
    """The keys as bytes, which sort as Spark orders strings."""
    b = [k.encode() for k in keys.to_pylist()]
    if max(map(len, b), default=0) <= WIDTH:
        return np.array(b, dtype="S")
    out = np.empty(len(b), dtype=object)
    out[:] = b
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    if any(p.dtype == object for p in parts):
        parts = [p.astype(object) for p in parts]
    return np.concatenate(parts) if parts else np.empty(0, dtype="S1")


def missing_keys(parents: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """Distinct values of ``key`` in ``targets`` that ``parents`` lacks. Null keys take no part on either side.

    Empty tables give their natural result: without parents all targets are missing, without targets nothing is.
    """
    side = lambda df, is_target: df.select(
        F.col(key).cast("string").alias("key"), F.lit(is_target).alias("is_target")
    ).where("key is not null").distinct()
    both = side(parents, 0).unionByName(side(targets, 1))
    ranged = both.repartitionByRange("key").sortWithinPartitions("is_target", "key")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = None
        for b in batches:
            is_target = b.column(1).to_numpy(zero_copy_only=False)
            keys = b.column(0)
            split = int(np.searchsorted(is_target, 1))
            if split:
                parts.append(_held(keys.slice(0, split)))
            if split == len(keys):
                continue
            if held is None:
                held = _joined(parts)
                parts.clear()
            wanted = keys.slice(split)
            w = _held(wanted)
            if w.dtype == object or held.dtype == object:
                w, held = w.astype(object), held.astype(object)
            at = np.searchsorted(held, w)
            hit = np.zeros(len(w), dtype=bool)
            inside = at < len(held)
            hit[inside] = held[at[inside]] == w[inside]
            yield pa.RecordBatch.from_arrays([wanted.filter(pa.array(~hit))], names=["key"])

    return ranged.mapInArrow(probe, "key string")


def quote_targets(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    """Each distinct quote of an existing post with the key it means; ``key`` is null where its number is none.

    ``number`` and ``own_key`` are those of the quoting post.
    """
    quotes = tables.load(spark, sf_dir, "post_quotes").select("post_id", "quoted_post_native_id", "board").distinct()
    meant = tables.board_code(F.coalesce("board", F.lit("")))
    return quotes.join(placed, "post_id").select(
        "post_id",
        "quoted_post_native_id",
        "board",
        "number",
        tables.node_key(F.col("site_id"), F.col("code"), F.col("number")).alias("own_key"),
        tables.node_key(
            F.col("site_id"),
            F.when(meant == "", F.col("code")).otherwise(meant),
            tables.native_number(F.col("quoted_post_native_id")),
        ).alias("key"),
    )


def orphan_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, quoted_post_native_id, board, key: distinct quotes whose post does not exist, as they are stored.

    A quote without a readable number refers to nothing. A quoting post that is itself missing has no board, so nothing
    can be said of its quotes and they take no part.
    """
    placed = tables.placed_posts(spark, sf_dir)
    refs = quote_targets(spark, sf_dir, placed)
    parents = placed.select(tables.node_key(F.col("site_id"), F.col("code"), F.col("number")).alias("key"))
    out = ["post_id", "quoted_post_native_id", "board", "key"]
    found = with_missing(refs.where("key is not null"), missing_keys(parents, refs), "post_id")
    return found.select(*out).unionByName(refs.where("key is null").select(*out))


def with_missing(refs: DataFrame, missing: DataFrame, spread: str) -> DataFrame:
    """The rows of ``refs`` whose key is in ``missing``. Keys of many rows are few, and their rows are spread by ``spread``."""
    hot = refs.groupBy("key").count().where(F.col("count") > PER_TASK).select("key", F.ceil(F.col("count") / PER_TASK).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    copies = missing.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    placed = refs.join(hot, "key", "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts.cast("long")).cast("int")).drop("_parts")
    return placed.join(copies, ["key", "_salt"]).drop("_salt")


def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, month, n_references, n_orphans: by the month of the quoting post; null for a null or 1970 time."""
    ts = F.col("timestamp")
    months = tables.load(spark, sf_dir, "posts").groupBy(F.col("id").alias("post_id")).agg(
        F.min(F.when(F.year(ts) > 1970, F.date_format(ts, "yyyy-MM"))).alias("month")
    )
    quotes = tables.load(spark, sf_dir, "post_quotes").select("post_id", "quoted_post_native_id", "board").distinct()
    tagged = quotes.select("post_id", F.lit(1).alias("ref"), F.lit(0).alias("miss")).unionByName(
        orphan_quotes(spark, sf_dir).select("post_id", F.lit(0).alias("ref"), F.lit(1).alias("miss"))
    )
    per_post = tagged.groupBy("post_id").agg(F.sum("ref").alias("ref"), F.sum("miss").alias("miss"))
    return (
        per_post.join(months, "post_id")
        .groupBy(F.lit("post_quotes").alias("table_name"), "month")
        .agg(F.sum("ref").alias("n_references"), F.sum("miss").alias("n_orphans"))
    )


def report(references: DataFrame, parents: DataFrame) -> DataFrame:
    """table_name, month, n_references, n_orphans of any tables' references (table_name, key, ts) to ``parents`` (table_name, key).

    ``parents`` names the table of the references that it answers. A null key is no reference; repeated rows count. The
    month is null for a null or 1970 time. References are counted by key before they are probed.
    """
    named = lambda df: F.concat("table_name", F.lit("|"), F.col("key").cast("string"))
    month = F.when(F.year("ts") > 1970, F.date_format("ts", "yyyy-MM"))
    counted = references.select(named(references).alias("key"), "table_name", month.alias("month")).where("key is not null").groupBy("key", "table_name", "month").agg(F.count("*").alias("n"))
    missing = missing_keys(parents.select(named(parents).alias("key")), counted).withColumn("miss", F.lit(True))
    per = counted.join(missing, "key", "left").groupBy("table_name", "month")
    return per.agg(F.sum("n").alias("n_references"), F.coalesce(F.sum(F.when(F.col("miss"), F.col("n"))), F.lit(0).cast("long")).alias("n_orphans"))


def tables_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``report`` over every stored column that refers to a key of another table, besides quotes."""
    load = lambda name: tables.load(spark, sf_dir, name)
    refs, parents = [], []

    def add(table: str, column: str, ts: str | None, to: str) -> None:
        name = F.lit(f"{table}.{column}").alias("table_name")
        time = F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")
        refs.append(load(table).select(name, F.col(column).alias("key"), time.cast("timestamp_ntz").alias("ts")))
        parents.append(load(to).select(name, F.col("id").alias("key")))

    for table, column, ts, to in REFERENCES:
        add(table, column, ts, to)
    every = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return report(every(refs), every(parents))


#: Columns that refer to a key, with the time of the reference and the table that holds the key as ``id``.
REFERENCES = (
    ("posts", "thread_id", "timestamp", "threads"), ("threads", "board_id", "first_seen_at", "boards"), ("boards", "site_id", None, "sites"),
    ("threads", "continuity_prev_id", "first_seen_at", "threads"), ("threads", "continuity_next_id", "first_seen_at", "threads"), ("post_quotes", "post_id", None, "posts"),
    ("post_embeddings", "post_id", "created_at", "posts"), ("search_hits", "post_id", "matched_at", "posts"), ("post_labels", "post_id", None, "posts"), ("ppr_seeds", "post_id", None, "posts"),
)
