"""Scans of the archive's tables. A re-delivered record counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The natural key of each table that can hold a record twice.
KEYS = {
    "threads": ["id"],
    "posts": ["id"],
    "post_quotes": ["post_id", "quoted_post_native_id", "board"],
    "post_embeddings": ["post_id"],
    "search_hits": ["saved_search_id", "post_id"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it is stored. Columns are pruned and filters pushed by whatever is built on it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Each record of the table once, with the named columns besides its key.

    Of re-deliveries the values of the first one by ``created_at`` (else by value) are kept. The key is aggregated with
    partial aggregation, so a record that was delivered many times is reduced before the shuffle. A null key is a key.
    """
    df, keys = load(spark, sf_dir, name), KEYS[name]
    columns = tuple(c for c in columns if c not in keys)
    if not columns:
        return df.select(*keys).distinct()
    if "created_at" in df.columns:  # one aggregate for each column, so Catalyst drops those that nothing reads
        return df.groupBy(*keys).agg(*(F.min_by(c, "created_at").alias(c) for c in columns))
    return df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_r")).select(*keys, "_r.*")


def board_code(c: Column) -> Column:
    """A board code without case, blanks and outer slashes."""
    return F.regexp_replace(F.lower(c), r"^[\s/]+|[\s/]+$", "")


def native_number(c: Column) -> Column:
    """The digits of a native number without leading zeros, null if it is none. Text, so that no length overflows."""
    digits = F.regexp_extract(c, r"^[\s>#]*0*([0-9]+)\s*$", 1)
    return F.when(digits != "", digits)


def node_key(site: Column, code: Column, number: Column) -> Column:
    """``site_id/board code/native number``; null if any part is."""
    return F.concat(site.cast("string"), F.lit("/"), code, F.lit("/"), number)


def placed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, site_id, code, native: each thread once with its board's site and code and its number."""
    boards = load(spark, sf_dir, "boards").select(
        F.col("id").alias("board_id"), "site_id", board_code(F.col("code")).alias("code")
    )
    threads = load(spark, sf_dir, "threads").select("id", "board_id", "thread_native_id")
    threads = threads.groupBy("id").agg(
        F.min("board_id").alias("board_id"), F.min(native_number(F.col("thread_native_id"))).alias("native")
    )
    # boards is a dimension of one row for each board; Catalyst broadcasts it while its size is under the threshold
    return threads.join(boards, "board_id").select(F.col("id").alias("thread_id"), "site_id", "code", "native")


def placed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, site_id, code, number: each post once with its board's site and code and its own number."""
    boards = load(spark, sf_dir, "boards").select(
        F.col("id").alias("board_id"), "site_id", board_code(F.col("code")).alias("code")
    )
    threads = load(spark, sf_dir, "threads").groupBy(F.col("id").alias("thread_id")).agg(F.min("board_id").alias("board_id"))
    posts = load(spark, sf_dir, "posts").select(
        F.col("id").alias("post_id"), "thread_id", native_number(F.col("post_native_id")).alias("number")
    )
    return (
        posts.join(threads.join(boards, "board_id"), "thread_id")
        .groupBy("post_id")
        .agg(F.min("site_id").alias("site_id"), F.min("code").alias("code"), F.min("number").alias("number"))
    )
