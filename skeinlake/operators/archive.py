"""The archive as one wide table, its files, listings and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import misc


def wide_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post once with its thread, board and site; only the columns that are used are read."""
    sites = tables.load(spark, sf_dir, "sites").select(F.col("id").alias("site_id"), F.col("name").alias("site"), "platform_type")
    boards = tables.load(spark, sf_dir, "boards").select(F.col("id").alias("board_id"), "site_id", F.col("code").alias("board"))
    threads = tables.once(spark, sf_dir, "threads", "board_id", "thread_native_id", "subject", "sticky", "locked", "archived").withColumnRenamed("id", "thread_id")
    posts = tables.once(
        spark, sf_dir, "posts", "thread_id", "post_native_id", "timestamp", "author_name", "tripcode", "poster_id", "comment_raw", "sage", "country", "flag", "original_attachment_link", "created_at"
    ).withColumnsRenamed({"id": "post_id", "timestamp": "ts"})
    return posts.join(threads, "thread_id").join(boards, "board_id").join(sites, "site_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of posts: their address, name, media type and the hash they are stored under."""
    link = F.col("original_attachment_link")
    posts = tables.once(spark, sf_dir, "posts", "original_attachment_link", "timestamp").where(link.isNotNull() & (link != ""))
    return posts.select(
        F.col("id").alias("post_id"), F.col("timestamp").alias("ts"), link.alias("full_url"), F.regexp_extract(link, r"([^/]+)$", 1).alias("filename"),
        misc.extension(link).alias("ext"), misc.type_of_name(link).alias("mime"), F.sha2(F.regexp_extract(link, r"([^/]+)$", 1), 256).alias("file_hash"),
    )


def first_per(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Catalyst limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def overboard(wide: DataFrame, n: int = 50) -> DataFrame:
    """The newest posts of all boards."""
    return wide.orderBy(F.desc_nulls_last("ts"), F.desc("post_id")).limit(n)


def previews(wide: DataFrame, n: int = 3) -> DataFrame:
    """The first replies of each thread. The opening post is the one of the smallest number, and is no reply."""
    number = F.col("post_native_id").cast("long")
    opening = wide.groupBy("thread_id").agg(F.min_by("post_id", F.struct(number, "post_id")).alias("op"))
    return first_per(wide.join(opening, "thread_id").where("post_id <> op"), ["thread_id"], [F.asc_nulls_last("ts"), F.asc("post_id")], n)


def thread_sizes(wide: DataFrame, least: int = 5, n: int | None = 50) -> DataFrame:
    """Threads of ``least`` posts or more, largest first."""
    out = wide.groupBy("thread_id").agg(F.count("*").alias("posts")).where(F.col("posts") >= least).orderBy(F.desc("posts"), "thread_id")
    return out if n is None else out.limit(n)


def stale_threads(threads: DataFrame, as_of: Column, hours: float = 6.0) -> DataFrame:
    """Active threads never seen, or not for so many hours before ``as_of``."""
    return threads.where((F.col("status") == "active") & (F.col("last_seen_at").isNull() | (misc.hours_between(as_of, F.col("last_seen_at")) > hours)))


def mirrors(threads: DataFrame, families: list[str]) -> DataFrame:
    """thread_id, mirror_id: the first thread of the same number on another board, on platforms of the families."""
    other = threads.where(F.col("platform_type").isin(families)).select("native", F.col("board_id").alias("other_board"), F.col("thread_id").alias("other"))
    return threads.join(other, "native").where("board_id <> other_board").groupBy("thread_id").agg(F.min("other").alias("mirror_id"))


def download_policy(text_only: Column, board: Column, site: Column, default: Column) -> Column:
    """Whether to download: never if text only, else the setting nearest to the board."""
    return F.when(F.coalesce(text_only, F.lit(False)), False).otherwise(F.coalesce(board, site, default))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that is random but the same each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def list_posts(wide: DataFrame, files_: DataFrame, site: str | None = None, board: str | None = None, native: str | None = None, has_attachment: bool | None = None) -> DataFrame:
    """Posts by site, board, number and whether they have a file; a filter that is not given is not in the plan."""
    out = wide
    for c, v in (("site", site), ("board", board), ("post_native_id", native)):
        if v is not None:
            out = out.where(F.col(c) == v)
    if has_attachment is not None:
        out = out.join(files_.select("post_id"), "post_id", "left_semi" if has_attachment else "left_anti")
    return out.orderBy(F.asc_nulls_last("ts"), "post_id")
