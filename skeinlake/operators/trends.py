"""Hourly counts and top terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .archive import first_per


def hourly_counts(wide: DataFrame) -> DataFrame:
    """site_id, board_id, window_start, posts of every hour that has posts. A null time is in no hour."""
    return wide.where("ts is not null").groupBy("site_id", "board_id", F.date_trunc("hour", "ts").alias("window_start")).agg(F.count("*").alias("posts"))


def term_counts(posts: DataFrame, by: list[str], body: Column) -> DataFrame:
    """Occurrences of each term in each group."""
    return posts.select(*by, F.explode(text.extract_terms(body)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("count"))


def top_terms(counts: DataFrame, by: list[str], n: int = 50, least: int = 2) -> DataFrame:
    """The n most frequent terms of each group that occur ``least`` times; ties by the term."""
    return first_per(counts.where(F.col("count") >= least), by, [F.desc("count"), F.asc("term")], n)


def snapshot(sources: dict[str, DataFrame], by: list[str], body: str = "body") -> DataFrame:
    """Top terms of several sources of text, each kept apart by its name."""
    out = None
    for name, df in sources.items():
        part = top_terms(term_counts(df, by, F.col(body)), by).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
