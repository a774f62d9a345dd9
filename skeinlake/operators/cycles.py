"""The periodic jobs, each composed of operators: what to run, in which order, and what one step leaves to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dsl, lineage, merge, search


def crosspost_cycle(spark: SparkSession, uses: DataFrame, codes: DataFrame, within: int = 8) -> DataFrame:
    """Copies of one file, and of files that look alike, with their posts, boards, sites and times.

    Near copies are clusters of codes (blob_id, code); a cluster's row is named by its leader.
    """
    exact = lineage.exact_crossposts(uses).withColumn("match_type", F.lit("exact"))
    led, _ = lineage.clusters(spark, codes, within)
    by_leader = uses.join(led, uses["file_hash"] == led["node"]).select(F.col("leader").alias("file_hash"), "post_id", "board_id", "site_id", "ts")
    several = led.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select(F.col("leader").alias("file_hash"))
    near = lineage.exact_crossposts(by_leader.join(several, "file_hash", "left_semi")).withColumn("match_type", F.lit("near"))
    return exact.unionByName(near)


def saved_searches(searches: list[tuple], wide: DataFrame, files: DataFrame, quotes: DataFrame, **vectors) -> tuple[DataFrame | None, dict[int, str]]:
    """Hits (saved_search_id, post_id, matched_at) of all searches, and the mistakes of those that can't be read.

    A search is its number and source and, if it is confined to them, a site's name and a board's code; blank ones and
    None confine nothing. ``vectors`` are those of ``dsl.apply``.
    """
    hits, mistakes = None, {}
    for number, source, *within in searches:
        scoped = wide
        for column, value in zip(("site", "board"), within):
            scoped = scoped.where(F.col(column) == value) if value else scoped
        try:
            part = dsl.apply(dsl.parse(source), scoped, files, quotes, **vectors).select(F.lit(number).cast("long").alias("saved_search_id"), "post_id", F.col("ts").alias("matched_at"))
        except dsl.DslError as e:
            mistakes[number] = str(e)
            continue
        hits = part if hits is None else hits.unionByName(part)
    return hits, mistakes


def record_hits(old: DataFrame, hits: DataFrame) -> DataFrame:
    """The table of hits after a run: a hit that is found again keeps its row, with the newer score and time."""
    return merge.upsert(old, hits, ["saved_search_id", "post_id"], {"matched_at": "max"})


def discovered_boards(boards: DataFrame, listed: DataFrame, site_id: int) -> DataFrame:
    """Boards after a site's list (code, title, nsfw) was read; none is deleted, and a board is work-safe unless marked."""
    seen = listed.select(F.lit(site_id).cast("long").alias("site_id"), "code", "title", "nsfw", (~F.col("nsfw")).alias("worksafe"))
    return merge.upsert(boards, seen, ["site_id", "code"], {"title": "fill"})


def canonical_vectors(texts: DataFrame, known: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose canonical text has a vector, with it; and the rest, which is to be embedded."""
    named = texts.withColumn("normalized_text", canonical)
    have = known.select("normalized_text", "embedding")
    return named.join(have, "normalized_text"), named.join(have, "normalized_text", "left_anti")


def arms(wide: DataFrame, files: DataFrame, vectors: dict[str, DataFrame]) -> dict[str, Callable[[tuple[list[float], str], int], list[int]]]:
    """The retrieval strategies that are compared: name -> function of ((vector, words), k) to post ids.

    ``vectors`` has post_id, embedding by kind: plain, and context and struct if they were built.
    """
    ids = lambda df: [r["post_id"] for r in df.collect()]  # noqa: E731 - at most k rows

    def dense(kind: str, metric: str):
        return lambda q, k: ids(search.top(search.scored(vectors[kind], q[0], metric), k))

    def hybrid(kind: str, metric: str):
        def run(q, k):
            best = search.top(search.scored(vectors[kind], q[0], metric), 500)
            return ids(search.fused(best, search.lexical(wide, q[1]), k))

        return run

    def narrowed(n: int):
        return lambda q, k: ids(search.binary_first(vectors["plain"], q[0], k, n))

    out = {"baseline": dense("plain", "cosine"), "halfvec": dense("plain", "half"), "dotproduct": dense("plain", "dot"), "hybrid_halfvec": hybrid("plain", "half"), "hybrid_dotproduct": hybrid("plain", "dot")}
    out |= {f"candidates_{n}": narrowed(n) for n in (40, 100, 200, 400)}
    if "context" in vectors:
        out |= {"context_aug_halfvec": dense("context", "half"), "context_aug_dotproduct": dense("context", "dot"), "context_aug_hybrid": hybrid("context", "cosine")}
    if "struct" in vectors:
        out["struct"] = dense("struct", "cosine")
    return out
