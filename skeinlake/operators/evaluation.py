"""Quality of retrieval: recall, nDCG, percentiles and reports of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import first_per


def recall(hits: DataFrame, judged: DataFrame, k: int, relevant: int = 1) -> DataFrame:
    """query_id, recall: relevant posts among the first k hits over all relevant ones; 0 where none is judged relevant.

    ``hits``: query_id, post_id, rank. ``judged``: query_id, post_id, grade; a grade under ``relevant`` is not relevant.
    """
    good = judged.where(F.col("grade") >= relevant).select("query_id", "post_id").distinct()
    total = good.groupBy("query_id").agg(F.count("*").alias("total"))
    found = hits.where(F.col("rank") <= k).join(good, ["query_id", "post_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    every = hits.select("query_id").unionByName(judged.select("query_id")).distinct()
    return every.join(total, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce(F.coalesce("found", F.lit(0)) / F.col("total"), F.lit(0.0)).alias("recall"))


def ndcg(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: gain grade / log2(rank + 1), over that of the best order of the judged; 0 where there is no gain."""
    gain = F.col("grade") / F.log2(F.col("rank") + 1.0)
    got = hits.where(F.col("rank") <= k).join(judged, ["query_id", "post_id"]).groupBy("query_id").agg(F.sum(gain).alias("got"))
    best = first_per(judged, ["query_id"], [F.desc("grade"), F.asc("post_id")], k).groupBy("query_id").agg(F.sum(gain).alias("best"))
    every = hits.select("query_id").unionByName(judged.select("query_id")).distinct()
    joined = every.join(best, "query_id", "left").join(got, "query_id", "left")
    return joined.select("query_id", F.when(F.col("best") > 0, F.coalesce("got", F.lit(0.0)) / F.col("best")).otherwise(0.0).alias("ndcg"))


def percentile(c: Column, p: float) -> Column:
    """The value at place floor(p/100 * (n-1)) of the sorted values of a group; 0 for none."""
    s = F.sort_array(F.collect_list(c))
    at = F.floor(F.lit(p / 100) * (F.size(s) - 1)).cast("int") + 1
    return F.when(F.size(s) == 0, 0.0).otherwise(F.try_element_at(s, F.greatest(at, F.lit(1))).cast("double"))


def summary(results: DataFrame) -> DataFrame:
    """Means and latency percentiles of each arm; ``results``: arm, query_id, recall, ndcg, latency_ms."""
    p = [percentile(F.col("latency_ms"), x).alias(f"p{x}") for x in (50, 95, 99)]
    return results.groupBy("arm").agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("latency_ms").alias("latency_ms"), *p)


def raw_report(results: DataFrame) -> DataFrame:
    """The rows of the report file, with fixed decimals."""
    f = lambda c: F.format_string("%.4f", F.col(c)).alias(c)
    return results.select("arm", "query_id", f("recall"), f("ndcg"), F.format_string("%.3f", F.col("latency_ms")).alias("latency_ms")).orderBy("arm", "query_id")


def run(arms: dict, queries: list[tuple[int, object]], k: int, clock) -> list[tuple[str, int, list[int], float]]:
    """(arm, query_id, hits, milliseconds) of every arm and query; an arm that fails has no hits. ``clock`` gives seconds."""
    out = []
    for name, search in arms.items():
        for query_id, q in queries:
            began = clock()
            try:
                hits = list(search(q, k))[:k]
            except Exception:  # noqa: BLE001 - a failing arm is a result
                hits = []
            out.append((name, query_id, hits, (clock() - began) * 1000))
    return out
