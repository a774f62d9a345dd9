"""Vector, lexical and hybrid search over posts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import text, vectors
from .dsl import text_match


#: Queries of a block that is broadcast.
QUERIES = 8192


@dataclass(frozen=True)
class Options:
    """Filters of a search; one that is None is not in the plan."""

    site: str | None = None
    board: str | None = None
    thread: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    has_attachment: bool | None = None
    words: str | None = None
    k: int = 20

    @property
    def top(self) -> int:
        return 20 if self.k <= 0 else min(self.k, 100)


def scope(wide: DataFrame, files: DataFrame, o: Options) -> DataFrame:
    """Posts that pass the filters; both ends of the time are included."""
    out = wide
    for c, v in (("site", o.site), ("board", o.board), ("thread_native_id", o.thread)):
        if v is not None:
            out = out.where(F.col(c) == v)
    if o.since is not None:
        out = out.where(F.col("ts") >= F.lit(o.since).cast("timestamp_ntz"))
    if o.until is not None:
        out = out.where(F.col("ts") <= F.lit(o.until).cast("timestamp_ntz"))
    if o.has_attachment is not None:
        out = out.join(files.select("post_id"), "post_id", "left_semi" if o.has_attachment else "left_anti")
    if o.words is not None:
        out = out.where(text_match(text.words(F.col("comment_raw")), o.words))
    return out


def embeddings(spark: SparkSession, sf_dir: str, model: str, dims: int = 384) -> DataFrame:
    """post_id, embedding of one model; each post once, vectors of another length left out."""
    df = tables.load(spark, sf_dir, "post_embeddings").where((F.col("model_version") == model) & (F.size("embedding") == dims))
    return df.groupBy("post_id").agg(F.min_by("embedding", "created_at").alias("embedding"))


def scored(vecs: DataFrame, query: list[float], metric: str = "cosine", key: str = "post_id", vector: str = "embedding", zero: float = 0.0) -> DataFrame:
    """``key``, score of every vector against one query, by matrix products over Arrow batches.

    Metrics: cosine, dot, half (cosine of vectors rounded to half precision). A zero vector scores ``zero``.
    """
    q = np.asarray(query, dtype=np.float64)
    if metric == "half":
        q = q.astype(np.float16).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(q)))
            if metric == "half":
                x = x.astype(np.float16).astype(np.float64)
            s = x @ q
            if metric != "dot":
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
                s = np.divide(s, n, out=np.full_like(s, zero), where=n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=[key, "score"])

    return vecs.select(key, vector).where(F.size(vector) == len(query)).mapInArrow(run, f"{key} {vecs.schema[key].dataType.simpleString()}, score double")


def top(scores: DataFrame, k: int, key: str = "post_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), key).limit(k)


def dense(wide: DataFrame, files: DataFrame, vecs: DataFrame, query: list[float], o: Options, metric: str = "cosine") -> DataFrame:
    """post_id, score, excerpt of the k posts nearest to the query among those that pass the filters."""
    passed = scope(wide, files, o).select("post_id", "comment_raw")
    free = all(v is None for v in (o.site, o.board, o.thread, o.since, o.until, o.has_attachment, o.words))
    if not free:
        vecs = vecs.join(passed.select("post_id"), "post_id", "left_semi")
    hits = top(scored(vecs, query, metric), o.top)
    return hits.join(passed, "post_id").select("post_id", "score", text.excerpt(text.strip_html(F.coalesce("comment_raw", F.lit("")))).alias("excerpt"))


def lexical_score(tokens: Column, wanted: list[str]) -> Column:
    """Occurrences of the wanted words over 1 + ln of the text's length."""
    hits = F.size(F.filter(tokens, lambda t: t.isin(wanted)))
    return hits / (1 + F.log(F.greatest(F.size(tokens), F.lit(1)).cast("double")))


def lexical(posts: DataFrame, query: str, k: int = 500, key: str = "post_id", body: str = "comment_raw") -> DataFrame:
    """``key``, score of the k texts that hold all words of the query, best first."""
    wanted = [w for w in dict.fromkeys(re.split(r"[\W_]+", query.lower())) if w]
    t = posts.select(key, text.words(F.col(body)).alias("tokens")).where(text_match(F.col("tokens"), query))
    return top(t.select(key, lexical_score(F.col("tokens"), wanted).alias("score")), k, key)


def fused(dense_hits: DataFrame, lexical_hits: DataFrame, k: int = 20, damp: int = 60, key: str = "post_id") -> DataFrame:
    """Reciprocal rank fusion: a hit scores 1/(damp + rank) in each list it is in. The lists are cut, so small."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), key))
    a = dense_hits.select(key, (1.0 / (damp + rank)).alias("a"))
    b = lexical_hits.select(key, (1.0 / (damp + rank)).alias("b"))
    return top(a.join(b, key, "full").select(key, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score")), k, key)


def lexical_first(vecs: DataFrame, candidates: DataFrame, query: list[float], k: int = 20, key: str = "post_id") -> DataFrame:
    """The lexical candidates ranked by their vectors' similarity to the query."""
    return top(scored(vecs.join(candidates.select(key), key, "left_semi"), query, key=key), k, key)


def binary_first(vecs: DataFrame, query: list[float], k: int = 20, candidates: int = 200, key: str = "post_id", vector: str = "embedding") -> DataFrame:
    """The nearest by sign bits, then ranked on the full vectors; ``candidates`` trades accuracy for work."""
    n = len(query)
    code = [sum(1 << i for i, v in enumerate(query[s : s + 64]) if v > 0) for s in range(0, n, 64)]
    code = [c - (1 << 64) if c >= 1 << 63 else c for c in code]
    packed = vectors.packed_bits(F.col(vector), n)
    away = sum((F.bit_count(packed[i].bitwiseXOR(F.lit(c))) for i, c in enumerate(code)), F.lit(0))
    near = vecs.select(key, vector, away.alias("away")).orderBy("away", key).limit(candidates)
    return top(scored(near, query, key=key, vector=vector), k, key)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, ``key``, score: the k nearest of the corpus to each of a stated set of queries, in blocks that are broadcast to it.

    Blocks are divided by hash and hold about QUERIES queries; each task keeps its best k of each query, so little is shuffled.
    """
    blocks = -(-queries.count() // QUERIES)
    if blocks > 1:
        block = F.pmod(F.xxhash64(key), F.lit(blocks))
        return reduce(DataFrame.unionByName, (_knn_block(queries.where(block == i), corpus, k, key, vector) for i in range(blocks)))
    return _knn_block(queries, corpus, k, key, vector)


def _knn_block(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    q = queries.select(key, vector).toArrow()  # about QUERIES rows
    ids = q.column(0).to_numpy()
    x = np.array(q.column(1).to_pylist(), dtype=np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            own = b.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            y = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)[order]
            own = own[order]
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
            s = np.round(x @ y.T, 6)
            s[ids[:, None] == own[None, :]] = -9
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            r, c = np.nonzero(np.take_along_axis(s, best, 1) > -9)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(own[best[r, c]]), pa.array(s[r, best[r, c]])], names=["query", key, "score"])

    found = corpus.select(key, vector).mapInArrow(run, f"query long, {key} long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
