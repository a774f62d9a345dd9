"""Who writes alike: n-gram TF-IDF of posters within a thread and their cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..staging import Stage
from .archive import first_per

#: A thread with more characters or posters is not held by one task, but meets by joins. Characters of a task, about.
LARGE, POSTERS, TASK = 2_000_000, 2000, 500_000
#: Powers of an odd number and of its inverse, modulo 2^64: a run of characters has one number wherever it stands.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def weights(posts: DataFrame, grams: Column, thread: str = "thread_id", poster: str = "poster", post: str = "post_id") -> DataFrame:
    """thread, poster, term, weight: the poster's mean TF-IDF of each term; posts of the thread are the documents."""
    counts = posts.select(thread, poster, post, F.explode(grams).alias("term")).groupBy(thread, poster, post, "term").agg(F.count("*").alias("c"))
    total = counts.groupBy(thread, poster, post).agg(F.sum("c").alias("total"))
    df = counts.groupBy(thread, "term").agg(F.count("*").alias("df"))
    size = posts.groupBy(thread).agg(F.count("*").alias("docs"))
    mine = posts.groupBy(thread, poster).agg(F.count("*").alias("own"))
    tf = counts.join(total, [thread, poster, post]).join(df, [thread, "term"]).join(size, thread)
    one = tf.select(thread, poster, "term", (F.col("c") / F.col("total") * F.log(F.col("docs") / F.col("df"))).alias("w"))
    return one.groupBy(thread, poster, "term").agg(F.sum("w").alias("w")).join(mine, [thread, poster]).select(thread, poster, "term", (F.col("w") / F.col("own")).alias("weight"))


def features(w: DataFrame, n: int = 200, thread: str = "thread_id", poster: str = "poster") -> DataFrame:
    """The n strongest terms of each poster; ties by the term."""
    return first_per(w.where("weight > 0"), [thread, poster], [F.desc(F.round("weight", 9)), F.asc("term")], n)


def similar(w: DataFrame, least: float = 0.7, thread: str = "thread_id", poster: str = "poster") -> DataFrame:
    """thread, a, b, similarity of posters of one thread whose cosine reaches ``least``; they meet at shared terms."""
    norms = w.groupBy(thread, poster).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    x = w.select(thread, "term", F.col(poster).alias("a"), F.col("weight").alias("wa"))
    y = w.select(thread, "term", F.col(poster).alias("b"), F.col("weight").alias("wb"))
    dots = x.join(y, [thread, "term"]).where("a < b").groupBy(thread, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    n = lambda side: norms.select(thread, F.col(poster).alias(side), F.col("norm").alias("n" + side))
    out = dots.join(n("a"), [thread, "a"]).join(n("b"), [thread, "b"]).select(thread, "a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def eligible(posts: DataFrame, least_posts: int = 5, least_posters: int = 2, thread: str = "thread_id", poster: str = "poster") -> DataFrame:
    """Posts of posters with enough posts, in threads with enough such posters."""
    own = posts.where(F.col(poster).isNotNull() & (F.col(poster) != "")).groupBy(thread, poster).agg(F.count("*").alias("own")).where(F.col("own") >= least_posts)
    enough = own.groupBy(thread).agg(F.count("*").alias("n")).where(F.col("n") >= least_posters).select(thread)
    return posts.join(own.select(thread, poster), [thread, poster], "left_semi").join(enough, thread, "left_semi")


def similar_in_threads(spark: SparkSession, posts: DataFrame, least: float, thread: str = "thread_id", poster: str = "poster", post: str = "post_id", body: str = "comment_raw") -> DataFrame:
    """``similar`` of the ``weights`` of character and word n-grams, for ``least`` above 0.

    A task holds a thread, so that its n-grams never leave it. Only threads too large for that meet by joins.
    """
    posts = Stage(spark, "stylometry").cut(posts.select(thread, poster, post, body, text.tagless(F.col(body)).alias("plain")))
    sizes = posts.groupBy(thread).agg(F.sum(F.coalesce(F.length("plain"), F.lit(0))).alias("size"), F.countDistinct(poster).alias("posters"))
    large = sizes.where((F.col("size") > LARGE) | (F.col("posters") > POSTERS))
    every, apart = sizes.agg(F.sum("size"), F.count(F.when((F.col("size") > LARGE) | (F.col("posters") > POSTERS), 1))).first()
    held = posts.join(large.select(thread), thread, "left_anti") if apart else posts
    schema = f"{thread} {posts.schema[thread].dataType.simpleString()}, a string, b string, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for t, p, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                if t != at:
                    yield from out(at, rows)
                    at, rows = t, []
                rows.append((p, c))
        yield from out(at, rows)

    def out(t, rows: list) -> Iterator[pa.RecordBatch]:
        found = _alike(rows, least) if rows else []
        if found:
            a, b, s = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(a), posts_type), pa.array(a), pa.array(b), pa.array(s)], names=[thread, "a", "b", "similarity"])

    posts_type = pa.int64() if posts.schema[thread].dataType.typeName() == "long" else None
    near = held.select(thread, poster, "plain").repartition(int(min(4096, (every or 0) // TASK + 8)), thread).sortWithinPartitions(thread).mapInArrow(run, schema)
    if not apart:
        return near
    far = posts.join(large.select(thread), thread, "left_semi")
    return near.unionByName(similar(weights(far, F.concat(text.char_ngrams(F.col(body)), text.word_ngrams(F.col(body))), thread, poster, post), least, thread, poster))


def _grams(t: str, forward: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A number for each character n-gram (3 to 5) and word n-gram (1 to 3) of a text that ``tagless`` gave."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(c)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * forward[:n])])
    plain = np.concatenate([[0], np.cumsum(((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57)))])
    starts, ends = [], []
    for w in (3, 4, 5):
        at = np.arange(max(0, n - w + 1))
        at = at[plain[at + w] > plain[at]]
        starts.append(at), ends.append(at + w)
    gap = np.concatenate([[-1], np.flatnonzero(c == 32), [n]])
    first, last = gap[:-1] + 1, gap[1:]
    first, last = first[last > first], last[last > first]
    for w in (1, 2, 3):
        a, b = first[: max(0, len(first) - w + 1)], last[w - 1 :]
        starts.append(a[b - a >= 3]), ends.append(b[b - a >= 3])
    s, e = np.concatenate(starts), np.concatenate(ends)
    return (sums[e] - sums[s]) * back[s]


def _alike(rows: list[tuple[str, str]], least: float) -> list[tuple[str, str, float]]:
    """a, b, similarity of the posters of a thread, whose (poster, text) these are."""
    names = sorted({p for p, _ in rows})
    number = {p: i for i, p in enumerate(names)}
    longest = max((len(t) for _, t in rows if t), default=0) + 1
    power = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, x, dtype=np.uint64))])
    forward, back = power(_BASE), power(_BACK)
    own = np.bincount([number[p] for p, _ in rows])
    terms, shares, who = [], [], []
    for p, t in rows:
        h, n = np.unique(_grams(t or "", forward, back), return_counts=True)
        if len(h):
            terms.append(h), shares.append(n / n.sum()), who.append(np.full(len(h), number[p]))
    if not terms:
        return []
    who = np.concatenate(who)
    _, term, df = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    w = np.concatenate(shares) * np.log(len(rows) / df)[term] / own[who]
    order = np.argsort(term, kind="stable")
    term, who, w = term[order], who[order], w[order]
    width, dots = max(1, (1 << 21) // len(names)), np.zeros((len(names), len(names)))
    for t in range(0, len(df), width):
        i, j = np.searchsorted(term, (t, t + width))
        x = np.bincount(who[i:j] * width + term[i:j] - t, weights=w[i:j], minlength=len(names) * width).reshape(len(names), width)
        dots += x @ x.T
    norm = np.sqrt(np.diag(dots))
    size = norm[:, None] * norm[None, :]
    s = np.divide(dots, size, out=np.full_like(dots, -1), where=size > 0)
    return [(names[a], names[b], float(s[a, b])) for a, b in np.argwhere(np.triu(s >= least, 1)).tolist()]
