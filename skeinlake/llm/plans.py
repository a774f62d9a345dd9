"""Queries of the subpackage, with SQL where SQL can state them on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..operators import search
from . import near_duplicates, neighbours, packing, pieces, pii, splits, tokens, toxicity

CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def _comments(spark, sf_dir):
    return tables.load(spark, sf_dir, "posts").select("id", "comment_raw")


def p1_found(spark, sf_dir):
    found = near_duplicates.pairs(spark, _comments(spark, sf_dir), "id", "comment_raw")
    return found.select(F.col("a").alias("post_a"), F.col("b").alias("post_b"))


def p1_groups(spark, sf_dir):
    found = near_duplicates.groups(spark, _comments(spark, sf_dir), "id", "comment_raw")
    return found.select(F.col("id").alias("post_id"), "group", "links")


def p2_found(spark, sf_dir):
    return splits.related_pairs(spark, sf_dir)


def p2_splits(spark, sf_dir):
    return splits.thread_splits(spark, sf_dir)


def _finds(spark, sf_dir):
    posts = tables.load(spark, sf_dir, "posts").select(F.col("id").alias("post_id"), "comment_raw", "author_name")
    return pii.find(spark, posts, "post_id", {"comment_raw": False, "author_name": True})


def p5_found(spark, sf_dir):
    return _finds(spark, sf_dir).select("post_id", "field_name", F.explode("finds.pii_type").alias("pii_type")).distinct()


def p5_redacted(spark, sf_dir):
    """The readable text of every post and field that holds personal data, with placeholders."""
    return _finds(spark, sf_dir).where(F.size("finds") > 0).select("post_id", "field_name", "redacted").distinct()


def p6_scores(spark, sf_dir):
    return toxicity.score_posts(spark, sf_dir)


def p6_passages(spark, sf_dir):
    """Every toxic passage with its score, place and words, for review."""
    found = toxicity.passages(spark, sf_dir).where("toxic")
    return found.select("post_id", F.inline("passages"))


def p6_rates(spark, sf_dir):
    return toxicity.rates(spark, sf_dir)


def p6_found(spark, sf_dir):
    return toxicity.score_posts(spark, sf_dir).where("toxic").select("post_id")


def p7_neighbours(spark, sf_dir):
    """The five most similar posts of each post, with the score."""
    return neighbours.nearest(spark, tables.load(spark, sf_dir, "post_embeddings").select("post_id", "embedding", "model_version"))


def p7_found(spark, sf_dir):
    n = p7_neighbours(spark, sf_dir)
    return n.select(F.least("post_id", "neighbour").alias("post_a"), F.greatest("post_id", "neighbour").alias("post_b")).distinct()


def p7_exact(spark, sf_dir):
    """The exact five of every post whose id is divisible by 20, against all, to measure the recall of p7_neighbours."""
    every = neighbours.usable(tables.load(spark, sf_dir, "post_embeddings"), 384, "post_id", "model_version", "embedding")
    found = []
    for m in sorted((r[0] for r in every.select("model").distinct().collect()), key=str):  # one row for each model version
        own = every.where(F.col("model").eqNullSafe(F.lit(m)))
        found.append(search.knn_join(own.where("id % 20 = 0"), own, 5, "id", "vector"))
    hits = reduce(DataFrame.unionByName, found) if found else every.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    return hits.select(F.col("query").alias("post_id"), F.col("id").alias("neighbour"), "score")


def p8_ids(spark, sf_dir):
    return tokens.token_ids(tables.load(spark, sf_dir, "documents"))


def p9_containers(spark, sf_dir):
    sized = tokens.token_sizes(tables.load(spark, sf_dir, "documents"))
    return packing.pack(spark, sized, CAPACITY)


def p9_report(spark, sf_dir):
    """Containers, their fill, and the parts of divided documents."""
    c = p9_containers(spark, sf_dir).where("container is not null")
    per = c.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("parts").alias("n_parts"), F.sum("n").alias("n_tokens"),
        F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


def p10_pieces(spark, sf_dir):
    return pieces.pieces(tables.load(spark, sf_dir, "documents"), limit=LIMIT, overlap=OVERLAP)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_CODE = r"regexp_replace(lower(code), '^[\s/]+|[\s/]+$', '', 'g')"
_NUM = r"nullif(regexp_extract(thread_native_id, '^[\s>#]*0*([0-9]+)\s*$', 1), '')"

_SQL = {
    "p2_found": f"""WITH RECURSIVE
      th AS (SELECT t.id, min(b.code) AS code, min({_NUM}) AS num FROM threads t JOIN (SELECT id AS board_id, {_CODE} AS code FROM boards) b USING (board_id) GROUP BY 1),
      e AS (SELECT a.id AS a, b.id AS b FROM th a JOIN th b ON a.code = b.code AND a.num = b.num AND a.id <> b.id
        UNION SELECT id, continuity_prev_id FROM threads WHERE continuity_prev_id IN (SELECT id FROM threads)
        UNION SELECT id, continuity_next_id FROM threads WHERE continuity_next_id IN (SELECT id FROM threads)),
      s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
      SELECT DISTINCT a AS thread_a, b AS thread_b FROM r WHERE a < b""",
    "p7_exact": """WITH one AS (SELECT post_id, arg_min(embedding::FLOAT[384], created_at) AS e, arg_min(model_version, created_at) AS m FROM post_embeddings
        WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY 1),
      d AS (SELECT a.post_id AS q, b.post_id AS c, round(array_cosine_similarity(a.e::DOUBLE[384], b.e::DOUBLE[384]), 6) AS s FROM one a JOIN one b ON a.m = b.m AND a.post_id <> b.post_id WHERE a.post_id % 20 = 0)
      SELECT q AS post_id, c AS neighbour, s AS score FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _SQL.items() if k in queries()}
