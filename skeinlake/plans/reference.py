"""Queries of the archive's own operators over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import tables
from ..functions import misc, text, vectors
from ..operators import anomaly, archive, cycles, dsl, evaluation, graph, lineage, merge, orphans, search, stylometry, trends
from ..sources import feeds
from .general import _PLACED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_POSTS = "po AS (SELECT DISTINCT ON (id) id AS post_id, thread_id, post_native_id, timestamp AS ts, author_name, tripcode, poster_id, comment_raw, sage, country, flag, original_attachment_link AS link, created_at FROM posts ORDER BY id, created_at)"
_THREADS = "tr AS (SELECT DISTINCT ON (id) id AS thread_id, board_id, thread_native_id, subject, sticky, locked, archived FROM threads ORDER BY id, board_id NULLS FIRST, thread_native_id NULLS FIRST, subject NULLS FIRST, sticky, locked, archived)"
_WIDE = f"{_POSTS}, {_THREADS}, w AS (SELECT po.*, tr.board_id, thread_native_id, subject, sticky, locked, archived, b.code AS board, b.site_id, s.name AS site, s.platform_type FROM po JOIN tr USING (thread_id) JOIN boards b ON b.id = tr.board_id JOIN sites s ON s.id = b.site_id)"
_EXT = "lower(regexp_extract(link, '(\\.[A-Za-z0-9]+)$', 1))"
_FILES = f"fl AS (SELECT post_id, ts, link AS full_url, regexp_extract(link, '([^/]+)$', 1) AS filename, {_EXT} AS ext, CASE {_EXT} WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.webm' THEN 'video/webm' WHEN '.mp4' THEN 'video/mp4' WHEN '.pdf' THEN 'application/pdf' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.txt' THEN 'text/plain' WHEN '.zip' THEN 'application/zip' WHEN '.mov' THEN 'video/quicktime' WHEN '.avif' THEN 'image/avif' WHEN '.7z' THEN 'application/x-7z-compressed' END AS mime, sha256(regexp_extract(link, '([^/]+)$', 1)) AS file_hash FROM po WHERE link IS NOT NULL AND link <> '')"
_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '<[^>]+>', ' ', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_VECS = "ve AS (SELECT post_id, arg_min(embedding, created_at) AS e FROM post_embeddings WHERE model_version = 'minisent-v1' AND len(embedding) = 384 GROUP BY 1)"
_QUERY = "(SELECT e FROM ve WHERE post_id = (SELECT min(post_id) FROM ve SEMI JOIN ppr_seeds USING (post_id)))"
_COS = "CASE WHEN isnan(list_cosine_similarity(e::DOUBLE[], q::DOUBLE[])) THEN 0 ELSE list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]) END"
MODEL = "minisent-v1"


def _wide(s, d):
    return archive.wide_posts(s, d)


def _vecs(s, d):
    return search.embeddings(s, d, MODEL)


def _query_vector(s, d) -> list[float]:
    """The vector of the smallest seed post: one row."""
    seeds = tables.load(s, d, "ppr_seeds").select("post_id").distinct()
    row = _vecs(s, d).join(seeds, "post_id", "left_semi").orderBy("post_id").select("embedding").first()
    return list(row[0])


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


# ---- search ------------------------------------------------------------------------------------------------------


def _dense_sql(score: str, where: str = "", k: int = 20) -> str:
    return f"WITH {_WIDE}, {_FILES}, {_VECS}, d AS (SELECT post_id, e, {_QUERY} AS q FROM ve), h AS (SELECT d.post_id, round({score}, 6) AS score, w.comment_raw FROM d JOIN w USING (post_id) {where}) SELECT post_id, score FROM h ORDER BY score DESC, post_id LIMIT {k}"


def _dense(s, d, metric="cosine", o=search.Options()):
    v = _query_vector(s, d)
    hits = search.dense(_wide(s, d), archive.files(s, d), _vecs(s, d), v, o, metric)
    return _rounded(hits.select("post_id", "score"))


@query("search_dense_cosine", _dense_sql(_COS))
def search_dense_cosine(s, d):
    return _dense(s, d)


@query("search_dense_dot", _dense_sql("list_inner_product(e::DOUBLE[], q::DOUBLE[])"))
def search_dense_dot(s, d):
    return _dense(s, d, "dot")


@query("search_halfvec")
def search_halfvec(s, d):
    return _dense(s, d, "half")


@query("search_filtered", _dense_sql(_COS, "WHERE w.site = 'quadrata' AND w.board = 'tek' AND w.ts >= '2024-02-01' AND w.ts <= '2025-06-30'"))
def search_filtered(s, d):
    return _dense(s, d, o=search.Options(site="quadrata", board="tek", since=datetime(2024, 2, 1), until=datetime(2025, 6, 30)))


@query("search_has_attachment_true", _dense_sql(_COS, "SEMI JOIN fl USING (post_id)"))
def search_has_attachment_true(s, d):
    return _dense(s, d, o=search.Options(has_attachment=True))


@query("search_has_attachment_false", _dense_sql(_COS, "ANTI JOIN fl USING (post_id)"))
def search_has_attachment_false(s, d):
    return _dense(s, d, o=search.Options(has_attachment=False))


@query("search_excerpts", f"WITH {_WIDE}, t AS (SELECT post_id, replace(regexp_replace(comment_raw, '<[^>]*(>|$)', '', 'g'), '>', '') AS t FROM w WHERE comment_raw IS NOT NULL) SELECT post_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '…' ELSE t END AS excerpt FROM t")
def search_excerpts(s, d):
    return _wide(s, d).where("comment_raw is not null").select("post_id", text.excerpt(text.strip_html(F.col("comment_raw"))).alias("excerpt"))


_WORDS = "old people"
_ALL_WORDS = f"len(list_intersect(tk, ['old', 'people'])) = 2"
_LEX = "round(len(list_filter(tk, lambda x: x = 'old' OR x = 'people')) / (1 + ln(greatest(len(tk), 1))), 6)"


@query("search_fulltext", f"WITH {_WIDE}, t AS (SELECT post_id, {_TOKENS.format('comment_raw')} AS tk FROM w WHERE comment_raw IS NOT NULL) SELECT post_id FROM t WHERE {_ALL_WORDS}")
def search_fulltext(s, d):
    return _wide(s, d).where(dsl.text_match(text.words(F.col("comment_raw")), _WORDS)).select("post_id")


_LEXICAL = f"t AS (SELECT post_id, {_TOKENS.format('comment_raw')} AS tk FROM w WHERE comment_raw IS NOT NULL), lx AS (SELECT post_id, {_LEX} AS score FROM t WHERE {_ALL_WORDS} ORDER BY score DESC, post_id LIMIT {{}})"


@query("search_lexical_topk", f"WITH {_WIDE}, {_LEXICAL.replace("{}", "20")} SELECT * FROM lx")
def search_lexical_topk(s, d):
    return _lexical(s, d, 20)


def _lexical(s, d, k):
    hits = search.lexical(_wide(s, d), _WORDS, 2**31 - 1)
    return search.top(_rounded(hits), k)


@query("search_hybrid_rrf", f"""WITH {_WIDE}, {_VECS}, {_LEXICAL.replace("{}", "500")},
  dn AS (SELECT post_id, round({_COS}, 6) AS score FROM (SELECT post_id, e, {_QUERY} AS q FROM ve) ORDER BY score DESC, post_id LIMIT 500),
  a AS (SELECT post_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, post_id)) AS x FROM dn),
  b AS (SELECT post_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, post_id)) AS x FROM lx)
  SELECT post_id, round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS score FROM a FULL JOIN b USING (post_id) ORDER BY coalesce(a.x, 0) + coalesce(b.x, 0) DESC, post_id LIMIT 20""")
def search_hybrid_rrf(s, d):
    dense = search.top(_rounded(search.scored(_vecs(s, d), _query_vector(s, d))), 500)
    return _rounded(search.fused(dense, _lexical(s, d, 500)))


@query("search_lexical_rerank", f"WITH {_WIDE}, {_VECS}, {_LEXICAL.replace("{}", "500")} SELECT post_id, round({_COS}, 6) AS score FROM (SELECT post_id, e, {_QUERY} AS q FROM ve SEMI JOIN lx USING (post_id)) ORDER BY score DESC, post_id LIMIT 20")
def search_lexical_rerank(s, d):
    return search.top(_rounded(search.lexical_first(_vecs(s, d), _lexical(s, d, 500), _query_vector(s, d), 1000)), 20)


@query("search_binary_rerank", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
  a AS (SELECT vec_id, embedding AS e, q, list_sum(list_transform(list_zip(embedding, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS away FROM embeddings, q),
  n AS (SELECT * FROM a ORDER BY away, vec_id LIMIT 200)
  SELECT vec_id, round(list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]), 6) AS score FROM n ORDER BY list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20""")
def search_binary_rerank(s, d):
    e = tables.load(s, d, "embeddings")
    v = list(e.where("vec_id = 0").first()["embedding"])
    return _rounded(search.binary_first(e, v, 20, 200, "vec_id"))


@query("search_candidate_sweep", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
  a AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s, list_sum(list_transform(list_zip(embedding, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS away FROM embeddings, q),
  n AS (SELECT c.c, a.vec_id, a.s, row_number() OVER (PARTITION BY c.c ORDER BY away, vec_id) AS r FROM a, (SELECT unnest([40, 100, 200, 400]) AS c) c),
  t AS (SELECT c, vec_id, row_number() OVER (PARTITION BY c ORDER BY s DESC, vec_id) AS r2 FROM n WHERE r <= c)
  SELECT c::INTEGER AS candidates, count(*) AS hits, sum(vec_id)::BIGINT AS checksum FROM t WHERE r2 <= 20 GROUP BY 1""")
def search_candidate_sweep(s, d):
    e = tables.load(s, d, "embeddings")
    v = list(e.where("vec_id = 0").first()["embedding"])
    out = None
    for n in (40, 100, 200, 400):
        part = search.binary_first(e, v, 20, n, "vec_id").agg(F.lit(n).alias("candidates"), F.count("*").alias("hits"), F.sum("vec_id").alias("checksum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("knn_join", """WITH d AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM d QUALIFY rank <= 5""")
def knn_join(s, d):
    e = tables.load(s, d, "embeddings")
    return search.knn_join(e.where("vec_id % 20 = 0"), e, 5)


# ---- the search language -------------------------------------------------------------------------------------------

DSL_QUERIES = {
    "dsl_field_filters": ("board:tek site:quadrata before:2025-01-01 sage:false limit:500", "board = 'tek' AND site = 'quadrata' AND ts < '2025-01-01' AND NOT sage", "ts DESC NULLS LAST, post_id DESC", 500, 0, ""),
    "dsl_negation": ("not board:tek !site:quadrata not author:Anonymous limit:300", "board <> 'tek' AND site <> 'quadrata' AND coalesce(author_name, '') <> 'Anonymous'", "ts DESC NULLS LAST, post_id DESC", 300, 0, ""),
    "dsl_inequality": ("board!=tek name~ano after:2024-06-01 sticky:true limit:400", "board <> 'tek' AND coalesce(author_name ILIKE '%ano%', false) AND ts > '2024-06-01' AND sticky", "ts DESC NULLS LAST, post_id DESC", 400, 0, ""),
    "dsl_text": ('text:"old people" limit:100', f"coalesce({_ALL_WORDS}, false)", "ts DESC NULLS LAST, post_id DESC", 100, 0, ""),
    "dsl_free_text": ("limit:100 old people", f"coalesce({_ALL_WORDS}, false)", "ts DESC NULLS LAST, post_id DESC", 100, 0, ""),
    "dsl_sort_limit_offset": ("board:tek sort:timestamp asc limit:25 offset:50", "board = 'tek'", "ts ASC NULLS LAST, post_id ASC", 25, 50, ""),
    "dsl_has_file": ("has:file board:rnd limit:200", "board = 'rnd'", "ts DESC NULLS LAST, post_id DESC", 200, 0, "SEMI JOIN fl USING (post_id)"),
    "dsl_not_video": ("not has:video board:rnd limit:200", "board = 'rnd'", "ts DESC NULLS LAST, post_id DESC", 200, 0, "ANTI JOIN (SELECT post_id FROM fl WHERE mime LIKE 'video/%') v USING (post_id)"),
    "dsl_quote": ("quote:20418701 limit:50", "true", "ts DESC NULLS LAST, post_id DESC", 50, 0, "SEMI JOIN (SELECT post_id FROM post_quotes WHERE quoted_post_native_id = '20418701') q USING (post_id)"),
    "dsl_order": ("country>=D country<G locked:false limit:300", "country >= 'D' AND country < 'G' AND NOT locked", "ts DESC NULLS LAST, post_id DESC", 300, 0, ""),
}


def _dsl(source):
    def run(s, d):
        quotes = tables.load(s, d, "post_quotes").select("post_id", "quoted_post_native_id")
        return dsl.apply(dsl.parse(source), _wide(s, d), archive.files(s, d), quotes).select("post_id", "board", "site")

    return run


for _name, (_source, _where, _order, _limit, _offset, _join) in DSL_QUERIES.items():
    query(_name, f"WITH {_WIDE}, {_FILES}, x AS (SELECT *, {_TOKENS.format('comment_raw')} AS tk FROM w) SELECT post_id, board, site FROM x {_join} WHERE {_where} ORDER BY {_order} LIMIT {_limit} OFFSET {_offset}")(_dsl(_source))


@query("saved_search_cycle", f"""WITH {_WIDE}, r AS (SELECT 1 AS saved_search_id, post_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, post_id DESC) AS n FROM w WHERE board = 'tek'
  UNION ALL SELECT 2, post_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, post_id DESC) FROM w WHERE site = 'mossboard' AND sage)
  SELECT k.saved_search_id, count(r.post_id) AS hits FROM (SELECT unnest([1, 2]) AS saved_search_id) k LEFT JOIN r ON r.saved_search_id = k.saved_search_id AND n <= 100 GROUP BY 1""")
def saved_search_cycle(s, d):
    """Two saved searches and a broken one, which does not stop the others."""
    out, wide, files = None, _wide(s, d), archive.files(s, d)
    quotes = tables.load(s, d, "post_quotes").select("post_id", "quoted_post_native_id")
    for i, source in ((1, "board:tek limit:100"), (2, "site:mossboard sage:true limit:100"), (3, "colour:red")):
        try:
            part = dsl.apply(dsl.parse(source), wide, files, quotes).agg(F.lit(i).alias("saved_search_id"), F.count("*").alias("hits"))
        except dsl.DslError:
            continue
        out = part if out is None else out.unionByName(part)
    return out


@query("saved_search_scoped", f"""WITH {_WIDE}, r AS (SELECT 1 AS saved_search_id, post_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, post_id DESC) AS n FROM w WHERE sage AND site = 'mossboard'
  UNION ALL SELECT 2, post_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, post_id DESC) FROM w WHERE NOT sage AND board = 'tek'
  UNION ALL SELECT 3, post_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, post_id DESC) FROM w WHERE NOT sage AND board = 'tek' AND site = 'mossboard')
  SELECT saved_search_id::BIGINT AS saved_search_id, post_id FROM r WHERE n <= 50""")
def saved_search_scoped(s, d):
    searches = [(1, "sage:true limit:50", "mossboard", None), (2, "sage:false limit:50", "", "tek"), (3, "sage:false limit:50", "mossboard", "tek"), (4, "colour:red", "mossboard", None)]
    quotes = tables.load(s, d, "post_quotes").select("post_id", "quoted_post_native_id")
    return cycles.saved_searches(searches, _wide(s, d), archive.files(s, d), quotes)[0].select("saved_search_id", "post_id")


@query("dsl_semantic", _dense_sql(_COS, "WHERE sage IS NOT TRUE", 30))
def dsl_semantic(s, d):
    """Ranked by vectors among the posts that pass; the embedder here is a stored vector for any text."""
    q = dsl.parse('semantic:"old kettles" sage:false limit:30')
    quotes = tables.load(s, d, "post_quotes").select("post_id", "quoted_post_native_id")
    hits = dsl.apply(q, _wide(s, d), archive.files(s, d), quotes, _vecs(s, d), lambda text: _query_vector(s, d))
    return _rounded(hits.select("post_id", "score"))


@query("lynx_records", r"""SELECT board, capture_id::VARCHAR AS thread_id, trim(json_extract_string(body, '$.no')) AS native_id, coalesce(json_extract_string(body, '$.name'), '') AS name, coalesce(json_extract_string(body, '$.sub'), '') AS subject,
  coalesce(json_extract_string(body, '$.com'), '') AS comment_raw, coalesce(TRY_CAST(trim(json_extract_string(body, '$.time')) AS BIGINT), 0) AS timestamp FROM lynx_posts WHERE json_extract_string(body, '$.no') IS NOT NULL""")
def lynx_records(s, d):
    """Every raw record in the common form."""
    raw = tables.load(s, d, "lynx_posts").select("board", F.col("capture_id").cast("string").alias("thread_id"), F.lit("https://b.example").alias("base_url"), F.concat(F.lit('{"posts":['), "body", F.lit("]}")).alias("body"))
    return feeds.lynx_thread(raw).select("board", "thread_id", *(f"post.{c}" for c in ("native_id", "name", "subject", "comment_raw", "timestamp")))


@query("alerts_due", """WITH h AS (SELECT DISTINCT ON (saved_search_id, post_id) * FROM search_hits ORDER BY saved_search_id, post_id, score NULLS FIRST, matched_at),
  n AS (SELECT saved_search_id AS alert_id, count(*) AS hit_count, list_sort(list(DISTINCT post_id)) AS new_post_ids FROM h WHERE matched_at > '2025-06-01' GROUP BY 1)
  SELECT alert_id, alert_id AS saved_search_id, hit_count, new_post_ids FROM n WHERE hit_count >= 2""")
def alerts_due(s, d):
    hits = tables.once(s, d, "search_hits", "score", "matched_at")
    alerts = hits.select("saved_search_id").distinct().select(
        F.col("saved_search_id").alias("alert_id"), "saved_search_id", F.lit(2).alias("threshold"), F.lit(60).alias("cooldown_minutes"), F.lit(True).alias("enabled"),
        F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz").alias("last_triggered"), F.lit(datetime(2025, 6, 1)).cast("timestamp_ntz").alias("last_evaluated"),
    )
    return merge.due_alerts(alerts, hits, F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"))


# ---- trends ---------------------------------------------------------------------------------------------------------


@query("trend_hourly_counts", f"WITH {_WIDE} SELECT site_id, board_id, date_trunc('hour', ts) AS window_start, count(*) AS posts FROM w WHERE ts IS NOT NULL GROUP BY ALL")
def trend_hourly_counts(s, d):
    return trends.hourly_counts(_wide(s, d))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_STRIPPED = "replace(regexp_replace({}, '<[^>]*(>|$)', '', 'g'), '>', '')"
_TERM_LIST = f"list_filter(regexp_split_to_array(lower({_STRIPPED}), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))"


@query("trend_top_terms", f"WITH {_WIDE}, t AS (SELECT site_id, board_id, unnest({_TERM_LIST.format('comment_raw')}) AS term FROM w), c AS (SELECT site_id, board_id, term, count(*) AS count FROM t GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY site_id, board_id ORDER BY count DESC, term)::INTEGER AS rank FROM c WHERE count > 1 QUALIFY rank <= 50")
def trend_top_terms(s, d):
    return trends.top_terms(trends.term_counts(_wide(s, d), ["site_id", "board_id"], F.col("comment_raw")), ["site_id", "board_id"])


@query("trend_sources", f"""WITH t AS (SELECT 'posts' AS source, lang, unnest({_TERM_LIST.format('text')}) AS term FROM documents WHERE kind = 'post' UNION ALL SELECT 'logs', lang, unnest({_TERM_LIST.format('text')}) FROM documents WHERE kind = 'log'),
  c AS (SELECT source, lang, term, count(*) AS count FROM t GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY count DESC, term)::INTEGER AS rank FROM c WHERE count > 1 QUALIFY rank <= 50""")
def trend_sources(s, d):
    docs = tables.load(s, d, "documents").withColumn("body", F.col("text"))
    return trends.snapshot({"posts": docs.where("kind = 'post'"), "logs": docs.where("kind = 'log'")}, ["lang"])


# ---- lineage ---------------------------------------------------------------------------------------------------------

_USES = "us AS (SELECT sha256(text) AS file_hash, doc_id AS post_id, hash_board AS board_id, site_id, created_at AS ts FROM (SELECT *, dense_rank() OVER (ORDER BY source) AS hash_board, dense_rank() OVER (ORDER BY split_part(source, '/', 1)) AS site_id FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL))"


def _uses(s, d):
    docs = tables.load(s, d, "documents").where("text is not null and text <> '' and source is not null")
    boards = docs.select("source").distinct()  # one row for each source
    from pyspark.sql import Window

    sites = boards.withColumn("board_id", F.row_number().over(Window.orderBy("source")).cast("long")).withColumn("site_id", F.dense_rank().over(Window.orderBy(F.substring_index("source", "/", 1))).cast("long"))
    return docs.join(sites, "source").select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("post_id"), "board_id", "site_id", F.col("created_at").alias("ts"))


_CROSS = f"{_USES}, cp AS (SELECT file_hash, list_sort(list(DISTINCT post_id)) AS post_ids, list_sort(list(DISTINCT board_id)) AS board_ids, list_sort(list(DISTINCT site_id)) AS site_ids, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM us GROUP BY 1 HAVING len(post_ids) > 1 OR len(board_ids) > 1)"


@query("crosspost_exact", f"WITH {_CROSS} SELECT *, len(post_ids)::BIGINT AS spread_count FROM cp")
def crosspost_exact(s, d):
    return lineage.exact_crossposts(_uses(s, d))


_HALF = "list_sum(list_transform(range({}, {}), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - {})::INTEGER) ELSE 0 END))::BIGINT"
_CODES = f"co AS (SELECT vec_id AS blob_id, {_HALF.format(1, 33, 1)} AS lo, {_HALF.format(33, 65, 33)} AS hi FROM embeddings)"
_FAR = "(bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)))"
_CLASSES = f"{_CODES}, cl AS (SELECT lo, hi, min(blob_id) AS blob_id FROM co GROUP BY ALL)"


def _codes(s, d):
    """The signs of all 64 values of each vector."""
    return tables.load(s, d, "embeddings").select(F.col("vec_id").alias("blob_id"), vectors.bits(F.col("embedding")).alias("code"))


#: The usual distance, and one at which the vectors of the test data, which have no near copies, meet.
for _within, _name in ((8, ""), (20, "_wide")):
    _LED = f"""WITH RECURSIVE {_CODES}, nu AS (SELECT *, row_number() OVER (ORDER BY blob_id) AS i FROM co),
      st AS (SELECT 0::BIGINT AS i, []::STRUCT(lo BIGINT, hi BIGINT, k BIGINT)[] AS led, NULL::BIGINT AS node, NULL::BIGINT AS leader
        UNION ALL
        SELECT y.i, CASE WHEN f IS NULL THEN list_append(led, {{'lo': y.lo, 'hi': y.hi, 'k': y.blob_id::BIGINT}}) ELSE led END, y.blob_id, coalesce(f, y.blob_id)
        FROM (SELECT st.led, nu.*, list_filter(st.led, lambda x: bit_count(xor(x.lo, nu.lo)) + bit_count(xor(x.hi, nu.hi)) <= {_within})[1].k AS f FROM st JOIN nu ON nu.i = st.i + 1) y),
      le AS (SELECT node, leader FROM st WHERE node IS NOT NULL)"""

    @query(f"crosspost_near_pairs{_name}", f"WITH {_CLASSES} SELECT x.blob_id AS a, y.blob_id AS b, {_FAR}::INTEGER AS distance FROM cl x JOIN cl y ON x.blob_id < y.blob_id WHERE {_FAR} <= {_within}")
    def crosspost_near_pairs(s, d, within=_within):
        return lineage.near_pairs(_codes(s, d), within)

    @query(f"crosspost_clusters{_name}", f"{_LED} SELECT node, leader FROM le")
    def crosspost_clusters(s, d, within=_within):
        return lineage.clusters(s, _codes(s, d), within)[0]

    @query(f"lineage_tree{_name}", f"""{_LED}, n AS (SELECT le.*, lo, hi FROM le JOIN co ON blob_id = node),
      b AS (SELECT y.node, arg_min(x.node, {_FAR}::BIGINT * 1000000000 + x.node) AS parent, min({_FAR}) AS distance FROM n x JOIN n y ON x.leader = y.leader AND x.node < y.node WHERE {_FAR} <= {_within} GROUP BY 1)
      SELECT leader AS cluster, node, parent, coalesce(distance, 0)::INTEGER AS distance, node AS first_seen FROM n LEFT JOIN b USING (node)""")
    def lineage_tree(s, d, within=_within):
        codes = _codes(s, d)
        led, pairs = lineage.clusters(s, codes, within)
        members = led.select("node", F.col("leader").alias("cluster"), F.col("node").alias("first_seen"))
        return lineage.lineage_tree(members, pairs, lineage.code_classes(codes))


_BLANKS = r"[\s\x0b\x{85}\p{Z}]+"
_TRIM = f"regexp_replace(lower(subject), '^{_BLANKS}|{_BLANKS}$', '', 'g')"
_TITLES = f"ti AS (SELECT thread_id, {_TRIM} AS t FROM tr WHERE trim(subject) <> '')"
_SIM = "round(CASE WHEN coalesce(x.t, '') = '' OR coalesce(y.t, '') = '' THEN 0.0 WHEN x.t = y.t THEN 1.0 WHEN starts_with(x.t, y.t) OR starts_with(y.t, x.t) THEN least(strlen(x.t), strlen(y.t)) / greatest(strlen(x.t), strlen(y.t)) ELSE 1 - levenshtein(x.t, y.t) / greatest(strlen(x.t), strlen(y.t)) END, 6)::DOUBLE"
_SPLIT = "list_filter(regexp_split_to_array(lower(@), '" + _BLANKS + "'), lambda x: x <> '')"
_ALIKE = "CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN round(len(list_filter(y.w, lambda v: list_contains(x.w, v))) / greatest(len(x.w), len(y.w)), 6) ELSE 0 END::DOUBLE"


@query("title_similarity", f"WITH {_THREADS}, {_TITLES} SELECT x.thread_id AS a, y.thread_id AS b, {_SIM} AS similarity FROM ti x JOIN ti y ON y.thread_id = x.thread_id + 1")
def title_similarity(s, d):
    t = tables.once(s, d, "threads", "board_id", "thread_native_id", "subject", "sticky", "locked", "archived")
    t = t.where("trim(subject) <> ''").select(F.col("id").alias("a"), F.col("subject").alias("s1"))
    u = t.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("s1").alias("s2"))
    return t.join(u, "a").select("a", "b", F.round(text.title_similarity(F.col("s1"), F.col("s2")), 6).alias("similarity"))


@query("text_similarity", f"WITH d AS (SELECT doc_id, {_SPLIT.replace('@', 'text')} AS w FROM documents WHERE text IS NOT NULL) SELECT x.doc_id AS a, y.doc_id AS b, {_ALIKE} AS similarity FROM d x JOIN d y ON y.doc_id = x.doc_id + 1")
def text_similarity(s, d):
    t = tables.load(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("a"), F.col("text").alias("t1"))
    u = t.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("t1").alias("t2"))
    return t.join(u, "a").select("a", "b", F.round(text.text_similarity(F.col("t1"), F.col("t2")), 6).alias("similarity"))


def _thread_spans(s, d):
    w = _wide(s, d).where("year(ts) > 1970")
    number = F.col("post_native_id").cast("long")
    return w.groupBy("thread_id", "board_id", "subject", "archived").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("comment_raw", F.struct(number, "post_id")).alias("op_text")
    )


#: Hours between threads: the usual, and a wide gap as the archive of the test data is sparse.
_LINKS = f"""WITH {_WIDE}, sp AS (SELECT thread_id, board_id, {_TRIM} AS t, archived, min(ts) AS first_ts, max(ts) AS last_ts FROM w WHERE year(ts) > 1970 GROUP BY ALL),
  op AS (SELECT thread_id, {_SPLIT.replace('@', 'comment_raw')} AS w FROM w WHERE year(ts) > 1970 QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY post_native_id::BIGINT NULLS FIRST, post_id) = 1),
  th AS (SELECT * FROM sp JOIN op USING (thread_id)),
  pr AS (SELECT x.thread_id AS prev_thread_id, y.thread_id AS next_thread_id, round((epoch_us(y.first_ts) - epoch_us(x.last_ts)) / 3.6e9, 6) AS time_gap_hours, {_SIM} AS title_similarity, {_ALIKE} AS op_similarity
    FROM th x JOIN th y ON x.board_id = y.board_id AND x.thread_id <> y.thread_id WHERE x.archived AND y.first_ts > x.last_ts AND y.first_ts <= x.last_ts + INTERVAL @ HOUR),
  li AS (SELECT *, round((title_similarity + op_similarity) / 2, 6) AS confidence FROM pr WHERE title_similarity >= 0.8 OR op_similarity >= 0.75)"""

for _gap, _name in ((48, "_48h"), (1000, "")):

    @query(f"thread_continuity{_name}", f"{_LINKS.replace("@", str(_gap))} SELECT * FROM li")
    def thread_continuity(s, d, gap=_gap):
        """Links by titles or by opening posts, of threads with any subject or none."""
        return lineage.continuity(_thread_spans(s, d), gap)

    @query(f"thread_pointers{_name}", f"{_LINKS.replace("@", str(_gap))} SELECT prev_thread_id, next_thread_id FROM li QUALIFY row_number() OVER (PARTITION BY prev_thread_id ORDER BY confidence DESC, time_gap_hours, next_thread_id) = 1")
    def thread_pointers(s, d, gap=_gap):
        return lineage.pointers(lineage.continuity(_thread_spans(s, d), gap))


# ---- graph -----------------------------------------------------------------------------------------------------------

_EDGE = f"""{_PLACED}, ed AS (SELECT DISTINCT r.post_id AS source_post_id, p.to_id AS target_post_id, r.key,
  CASE WHEN p.to_id IS NULL THEN 'unresolved' WHEN regexp_replace(r.own_key, '/[^/]*$', '') = regexp_replace(r.key, '/[^/]*$', '') THEN 'same_board' ELSE 'cross_board' END AS reference_type FROM refs r LEFT JOIN parents p USING (key))"""
_BOTH = "bo AS (SELECT source_post_id AS a, target_post_id AS b FROM ed WHERE target_post_id IS NOT NULL AND source_post_id <> target_post_id UNION SELECT target_post_id, source_post_id FROM ed WHERE target_post_id IS NOT NULL AND source_post_id <> target_post_id)"


@query("reply_edges", f"WITH {_EDGE} SELECT * FROM ed")
def reply_edges(s, d):
    return graph.edges(s, d)


def _seeds(s, d):
    return tables.load(s, d, "ppr_seeds").select("run_id", F.col("post_id").alias("node"), F.col("weight").cast("double").alias("weight"))


@query("reply_neighbours", f"WITH {_EDGE} SELECT source_post_id AS post_id, target_post_id AS neighbour FROM ed WHERE target_post_id IS NOT NULL AND source_post_id IN (SELECT post_id FROM ppr_seeds) UNION SELECT target_post_id, source_post_id FROM ed WHERE target_post_id IN (SELECT post_id FROM ppr_seeds)")
def reply_neighbours(s, d):
    return graph.neighbours(graph.edges(s, d), tables.load(s, d, "ppr_seeds").select("post_id").distinct())


_NEAR = "h0 AS (SELECT DISTINCT run_id, post_id AS node FROM ppr_seeds), h1 AS (SELECT run_id, node FROM h0 UNION SELECT run_id, b FROM h0 JOIN bo ON a = node), h2 AS (SELECT run_id, node FROM h1 UNION SELECT run_id, b FROM h1 JOIN bo ON a = node)"


@query("k_hop", f"WITH {_EDGE}, {_BOTH}, {_NEAR} SELECT run_id, node, (CASE WHEN (run_id, node) IN (SELECT (run_id, node) FROM h0) THEN 0 WHEN (run_id, node) IN (SELECT (run_id, node) FROM h1) THEN 1 ELSE 2 END)::INTEGER AS hop FROM h2")
def k_hop(s, d):
    return graph.within_hops(s, graph.edges(s, d), _seeds(s, d))


def _ppr_sql(rounds: int) -> str:
    step = "s{n} AS (SELECT b.run_id, b.node, 0.4 * b.r + 0.6 * (coalesce(i.x, 0) + coalesce(l.x, 0) * b.r) AS s FROM base b LEFT JOIN (SELECT s.run_id, k.b AS node, sum(s.s / g.d) AS x FROM s{p} s JOIN lk k ON k.run_id = s.run_id AND k.a = s.node JOIN dg g ON g.run_id = s.run_id AND g.a = s.node GROUP BY 1, 2) i ON i.run_id = b.run_id AND i.node = b.node LEFT JOIN (SELECT run_id, sum(s) AS x FROM s{p} z WHERE NOT EXISTS (SELECT 1 FROM dg WHERE dg.run_id = z.run_id AND dg.a = z.node) GROUP BY 1) l ON l.run_id = b.run_id)"
    steps = ", ".join(step.format(n=i, p=i - 1) for i in range(1, rounds + 1))
    return f"""WITH {_EDGE}, {_BOTH}, {_NEAR}, lk AS (SELECT x.run_id, bo.a, bo.b FROM h2 x JOIN bo ON bo.a = x.node JOIN h2 y ON y.run_id = x.run_id AND y.node = bo.b),
      dg AS (SELECT run_id, a, count(*) AS d FROM lk GROUP BY 1, 2), sw AS (SELECT run_id, post_id AS node, sum(coalesce(weight, 1)::DOUBLE) AS w FROM ppr_seeds GROUP BY 1, 2),
      base AS (SELECT h.run_id, h.node, coalesce(w / sum(w) OVER (PARTITION BY h.run_id), 0) AS r FROM h2 h LEFT JOIN sw USING (run_id, node)), s0 AS (SELECT run_id, node, r AS s FROM base), {steps}
      SELECT run_id, node, round(s, 6) AS score FROM s{rounds}"""


@query("ppr_fixed_iterations", _ppr_sql(5))
def ppr_fixed_iterations(s, d):
    return _rounded(graph.pagerank(s, graph.edges(s, d), _seeds(s, d), rounds=5, tolerance=0))


@query("ppr_converged")
def ppr_converged(s, d):
    return _rounded(graph.pagerank(s, graph.edges(s, d), _seeds(s, d)))


@query("structural_vectors", f"""WITH {_EDGE}, {_VECS}, pr AS (SELECT post_id, post_id AS f FROM ve UNION SELECT source_post_id, min(target_post_id) FROM ed WHERE target_post_id IS NOT NULL GROUP BY 1 UNION SELECT target_post_id, source_post_id FROM ed WHERE target_post_id IS NOT NULL),
  pl AS (SELECT p.post_id, unnest(range(384)) AS i, unnest(v.e)::DOUBLE AS v FROM pr p JOIN ve o ON o.post_id = p.post_id JOIN ve v ON v.post_id = p.f), m AS (SELECT post_id, i, avg(v) AS v FROM pl GROUP BY 1, 2), n AS (SELECT post_id, sqrt(sum(v * v)) AS n, max(CASE WHEN i = 0 THEN v END) AS v0, max(CASE WHEN i = 383 THEN v END) AS v383 FROM m GROUP BY 1)
  SELECT m.post_id, i::INTEGER AS place, round(CASE WHEN n > 0 THEN v / n ELSE v END, 5) AS value FROM m JOIN n ON n.post_id = m.post_id""")
def structural_vectors(s, d):
    v = graph.structural_vectors(graph.edges(s, d), _vecs(s, d))
    return v.select("post_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.round("value", 5))


@query("search_struct", f"""WITH {_EDGE}, {_VECS}, pr AS (SELECT post_id, post_id AS f FROM ve UNION SELECT source_post_id, min(target_post_id) FROM ed WHERE target_post_id IS NOT NULL GROUP BY 1 UNION SELECT target_post_id, source_post_id FROM ed WHERE target_post_id IS NOT NULL),
  pl AS (SELECT p.post_id, unnest(range(384)) AS i, unnest(v.e)::DOUBLE AS v FROM pr p JOIN ve o ON o.post_id = p.post_id JOIN ve v ON v.post_id = p.f), m AS (SELECT post_id, i, avg(v) AS v FROM pl GROUP BY 1, 2),
  qv AS (SELECT unnest(range(384)) AS i, unnest(q)::DOUBLE AS v FROM (SELECT {_QUERY} AS q FROM ve LIMIT 1)),
  s AS (SELECT m.post_id, sum(m.v * qv.v) / sqrt(sum(m.v * m.v)) / sqrt(sum(qv.v * qv.v)) AS score FROM m JOIN qv USING (i) GROUP BY 1)
  SELECT post_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, post_id LIMIT 20""")
def search_struct(s, d):
    v = graph.structural_vectors(graph.edges(s, d), _vecs(s, d))  # of a zero vector the SQL gives NaN, which is first
    return search.top(_rounded(search.scored(v, _query_vector(s, d), zero=float("nan"))), 20)


# ---- anomalies -------------------------------------------------------------------------------------------------------

_HOURS = "hr AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)"


def _hours(s, d):
    return tables.load(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query("anomaly_volume_zscore", f"WITH {_HOURS} SELECT event_type, hour, n, round((n - avg(n) OVER p) / stddev_pop(n) OVER p, 6) AS z FROM hr WINDOW p AS (PARTITION BY event_type) QUALIFY (n - avg(n) OVER p) / stddev_pop(n) OVER p >= 3")
def anomaly_volume_zscore(s, d):
    return anomaly.all_hours(_hours(s, d), "event_type").select("event_type", "hour", "n", F.round("z", 6).alias("z"))


@query("anomaly_current_hour", f"""WITH {_HOURS}, l AS (SELECT event_type, max(hour) AS last FROM hr GROUP BY 1), b AS (SELECT h.event_type, l.last AS hour, avg(n) FILTER (hour < last) AS m, stddev_pop(n) FILTER (hour < last) AS sd, max(n) FILTER (hour = last) AS current FROM hr h JOIN l USING (event_type) GROUP BY 1, 2)
  SELECT event_type, hour, current, round((current - m) / sd, 6) AS z FROM b""")
def anomaly_current_hour(s, d):
    return anomaly.volume(_hours(s, d), "event_type", z=-1e9).select("event_type", "hour", "current", F.round("z", 6).alias("z"))


@query("anomaly_burst", """WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t FROM events),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 FOLLOWING) - row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) + 1 AS count, count(*) OVER (PARTITION BY user_id) AS n, min(t) OVER (PARTITION BY user_id) AS lo, max(t) OVER (PARTITION BY user_id) AS hi FROM e)
  SELECT user_id, event_id, ts, count, round(count / (n / greatest((hi - lo) / 3.6e9, 1)), 6) AS ratio FROM c WHERE count >= 3 AND count / (n / greatest((hi - lo) / 3.6e9, 1)) >= 5""")
def anomaly_burst(s, d):
    return _rounded(anomaly.bursts(tables.load(s, d, "events"), "user_id", "event_id", minutes=60), "ratio")


@query("anomaly_coordinated", f"WITH {_CROSS} SELECT file_hash, len(post_ids)::BIGINT AS spread_count, round((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 6e7, 6) AS span_minutes FROM cp WHERE len(post_ids) >= 2 AND epoch_us(last_seen_at) - epoch_us(first_seen_at) <= 90 * 86400e6")
def anomaly_coordinated(s, d):
    found = anomaly.coordinated(lineage.exact_crossposts(_uses(s, d)), F.lit(datetime(2026, 1, 1)), 2, 90 * 1440, 1e9)
    return found.select("file_hash", "spread_count", F.round("span_minutes", 6).alias("span_minutes"))


@query("anomaly_severity", f"WITH {_HOURS}, z AS (SELECT event_type, hour, (n - avg(n) OVER (PARTITION BY event_type)) / stddev_pop(n) OVER (PARTITION BY event_type) AS z FROM hr) SELECT event_type, hour, CASE WHEN z > 5 THEN 'critical' ELSE 'high' END AS severity FROM z WHERE z >= 3")
def anomaly_severity(s, d):
    return anomaly.all_hours(_hours(s, d), "event_type").select("event_type", "hour", misc.severity(F.lit("volume"), F.col("z")).alias("severity"))


@query("anomaly_events")
def anomaly_events(s, d):
    v = anomaly.volume(_hours(s, d), "event_type", z=1.0)
    b = anomaly.bursts(tables.load(s, d, "events"), "user_id", "event_id", minutes=60)
    c = anomaly.coordinated(lineage.exact_crossposts(_uses(s, d)), F.lit(datetime(2026, 1, 1)), 2, 90 * 1440, 1e9)
    return anomaly.events(v, b, c)


# ---- stylometry ------------------------------------------------------------------------------------------------------


def _style(s, d):
    docs = tables.load(s, d, "documents").where("text is not null and kind = 'essay' and source is not null and lang is not null")
    return docs.select(F.lit(1).alias("thread_id"), F.col("lang").alias("poster"), F.col("doc_id").alias("post_id"), F.col("text"))


_STYLE = r"""sp AS (SELECT 1 AS thread_id, lang AS poster, doc_id AS post_id, text FROM documents WHERE text IS NOT NULL AND kind = 'essay' AND source IS NOT NULL AND lang IS NOT NULL),
  wd AS (SELECT thread_id, poster, post_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS w FROM sp),
  g AS (SELECT thread_id, poster, post_id, unnest(list_filter(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), lambda x: length(x) >= 3)) AS term FROM wd),
  c AS (SELECT thread_id, poster, post_id, term, count(*) AS c FROM g GROUP BY ALL), tt AS (SELECT post_id, sum(c) AS total FROM c GROUP BY 1), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
  ow AS (SELECT poster, count(*) AS own FROM sp GROUP BY 1),
  wt AS (SELECT c.thread_id, c.poster, c.term, sum(c.c / tt.total * ln((SELECT count(*) FROM sp) / df.df)) / any_value(ow.own) AS weight FROM c JOIN tt USING (post_id) JOIN df USING (term) JOIN ow USING (poster) GROUP BY 1, 2, 3)"""


@query("stylo_tfidf_top", f"WITH {_STYLE} SELECT thread_id, poster, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY poster ORDER BY round(weight, 9) DESC, term)::INTEGER AS rank FROM wt WHERE weight > 0 QUALIFY rank <= 50")
def stylo_tfidf_top(s, d):
    p = _style(s, d)
    return _rounded(stylometry.features(stylometry.weights(p, text.word_ngrams(F.col("text"), 2)), 50), "weight")


@query("stylo_pairs", f"WITH {_STYLE}, n AS (SELECT poster, sqrt(sum(weight * weight)) AS n FROM wt GROUP BY 1), dt AS (SELECT x.poster AS a, y.poster AS b, sum(x.weight * y.weight) AS d FROM wt x JOIN wt y ON x.term = y.term AND x.poster < y.poster GROUP BY 1, 2) SELECT 1 AS thread_id, a, b, round(d / (na.n * nb.n), 6) AS similarity FROM dt JOIN n na ON na.poster = a JOIN n nb ON nb.poster = b WHERE na.n > 0 AND nb.n > 0")
def stylo_pairs(s, d):
    w = stylometry.weights(_style(s, d), text.word_ngrams(F.col("text"), 2))
    return _rounded(stylometry.similar(w, -1.0), "similarity")


@query("stylo_threads")
def stylo_threads(s, d):
    """Posters that write alike within a thread, by character and word n-grams, all threads in one plan."""
    w = _wide(s, d).where("comment_raw is not null").select("thread_id", F.col("poster_id").alias("poster"), "post_id", "comment_raw")
    return stylometry.similar_in_threads(s, stylometry.eligible(w, 3), 0.2)


# ---- evaluation ------------------------------------------------------------------------------------------------------

_EVAL = """kn AS (SELECT a.vec_id AS query_id, b.vec_id AS post_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  hi AS (SELECT * FROM kn WHERE rank <= 20), ju AS (SELECT a.vec_id AS query_id, b.vec_id AS post_id, 1 + (b.vec_id % 2) AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def _eval(s, d):
    e = tables.load(s, d, "embeddings")
    hits = search.knn_join(e.where("vec_id % 20 = 0"), e, 20).select(F.col("query").alias("query_id"), F.col("vec_id").alias("post_id"), "rank")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    judged = q.join(e.select("vec_id", "label"), "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("post_id"), (1 + F.col("vec_id") % 2).alias("grade"))
    return hits, judged


@query("eval_recall_ndcg", f"""WITH {_EVAL}, q AS (SELECT query_id FROM hi UNION SELECT query_id FROM ju), r AS (SELECT query_id, count(*) AS n FROM hi SEMI JOIN ju USING (query_id, post_id) GROUP BY 1), t AS (SELECT query_id, count(*) AS n FROM ju GROUP BY 1),
  g AS (SELECT query_id, sum(grade / log2(rank + 1)) AS g FROM hi JOIN ju USING (query_id, post_id) GROUP BY 1), b AS (SELECT query_id, sum(grade / log2(r + 1)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, post_id) AS r FROM ju) WHERE r <= 20 GROUP BY 1)
  SELECT query_id, round(coalesce(r.n / t.n, 0), 6)::DOUBLE AS recall, round(coalesce(g / b, 0), 6)::DOUBLE AS ndcg FROM q LEFT JOIN r USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN b USING (query_id)""")
def eval_recall_ndcg(s, d):
    hits, judged = _eval(s, d)
    best = judged.withColumnRenamed("grade", "grade")
    return _rounded(evaluation.recall(hits, judged, 20).join(_ndcg(hits, best), "query_id"), "recall", "ndcg")


def _ndcg(hits, judged):
    return evaluation.ndcg(hits, judged, 20)


@query("eval_percentiles", "WITH l AS (SELECT event_type AS arm, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT arm, " + ", ".join(f"round(v[floor({p / 100} * (len(v) - 1))::INTEGER + 1], 6) AS p{p}" for p in (50, 95, 99)) + " FROM l")
def eval_percentiles(s, d):
    p = [F.round(evaluation.percentile(F.col("value"), x), 6).alias(f"p{x}") for x in (50, 95, 99)]
    return tables.load(s, d, "events").groupBy(F.col("event_type").alias("arm")).agg(*p)


@query("eval_summary", "WITH l AS (SELECT event_type AS arm, list_sort(list(value)) AS v, avg(value) AS m FROM events GROUP BY 1) SELECT arm, round(m, 4) AS latency_ms, round(v[floor(0.95 * (len(v) - 1))::INTEGER + 1], 4) AS p95 FROM l")
def eval_summary(s, d):
    r = tables.load(s, d, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("query_id"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("ndcg"), F.col("value").alias("latency_ms"))
    return evaluation.summary(r).select("arm", F.round("latency_ms", 4).alias("latency_ms"), F.round("p95", 4).alias("p95"))


# ---- merges and state ------------------------------------------------------------------------------------------------


@query("canonical_promotion", r"""WITH c AS (SELECT trim(regexp_replace(regexp_replace(trim(lower(text), ' '), '[.!?,;:]+$', ''), '\s+', ' ', 'g'), ' ') AS t, created_at AS ts FROM documents WHERE text IS NOT NULL)
  SELECT t AS normalized_text, count(*) AS ref_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM c WHERE t <> '' GROUP BY 1 HAVING count(*) >= 2""")
def canonical_promotion(s, d):
    docs = tables.load(s, d, "documents").where("text is not null").withColumn("ts", F.col("created_at"))
    return merge.promote(docs, text.canonicalize(F.col("text")), 2)


@query("blob_refcount", f"WITH {_POSTS}, {_FILES} SELECT file_hash, max(mime) AS mime_type, count(*)::INTEGER AS ref_count FROM fl GROUP BY 1")
def blob_refcount(s, d):
    f = archive.files(s, d)
    blobs = f.where("false").select("file_hash", F.col("mime").alias("mime_type"), F.lit(0).cast("long").alias("size_bytes"), F.lit(0).alias("ref_count"))
    done = f.select("file_hash", F.col("mime").alias("mime_type"), F.lit(0).cast("long").alias("size_bytes"), F.lit(True).alias("newly_full"))
    return merge.record_downloads(blobs, done).select("file_hash", "mime_type", "ref_count")


@query("thread_upsert", """WITH o AS (SELECT o_custkey AS board_id, o_orderkey AS k, o_orderstatus AS status, o_orderdate AS bump, o_orderkey % 3 AS half FROM orders), t AS (SELECT * FROM o WHERE half < 2), s AS (SELECT * FROM o WHERE half > 0)
  SELECT coalesce(t.k, s.k) AS k, coalesce(CASE WHEN s.k IS NOT NULL THEN 'active' END, t.status) AS status, coalesce(s.bump, t.bump) AS bump, t.k IS NULL AS created FROM t FULL JOIN s ON t.k = s.k""")
def thread_upsert(s, d):
    o = tables.load(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("bump"))
    return merge.upsert(o.where("k % 3 < 2"), o.where("k % 3 > 0").withColumn("status", F.lit("active")), ["k"], {"status": "new", "bump": "fill"}, created="created")


@query("post_upsert_requeue", f"WITH {_POSTS} SELECT post_id, CASE WHEN post_id % 5 = 0 THEN nullif(coalesce(comment_raw, '') || '!', '') ELSE comment_raw END AS comment_raw, post_id % 5 = 0 AS pending_embedding FROM (SELECT post_id, nullif(comment_raw, '') AS comment_raw FROM po)")
def post_upsert_requeue(s, d):
    """A second poll in which every fifth comment was edited: those alone are to be embedded again."""
    p = tables.once(s, d, "posts", "thread_id", "post_native_id", "comment_raw", "created_at").select(
        "id", "thread_id", "post_native_id", F.nullif(F.col("comment_raw"), F.lit("")).alias("comment_raw"), "created_at", F.lit(False).alias("pending_embedding")
    ).withColumn("post_native_id", F.concat_ws("/", "post_native_id", "id"))
    edited = F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("comment_raw", F.lit("")), F.lit("!"))).otherwise(F.col("comment_raw"))
    seen = p.withColumn("comment_raw", edited).drop("pending_embedding")
    return merge.upsert_posts(p, seen).select(F.col("id").alias("post_id"), "comment_raw", "pending_embedding")


@query("catalog_reconcile", f"WITH t AS (SELECT DISTINCT ON (id) id, status, missing_count FROM threads ORDER BY id, status, missing_count), m AS (SELECT id, status, CASE WHEN status <> 'active' THEN missing_count WHEN id % 4 <> 0 THEN 0 ELSE missing_count + 3 - 2 END AS n FROM t) SELECT id, n::INTEGER AS missing_count, CASE WHEN status = 'active' AND n >= 1 THEN 'archived' ELSE status END AS status FROM m")
def catalog_reconcile(s, d):
    t = tables.load(s, d, "threads").groupBy("id").agg(F.min(F.struct("status", "missing_count")).alias("r")).select("id", F.lit(1).alias("board_id"), F.col("id").cast("string").alias("thread_native_id"), "r.*")
    return merge.reconcile(t, t.where("id % 4 <> 0"), 1).select("id", "missing_count", "status")


@query("quote_sets_replaced", "WITH q AS (SELECT DISTINCT post_id, quoted_post_native_id, board FROM post_quotes) SELECT * FROM q WHERE post_id % 3 <> 0 UNION ALL SELECT DISTINCT post_id, 'none', '' FROM q WHERE post_id % 3 = 0")
def quote_sets_replaced(s, d):
    q = tables.load(s, d, "post_quotes").select("post_id", "quoted_post_native_id", "board").distinct()
    return merge.replace_sets(q, q.where("post_id % 3 = 0").select("post_id", F.lit("none").alias("quoted_post_native_id"), F.lit("").alias("board")), "post_id")


# ---- listings, sets and small functions ------------------------------------------------------------------------------


@query("first_posts_per_thread", f"WITH {_WIDE}, o AS (SELECT thread_id, arg_min(post_id, (post_native_id::BIGINT, post_id)) AS op FROM w GROUP BY 1) SELECT thread_id, post_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts NULLS LAST, post_id)::INTEGER AS rank FROM w JOIN o USING (thread_id) WHERE post_id <> op QUALIFY rank <= 3")
def first_posts_per_thread(s, d):
    return archive.previews(_wide(s, d)).select("thread_id", "post_id", "rank")


@query("op_vs_replies", f"WITH {_WIDE} SELECT thread_id, arg_min(post_id, (post_native_id::BIGINT, post_id)) AS op, count(*) - 1 AS replies FROM w GROUP BY 1")
def op_vs_replies(s, d):
    n = F.col("post_native_id").cast("long")
    return _wide(s, d).groupBy("thread_id").agg(F.min_by("post_id", F.struct(n, "post_id")).alias("op"), F.greatest(F.count("*") - 1, F.lit(0)).alias("replies"))


@query("overboard", f"WITH {_WIDE} SELECT post_id, ts, board FROM w ORDER BY ts DESC NULLS LAST, post_id DESC LIMIT 50")
def overboard(s, d):
    return archive.overboard(_wide(s, d)).select("post_id", "ts", "board")


@query("threads_by_size", f"WITH {_WIDE} SELECT thread_id, count(*) AS posts FROM w GROUP BY 1 HAVING count(*) >= 5 ORDER BY posts DESC, thread_id LIMIT 50")
def threads_by_size(s, d):
    return archive.thread_sizes(_wide(s, d))


@query("list_posts", f"WITH {_WIDE}, {_FILES} SELECT post_id, site, board FROM w SEMI JOIN fl USING (post_id) WHERE site = 'mossboard'")
def list_posts(s, d):
    return archive.list_posts(_wide(s, d), archive.files(s, d), site="mossboard", has_attachment=True).select("post_id", "site", "board")


@query("stale_threads", "WITH t AS (SELECT id, max(status) AS status, max(last_seen_at) AS last_seen_at FROM threads GROUP BY 1) SELECT id FROM t WHERE status = 'active' AND (last_seen_at IS NULL OR last_seen_at < TIMESTAMP '2025-12-30 18:00:00')")
def stale_threads(s, d):
    t = tables.load(s, d, "threads").groupBy("id").agg(F.max("status").alias("status"), F.max("last_seen_at").alias("last_seen_at"))
    return archive.stale_threads(t, F.lit(datetime(2025, 12, 31)).cast("timestamp_ntz")).select("id")


@query("mirror_threads", f"WITH bd AS (SELECT b.id AS board_id, platform_type FROM boards b JOIN sites s ON s.id = b.site_id), t AS (SELECT id AS thread_id, min(board_id) AS board_id, min(ltrim(trim(thread_native_id), '0')) AS native FROM threads GROUP BY 1), p AS (SELECT * FROM t JOIN bd USING (board_id)) SELECT a.thread_id, min(b.thread_id) AS mirror_id FROM p a JOIN p b ON a.native = b.native AND a.board_id <> b.board_id WHERE b.platform_type IN ('fourchan', 'desuarchive') GROUP BY 1")
def mirror_threads(s, d):
    boards = tables.load(s, d, "boards").select(F.col("id").alias("board_id"), "site_id")
    sites = tables.load(s, d, "sites").select(F.col("id").alias("site_id"), "platform_type")
    t = tables.load(s, d, "threads").groupBy(F.col("id").alias("thread_id")).agg(F.min("board_id").alias("board_id"), F.min(tables.native_number(F.col("thread_native_id"))).alias("native"))
    return archive.mirrors(t.join(boards, "board_id").join(sites, "site_id"), ["fourchan", "desuarchive"])


@query("blocklist_anti", f"WITH {_POSTS}, {_FILES} SELECT post_id, file_hash FROM fl WHERE file_hash NOT IN (SELECT sha256(regexp_extract(link, '([^/]+)$', 1)) FROM po WHERE post_id % 10 = 1 AND link <> '')")
def blocklist_anti(s, d):
    f = archive.files(s, d)
    return f.join(f.where("post_id % 10 = 1").select("file_hash").distinct(), "file_hash", "left_anti").select("post_id", "file_hash")


@query("pending_downloads", f"WITH {_WIDE}, {_FILES} SELECT thread_id, count(*) AS pending FROM w SEMI JOIN fl USING (post_id) WHERE board = 'rnd' GROUP BY 1")
def pending_downloads(s, d):
    w = _wide(s, d).where("board = 'rnd'").join(archive.files(s, d).select("post_id"), "post_id", "left_semi")
    return w.groupBy("thread_id").agg(F.count("*").alias("pending"))


@query("mime_fanout", f"WITH {_POSTS}, {_FILES}, j AS (SELECT unnest(CASE WHEN mime LIKE 'image/%' THEN ['ocr', 'clip'] WHEN mime LIKE 'video/%' OR mime LIKE 'audio/%' THEN ['speech'] ELSE [] END) AS kind FROM fl) SELECT kind, count(*) AS n FROM j GROUP BY 1")
def mime_fanout(s, d):
    return archive.files(s, d).select(F.explode(misc.media_jobs(F.col("mime"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("download_policy", "SELECT id, CASE WHEN coalesce(bump_limit IS NULL, false) THEN false ELSE coalesce(worksafe, nsfw, true) END AS download FROM boards")
def download_policy(s, d):
    b = tables.load(s, d, "boards")
    return b.select("id", archive.download_policy(F.col("bump_limit").isNull(), F.col("worksafe"), F.col("nsfw"), F.lit(True)).alias("download"))


@query("path_builder", f"WITH {_POSTS}, {_FILES} SELECT DISTINCT file_hash, 'full/' || file_hash[1:2] || '/' || file_hash[3:4] || '/' || file_hash || ext AS path FROM fl")
def path_builder(s, d):
    return archive.files(s, d).select("file_hash", misc.stored_path(F.col("file_hash"), F.col("ext")).alias("path")).distinct()


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def text_hashes(s, d):
    return tables.load(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("canonicalize", r"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(lower(text), ' '), '[.!?,;:]+$', ''), '\s+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL")
def canonicalize(s, d):
    return tables.load(s, d, "documents").where("text is not null").select("doc_id", text.canonicalize(F.col("text")).alias("t"))


@query("strip_html_terms", f"WITH {_POSTS} SELECT post_id, list_sort({_TERM_LIST.format('comment_raw')}) AS terms FROM po WHERE comment_raw IS NOT NULL")
def strip_html_terms(s, d):
    p = tables.once(s, d, "posts", "comment_raw").where("comment_raw is not null")
    return p.select(F.col("id").alias("post_id"), F.sort_array(text.extract_terms(F.col("comment_raw"))).alias("terms"))


@query("extract_quotes", rf"""WITH {_POSTS}, r AS (SELECT post_id, regexp_replace(comment_raw, '(?:&gt;|>){{3}}\s*/?\s*[A-Za-z0-9_+\-]+/\s*\d+', '', 'g') AS t FROM po WHERE comment_raw IS NOT NULL),
  q AS (SELECT post_id, '' AS board, unnest(regexp_extract_all(t, '(?:&gt;|>){{2,3}}\s*(\d+)', 1)) AS quoted FROM r
    UNION ALL SELECT post_id, unnest(regexp_extract_all(comment_raw, '(?:&gt;|>){{3}}\s*/?\s*([A-Za-z0-9_+\-]+)/\s*(\d+)', 1)), unnest(regexp_extract_all(comment_raw, '(?:&gt;|>){{3}}\s*/?\s*([A-Za-z0-9_+\-]+)/\s*(\d+)', 2)) FROM po)
  SELECT board, count(*) AS n, count(DISTINCT post_id) AS posts, sum(quoted::BIGINT)::BIGINT AS checksum FROM q GROUP BY 1""")
def extract_quotes(s, d):
    p = tables.once(s, d, "posts", "comment_raw").where("comment_raw is not null")
    q = p.select("id", F.inline(text.extract_quotes(F.col("comment_raw"))))
    return q.groupBy("board").agg(F.count("*").alias("n"), F.count_distinct("id").alias("posts"), F.sum(F.col("post_id").cast("long")).alias("checksum"))


@query("greentext_and_sage", f"WITH {_POSTS} SELECT post_id, coalesce(lower(trim(author_name)) = 'sage', false) AS named_sage, coalesce(len(list_filter(string_split(replace(comment_raw, '&gt;', '>'), chr(10)), lambda l: regexp_matches(trim(l), '^>([^>]|$)'))) > 0, false) AS green FROM po")
def greentext_and_sage(s, d):
    p = tables.once(s, d, "posts", "comment_raw", "author_name")
    return p.select(F.col("id").alias("post_id"), F.coalesce(text.is_sage(F.col("author_name")), F.lit(False)).alias("named_sage"), F.coalesce(text.has_greentext(F.col("comment_raw")), F.lit(False)).alias("green"))


@query("json_field_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field_extract(s, d):
    return tables.load(s, d, "events").select("event_id", misc.tolerant_long(F.get_json_object("props", "$.k")).alias("k"))


@query("date_formats", "SELECT o_orderkey AS k, strftime(o_orderdate, '%m/%d/%y') AS shown, o_orderdate AS parsed FROM orders WHERE year(o_orderdate) < 2000 AND year(o_orderdate) < 0 UNION ALL SELECT event_id, strftime(ts, '%m/%d/%y(%a)%H:%M:%S'), date_trunc('second', ts) FROM events")
def date_formats(s, d):
    e = tables.load(s, d, "events")
    shown = F.date_format("ts", "MM/dd/yy(EEE)HH:mm:ss")
    return e.select(F.col("event_id").alias("k"), shown.alias("shown"), misc.display_date(shown).cast("timestamp_ntz").alias("parsed"))


@query("hours_between", "SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9, 6) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def hours_between(s, d):
    o = tables.load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return tables.load(s, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(misc.hours_between(F.col("l_shipdate"), F.col("o_orderdate")), 6).alias("hours"))


@query("vector_functions", "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_inner_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::INTEGER AS hamming FROM p")
def vector_functions(s, d):
    e = tables.load(s, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(vectors.dot(a, b), 6).alias("dot"), F.round(vectors.cosine(a, b), 6).alias("cosine"), vectors.hamming(vectors.bits(a), vectors.bits(b)).cast("int").alias("hamming"))


@query("set_difference_active", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference_active(s, d):
    c = tables.load(s, d, "customer").select("c_custkey")
    o = tables.load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").distinct()


@query("keyed_override_union", "SELECT s_suppkey AS k, 'custom' AS origin FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'builtin' FROM supplier WHERE s_suppkey % 3 <> 0")
def keyed_override_union(s, d):
    b = tables.load(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return merge.overriding_union(b.withColumn("origin", F.lit("builtin")), b.where("k % 3 = 0").withColumn("origin", F.lit("custom")), ["k"])


@query("pair_mining", f"WITH {_EDGE}, {_POSTS} SELECT source_post_id, target_post_id FROM ed JOIN po a ON a.post_id = source_post_id JOIN po b ON b.post_id = target_post_id WHERE a.comment_raw <> '' AND b.comment_raw <> '' AND a.comment_raw <> b.comment_raw")
def pair_mining(s, d):
    """Reply pairs for training: both texts present and different."""
    t = tables.once(s, d, "posts", "comment_raw").where("comment_raw <> ''")
    e = graph.edges(s, d).where("target_post_id is not null").select("source_post_id", "target_post_id")
    a, b = t.select(F.col("id").alias("source_post_id"), F.col("comment_raw").alias("x")), t.select(F.col("id").alias("target_post_id"), F.col("comment_raw").alias("y"))
    return e.join(a, "source_post_id").join(b, "target_post_id").where("x <> y").select("source_post_id", "target_post_id")


@query("pair_negatives", f"WITH {_EDGE}, {_POSTS}, c AS (SELECT p.post_id, n.post_id AS negative FROM po p JOIN po n ON n.post_id = p.post_id + 1 AND n.thread_id <> p.thread_id) SELECT post_id, negative FROM c ANTI JOIN ed ON ed.source_post_id = c.post_id AND ed.target_post_id = c.negative")
def pair_negatives(s, d):
    t = tables.once(s, d, "posts", "thread_id")
    c = t.select(F.col("id").alias("post_id"), F.col("thread_id").alias("x")).join(t.select((F.col("id") - 1).alias("post_id"), F.col("id").alias("negative"), F.col("thread_id").alias("y")), "post_id").where("x <> y")
    e = graph.edges(s, d).select(F.col("source_post_id").alias("post_id"), F.col("target_post_id").alias("negative"))
    return c.select("post_id", "negative").join(e, ["post_id", "negative"], "left_anti")


@query("random_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 100")
def random_sample(s, d):
    return archive.sample(tables.load(s, d, "documents"), "doc_id", 100, 7).select("doc_id")


@query("text_length_gate", "SELECT doc_id FROM documents WHERE strlen(trim(text)) >= 8")
def text_length_gate(s, d):
    return tables.load(s, d, "documents").where(F.octet_length(F.trim("text")) >= 8).select("doc_id")


@query("keyset_page", f"WITH {_POSTS}, {_FILES} SELECT DISTINCT file_hash FROM fl WHERE file_hash > '8' ORDER BY file_hash LIMIT 100")
def keyset_page(s, d):
    return archive.files(s, d).select("file_hash").distinct().where("file_hash > '8'").orderBy("file_hash").limit(100)


@query("orphans_in_other_tables", "SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') o ON o_orderkey = l_orderkey")
def orphans_in_other_tables(s, d):
    """The orphan operator on other tables: lines whose order is missing."""
    lines = tables.load(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    parents = tables.load(s, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("key"))
    missing = orphans.missing_keys(parents, lines.select(F.col("l_orderkey").cast("string").alias("key")))
    return lines.join(missing.select(F.col("key").cast("long").alias("l_orderkey")), "l_orderkey", "left_semi")
