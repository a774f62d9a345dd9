"""Queries of the general operators for training data, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, orphans

_CODE = r"regexp_replace(lower({}), '^[\s/]+|[\s/]+$', '', 'g')"
_NUM = r"nullif(regexp_extract({}, '^[\s>#]*0*([0-9]+)\s*$', 1), '')"

#: The shared part of the SQL: posts with their place, quotes with the key they mean.
_PLACED = f"""
bd AS (SELECT id AS board_id, site_id, {_CODE.format('code')} AS code FROM boards),
th AS (SELECT id AS thread_id, min(board_id) AS board_id FROM threads GROUP BY 1),
placed AS (
  SELECT p.id AS post_id, min(b.site_id) AS site_id, min(b.code) AS code, min({_NUM.format('p.post_native_id')}) AS number
  FROM posts p JOIN th t USING (thread_id) JOIN bd b USING (board_id) GROUP BY 1),
parents AS (SELECT min(post_id) AS to_id, site_id || '/' || code || '/' || number AS key FROM placed GROUP BY 2 HAVING key IS NOT NULL),
refs AS (
  SELECT q.post_id, q.quoted_post_native_id, q.board, l.number,
    l.site_id || '/' || l.code || '/' || l.number AS own_key,
    l.site_id || '/' || coalesce(nullif({_CODE.format("coalesce(q.board, '')")}, ''), l.code) || '/' || {_NUM.format('q.quoted_post_native_id')} AS key
  FROM (SELECT DISTINCT post_id, quoted_post_native_id, board FROM post_quotes) q JOIN placed l USING (post_id))"""

_EDGES = f"""{_PLACED},
lx AS (
  SELECT site_id || '/' || lower(trim(board)) || '/' || {_NUM.format("json_extract_string(body, '$.no')")} AS key,
    site_id || '/' || lower(trim(board)) || '/' || nullif({_NUM.format("json_extract_string(body, '$.resto')")}, '0') AS parent,
    fetched_at, capture_id
  FROM lynx_posts),
lx1 AS (SELECT key, parent FROM lx WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at, capture_id) = 1),
finds AS (SELECT r.own_key, r.key, p.to_id FROM refs r JOIN parents p USING (key) WHERE r.own_key IS NOT NULL),
nodes AS (
  SELECT 'resto' AS h, l.key, p.key AS parent FROM lx1 l LEFT JOIN lx1 p ON p.key = l.parent
  UNION ALL
  SELECT 'quote', coalesce(a.own_key, b.key), a.parent
  FROM (SELECT own_key, arg_min(key, to_id) AS parent FROM finds GROUP BY 1) a FULL JOIN (SELECT DISTINCT key FROM finds) b ON a.own_key = b.key)"""

_SOLVED = f"""{_EDGES},
down AS (
  SELECT h, key, key AS root, 0::BIGINT AS depth, [key] AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.h, n.key, d.root, d.depth + 1, list_append(d.path, n.key) FROM down d JOIN nodes n ON n.h = d.h AND n.parent = d.key)"""

_LOOPS = """,
circ AS (SELECT n.h, n.key, n.parent FROM nodes n ANTI JOIN down d ON d.h = n.h AND d.key = n.key),
reach AS (
  SELECT h, key, parent AS up FROM circ
  UNION
  SELECT r.h, r.key, c.parent FROM reach r JOIN circ c ON c.h = r.h AND c.key = r.up),
onloop AS (SELECT h, key FROM reach WHERE key = up),
rooted AS (
  SELECT r.h, r.key, arg_min(r.up, split_part(r.up, '/', 3)::HUGEINT) AS root
  FROM reach r JOIN onloop o ON o.h = r.h AND o.key = r.up GROUP BY 1, 2)"""


# paths from the first node of a loop, and walks up from a node on or below a loop until a node comes again
_BELOW = """,
inner_circ AS (SELECT c.* FROM circ c ANTI JOIN onloop o ON o.h = c.h AND o.key = c.key),
lp AS (
  SELECT h, key, [key] AS path FROM onloop
  UNION ALL
  SELECT c.h, c.key, list_append(l.path, c.key) FROM lp l JOIN inner_circ c ON c.h = l.h AND c.parent = l.key)"""
_WALKS = """,
walk AS (
  SELECT h, key, parent AS anc, 1::BIGINT AS distance, [key] AS seen FROM circ WHERE parent <> key
  UNION ALL
  SELECT w.h, w.key, c.parent, w.distance + 1, list_append(w.seen, w.anc) FROM walk w JOIN circ c ON c.h = w.h AND c.key = w.anc
  WHERE NOT list_contains(list_append(w.seen, w.anc), c.parent))"""


def p3_found(spark, sf_dir):
    return orphans.orphan_quotes(spark, sf_dir).select("post_id", "quoted_post_native_id", "board")


def p3_report(spark, sf_dir):
    return orphans.orphan_report(spark, sf_dir)


def p3_tables(spark, sf_dir):
    return orphans.tables_report(spark, sf_dir)


def p4_found(spark, sf_dir):
    return hierarchy.reply_trees(spark, sf_dir)


def p4_paths(spark, sf_dir):
    paths = hierarchy.reply_trees(spark, sf_dir, with_path=True)
    return paths.select("hierarchy", "node_key", "root_key", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendants(spark, sf_dir):
    return hierarchy.descendants(hierarchy.reply_trees(spark, sf_dir, with_path=True))


QUERIES = {
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_tables": p3_tables,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
}

SQL = {
    "p3_found": f"WITH {_PLACED} SELECT post_id, quoted_post_native_id, board FROM refs ANTI JOIN parents USING (key)",
    "p3_report": f"""WITH {_PLACED},
      mo AS (SELECT id AS post_id, min(CASE WHEN year(timestamp) > 1970 THEN strftime(timestamp, '%Y-%m') END) AS month FROM posts GROUP BY 1),
      n AS (SELECT month, count(*) AS n FROM post_quotes_1 JOIN mo USING (post_id) GROUP BY 1),
      o AS (SELECT month, count(*) AS n FROM (SELECT * FROM refs ANTI JOIN parents USING (key)) JOIN mo USING (post_id) GROUP BY 1)
      SELECT 'post_quotes' AS table_name, n.month, n.n AS n_references, coalesce(o.n, 0) AS n_orphans
      FROM n LEFT JOIN o ON n.month IS NOT DISTINCT FROM o.month""".replace(
        "post_quotes_1", "(SELECT DISTINCT post_id, quoted_post_native_id, board FROM post_quotes)"
    ),
    "p3_tables": "SELECT table_name, month, count(*) AS n_references, count(*) FILTER (NOT hit) AS n_orphans FROM (" + " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS table_name, {f"CASE WHEN year({ts}) > 1970 THEN strftime({ts}, '%Y-%m') END" if ts else 'NULL::VARCHAR'} AS month, {c} IN (SELECT id FROM {to}) AS hit FROM {t} WHERE {c} IS NOT NULL"
        for t, c, ts, to in orphans.REFERENCES
    ) + ") GROUP BY ALL",
    "p4_found": f"""WITH RECURSIVE {_SOLVED}{_LOOPS}
      SELECT h AS hierarchy, key AS node_key, root AS root_key, depth FROM down
      UNION ALL SELECT h, key, root, -1 FROM rooted""",
    "p4_paths": f"""WITH RECURSIVE {_SOLVED}{_LOOPS}{_BELOW}
      SELECT h AS hierarchy, key AS node_key, root AS root_key, depth, array_to_string(path, ' > ') AS path FROM down
      UNION ALL SELECT h, key, root, -1, array_to_string(path, ' > ') FROM rooted JOIN lp USING (h, key)""",
    "p4_descendants": f"""WITH RECURSIVE {_SOLVED}{_LOOPS}{_WALKS},
      u AS (SELECT h, key, depth, unnest(path) AS anc, generate_subscripts(path, 1) - 1 AS pos FROM down)
      SELECT h AS hierarchy, anc AS node_key, key AS descendant_key, (depth - pos)::BIGINT AS distance FROM u WHERE pos < depth
      UNION ALL SELECT h, anc, key, distance FROM walk""",
}
