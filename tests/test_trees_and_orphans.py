"""Orphans and hierarchies against brute force, with nulls, repeats, loops and empty tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinlake.operators import hierarchy, orphans


def walk(parents):
    """root, depth of each node, by following parents one at a time."""
    out = {}
    for n in parents:
        path, at = [n], n
        while parents[at] is not None and parents[at] in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        p = parents[at]
        if p is None or p not in parents:
            out[n] = (at, len(path) - 1)
        else:
            out[n] = (min(path[path.index(p) :], key=int), -1)
    return out


def solve(spark, parents):
    rows = [(n, p, int(n)) for n, p in parents.items()]
    df = spark.createDataFrame(rows, "node string, parent string, num long")
    return {r["node"]: (r["root"], r["depth"]) for r in hierarchy.solve(spark, df).collect()}


def test_known_shapes(spark):
    chain = {str(i): str(i - 1) if i else None for i in range(60)}
    assert solve(spark, chain) == walk(chain)
    loops = {"1": "2", "2": "3", "3": "1", "4": "3", "5": "5", "6": "5", "7": "99", "8": "7"}
    assert solve(spark, loops) == walk(loops)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 45), min_size=1, max_size=40))
def test_random_graphs(spark, to):
    parents = {str(i): (None if t > 42 else str(t)) for i, t in enumerate(to)}
    assert solve(spark, parents) == walk(parents)


def test_long_loop_without_splitter_and_paths(spark):
    r = random.Random(3)
    nodes = [str(i) for i in range(300)]
    parents = {n: (r.choice(nodes[: i] or [None]) if i else None) for i, n in enumerate(nodes)}
    df = spark.createDataFrame([(n, p, int(n)) for n, p in parents.items()], "node string, parent string, num long")
    want = walk(parents)
    for row in hierarchy.solve(spark, df, with_path=True).collect():
        assert (row["root"], row["depth"]) == want[row["node"]]
        assert len(row["path"]) == row["depth"] + 1 and row["path"][0] == row["root"] and row["path"][-1] == row["node"]
        assert all(parents[b] == a for a, b in zip(row["path"], row["path"][1:]))


def test_empty_null_and_repeated_nodes(spark):
    schema = "node string, parent string, num long, extra string"
    assert hierarchy.solve(spark, spark.createDataFrame([], schema)).collect() == []
    rows = [("1", None, 1, "a"), ("1", None, 1, "b"), (None, "1", 2, None), ("3", "1", 3, None), ("3", "1", 3, None)]
    got = {r["node"]: (r["root"], r["depth"]) for r in hierarchy.solve(spark, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("1", 0), "3": ("1", 1)}


def test_descendants(spark):
    df = spark.createDataFrame([("r", "a", "1", 0, ["a"]), ("r", "b", "a", 1, ["a", "b"]), ("r", "c", "a", 2, ["a", "b", "c"])], "hierarchy string, node_key string, root_key string, depth long, path array<string>")
    got = {(r["node_key"], r["descendant_key"], r["distance"]) for r in hierarchy.descendants(df).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def climb(parents):
    """Paths and (node, descendant) -> distance, by following parents until a node comes again."""
    paths, pairs = {}, {}
    for n in parents:
        up, at = [n], parents[n]
        while at is not None and at in parents and at not in up:
            up.append(at)
            at = parents[at]
        pairs |= {(a, n): d for d, a in enumerate(up) if d}
        first = up.index(at) if at in up else len(up) - 1  # the first node of the loop, or the root
        on_loop = lambda m: at in up and m in up[first:]
        paths[n] = up[: next(i for i, m in enumerate(up) if on_loop(m) or i == first) + 1][::-1]
    return paths, pairs


@pytest.mark.parametrize("parents", [
    {"1": "2", "2": "3", "3": "1", "4": "3", "5": "4", "6": "4", "7": "7", "8": "7", "9": "8", "10": None, "11": "10", "12": "99", "13": "12"},
    {str(i): str((i * 7 + 3) % 50) if i % 9 else None for i in range(120)},
    {str(i): str(i - 1 if i else 24) if i < 25 else str(i // 2) for i in range(70)},
])
def test_paths_and_descendants_of_loops(spark, parents):
    rows = spark.createDataFrame([(n, p, int(n)) for n, p in parents.items()], "node string, parent string, num long")
    solved = hierarchy.solve(spark, rows, with_path=True)
    paths, pairs = climb(parents)
    assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in solved.collect()} == {n: (*walk(parents)[n], paths[n]) for n in parents}
    got = hierarchy.descendants(solved.select(F.lit("r").alias("hierarchy"), F.col("node").alias("node_key"), F.col("root").alias("root_key"), "depth", "path", "turn")).collect()
    assert len(got) == len(pairs)
    assert {(r["node_key"], r["descendant_key"]): r["distance"] for r in got} == pairs


@pytest.mark.parametrize("parents, targets", [([], ["x", "x", None]), (["a", None, "a"], []), (["a", "b", "ç", "😀", "aa"], ["a", "ç", "é", "😀", "zz", "", None, "aa", "a"])])
def test_missing_keys(spark, parents, targets):
    df = lambda v: spark.createDataFrame([(x, 1) for x in v], "key string, is_target long")
    got = sorted(r[0] for r in orphans.missing_keys(df(parents), df(targets)).collect())
    assert got == sorted({t for t in targets if t is not None} - set(parents))


def test_missing_keys_with_a_hot_key(spark):
    targets = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    parents = spark.range(0, 20_000, 2).select(F.col("id").cast("string").alias("key"))
    got = {r[0] for r in orphans.missing_keys(parents, targets).collect()}
    assert got == {"hot"} | {str(i) for i in range(20_000) if i % 3 and i % 2}


def _archive(spark, path, posts, quotes, threads=((1, 1, "10"), (2, 2, "20")), lynx=()):
    spark.createDataFrame([(1, 3, "tek"), (2, 3, "rnd")], "id long, site_id long, code string").write.parquet(f"{path}/boards.parquet")
    spark.createDataFrame(list(threads), "id long, board_id long, thread_native_id string").write.parquet(f"{path}/threads.parquet")
    spark.createDataFrame(posts, "id long, thread_id long, post_native_id string, timestamp timestamp_ntz").write.parquet(f"{path}/posts.parquet")
    spark.createDataFrame(quotes, "post_id long, quoted_post_native_id string, board string").write.parquet(f"{path}/post_quotes.parquet")
    spark.createDataFrame(list(lynx), "capture_id long, site_id long, board string, body string, fetched_at timestamp_ntz").write.parquet(f"{path}/lynx_posts.parquet")
    return str(path)


def test_spellings_of_numbers_and_boards(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 5, 1)
    posts = [(1, 1, "10", t), (1, 1, "10", t), (2, 1, "11", t), (3, 2, "20", datetime(1970, 1, 1))]
    quotes = [(2, " 0010 ", ""), (2, "20", " /RND/ "), (2, "20", ""), (2, "x", ""), (2, None, ""), (2, "10", None), (9, "10", ""), (3, "11", "zzz"), (2, "99", ""), (2, "99", "")]
    d = _archive(spark, tmp_path, posts, quotes)
    got = {tuple(r) for r in orphans.orphan_quotes(spark, d).select("post_id", "quoted_post_native_id", "board").collect()}
    assert got == {(2, "20", ""), (2, "x", ""), (2, None, ""), (3, "11", "zzz"), (2, "99", "")}
    report = {r["month"]: (r["n_references"], r["n_orphans"]) for r in orphans.orphan_report(spark, d).collect()}
    assert report == {"2024-05": (7, 4), None: (1, 1)}
    trees = {(r["hierarchy"], r["node_key"]): (r["root_key"], r["depth"]) for r in hierarchy.reply_trees(spark, d).collect()}
    assert trees == {("quote", "3/tek/10"): ("3/tek/10", 0), ("quote", "3/tek/11"): ("3/tek/10", 1), ("quote", "3/rnd/20"): ("3/rnd/20", 0)}


def test_empty_archive(spark, tmp_path):
    d = _archive(spark, tmp_path, [], [])
    assert orphans.orphan_quotes(spark, d).count() == 0 and orphans.orphan_report(spark, d).count() == 0
    assert hierarchy.reply_trees(spark, d).count() == 0


def test_hot_missing_keys_and_long_keys(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PER_TASK", 10)
    refs = spark.createDataFrame([(i, "gone" if i % 3 == 0 else f"k{i}") for i in range(150)] + [(1000, "x" * 500), (1001, "y" * 500), (1002, None)], "id long, key string")
    parents = spark.createDataFrame([(f"k{i}",) for i in range(0, 150, 2)] + [("x" * 500,), (None,)], "key string")
    missing = orphans.missing_keys(parents, refs)
    got = sorted(r["id"] for r in orphans.with_missing(refs.where("key is not null"), missing, "id").collect())
    assert got == sorted([i for i in range(150) if i % 3 == 0 or i % 2] + [1001])


def test_report_of_any_tables(spark):
    from datetime import datetime

    refs = spark.createDataFrame([("a.x", "1", datetime(2024, 5, 1)), ("a.x", "1", datetime(2024, 5, 2)), ("a.x", "2", None), ("b.y", "1", datetime(1970, 1, 1)), ("b.y", None, None)], "table_name string, key string, ts timestamp_ntz")
    parents = spark.createDataFrame([("a.x", "2"), ("b.y", "7")], "table_name string, key string")
    got = {(r["table_name"], r["month"]): (r["n_references"], r["n_orphans"]) for r in orphans.report(refs, parents).collect()}
    assert got == {("a.x", "2024-05"): (2, 2), ("a.x", None): (1, 0), ("b.y", None): (1, 1)}
    assert orphans.report(refs.limit(0), parents).count() == 0
