"""Merges are idempotent; banded joins and leader clusters equal brute force; other operators at their edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlake import plans
from skeinlake.functions import text
from skeinlake.operators import anomaly, archive, graph, lineage, merge, search, stylometry, trends

T = datetime(2024, 1, 1)


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 5, None), (2, "b", 7, "x"), (None, "n", 1, None)], "k long, v string, n long, note string")
    new = spark.createDataFrame([(1, None, 3, "y"), (3, "c", 1, "z"), (1, None, 3, "y"), (None, "m", 9, None)], "k long, v string, n long, note string")
    out = merge.upsert(old, new, ["k"], {"v": "fill", "n": "max", "note": "keep"}, created="created")
    assert {tuple(r) for r in out.collect()} == {(1, "a", 5, "y", False), (2, "b", 7, "x", False), (3, "c", 1, "z", True), (None, "m", 9, None, False)}
    once = out.drop("created")
    assert {tuple(r) for r in merge.upsert(once, new, ["k"], {"v": "fill", "n": "max", "note": "keep"}).collect()} == {tuple(r) for r in once.collect()}


def test_thread_lifecycle(spark):
    schema = "id long, board_id long, thread_native_id string, status string, missing_count int, last_bump_time timestamp_ntz, first_seen_at timestamp_ntz"
    t = spark.createDataFrame([(1, 1, "10", "active", 0, T, T), (2, 1, "11", "archived", 3, T, T)], schema)
    none = spark.createDataFrame([], "board_id long, thread_native_id string")
    for n in (1, 2, 3):
        t = merge.reconcile(t, none, 3)
        row = {r["id"]: (r["status"], r["missing_count"]) for r in t.collect()}
        assert row[1] == ("archived" if n == 3 else "active", n)
    seen = spark.createDataFrame([(9, 1, "10", "x", 0, None, T)], schema)
    back = {r["thread_native_id"]: r for r in merge.upsert_threads(t, seen).collect()}
    assert (back["10"]["status"], back["10"]["missing_count"], back["10"]["last_bump_time"], back["10"]["created"], back["10"]["id"]) == ("active", 0, T, False, 1)


def test_files_bind_by_md5_then_sha1(spark):
    blobs = spark.createDataFrame([("h1", "m", ""), ("h2", "", "s"), ("h3", "", "")], "file_hash string, platform_md5 string, platform_sha1 string")
    f = spark.createDataFrame([(1, "m", "s", 0), (2, "zz", "s", 4), (3, "", "", 4)], "id long, md5 string, sha1 string, width int")
    assert {r["id"]: (r["file_hash"], r["width"]) for r in merge.bind_files(f, blobs).collect()} == {1: ("h1", None), 2: ("h2", 4), 3: (None, 4)}


def test_near_pairs_and_leaders_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    codes = [r.getrandbits(64) for _ in range(40)]
    for c in codes[:25]:
        for _ in range(3):
            d = c
            for b in r.sample(range(64), r.randint(0, 10)):
                d ^= 1 << b
            codes.append(d)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)) + [(999, None), (None, signed[0])], "blob_id long, code long")
    rep = {i: codes.index(c) for i, c in enumerate(codes)}
    assert {x["member"]: x["rep"] for x in lineage.code_classes(df).collect()} == rep
    own = sorted(set(rep.values()))
    for bands in ((9, 0), (5, 1), (3, 2)):
        monkeypatch.setattr(lineage, "_bands", lambda n, within, width, bands=bands: bands)
        got = lineage.near_pairs(df, 8).collect()
        want = {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in own for j in own if i < j and (codes[i] ^ codes[j]).bit_count() <= 8}
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    low = spark.createDataFrame([(i, c & 0xFFFF) for i, c in enumerate(codes)], "blob_id long, code long")  # most bits unused
    few = [i for i in range(len(codes)) if codes[i] & 0xFFFF not in [c & 0xFFFF for c in codes[:i]]]
    assert {(x["a"], x["b"]) for x in lineage.near_pairs(low, 3).collect()} == {(i, j) for i in few for j in few if i < j and ((codes[i] ^ codes[j]) & 0xFFFF).bit_count() <= 3}
    assert lineage.near_pairs(df.limit(0)).count() == 0
    led, leader = [], {}
    for i in range(len(codes)):
        near = [j for j in led if (codes[i] ^ codes[j]).bit_count() <= 8]
        leader[i] = min(near) if near else i
        if not near:
            led.append(i)
    led_rows, pairs = lineage.clusters(spark, df, 8)
    assert {x["node"]: x["leader"] for x in led_rows.collect()} == leader
    members = led_rows.select("node", F.col("leader").alias("cluster"), (F.col("node") % 7).alias("first_seen"))
    got = {x["node"]: (x["parent"], x["distance"]) for x in lineage.lineage_tree(members, pairs, lineage.code_classes(df)).collect()}
    for i in range(len(codes)):
        near = [((codes[i] ^ codes[j]).bit_count(), j % 7, j) for j in range(len(codes)) if leader[j] == leader[i] and (j % 7, j) < (i % 7, i) and (codes[i] ^ codes[j]).bit_count() <= 8]
        assert got[i] == ((min(near)[2], min(near)[0]) if near else (None, 0))


def test_continuity_and_tree(spark):
    schema = "thread_id long, board_id long, subject string, archived boolean, first_ts timestamp_ntz, last_ts timestamp_ntz, op_text string"
    h = lambda n: T + timedelta(hours=n)
    rows = [(1, 1, "General", True, h(0), h(10), "a b"), (2, 1, "general", False, h(12), h(20), "x y"), (3, 1, "General", False, h(70), h(80), "x"), (4, 2, "General", False, h(12), h(13), "x"), (5, 1, None, True, h(0), None, None)]
    links = lineage.continuity(spark.createDataFrame(rows, schema))
    assert [(r["prev_thread_id"], r["next_thread_id"], r["time_gap_hours"]) for r in links.collect()] == [(1, 2, 2.0)]
    assert [tuple(r) for r in lineage.pointers(links).collect()] == [(1, 2)]
    members = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 2)], "node long, cluster long, first_seen long")
    pairs = spark.createDataFrame([(1, 2, 4), (2, 3, 1), (1, 3, 5)], "a long, b long, distance int")
    assert {r["node"]: r["parent"] for r in lineage.lineage_tree(members, pairs).collect()} == {1: None, 2: 1, 3: 2}


def test_bursts_count_ties_once_each(spark):
    rows = [(1, i, T + timedelta(minutes=m)) for i, m in enumerate((0, 0, 0, 5, 60, 600))] + [(1, 99, None)]
    df = spark.createDataFrame(rows, "user long, id long, ts timestamp_ntz")
    got = {r["id"]: r["count"] for r in anomaly.bursts(df, "user", "id", ratio=0.1, least=1).collect()}
    assert got == {0: 4, 1: 3, 2: 2, 3: 1, 4: 1, 5: 1}


def test_volume_gaps(spark):
    rows = [("a", T + timedelta(hours=i), 1 + i // 2 % 2) for i in range(0, 40, 2)] + [("a", T + timedelta(hours=41), 50)]
    df = spark.createDataFrame(rows, "board string, hour timestamp_ntz, n long")
    assert anomaly.volume(df, "board").count() == 1
    assert anomaly.volume(df, "board").first()["z"] > anomaly.volume(df, "board", fill_gaps=True).first()["z"] > 3


def test_pagerank_keeps_mass(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 1), (5, None), (3, 3)], "source_post_id long, target_post_id long")
    seeds = spark.createDataFrame([(1, 1, 1.0), (1, 7, None), (2, 3, None)], "run_id long, node long, weight double")
    pi = graph.pagerank(spark, e, seeds)
    assert all(abs(r["s"] - 1) < 1e-6 for r in pi.groupBy("run_id").agg(F.sum("score").alias("s")).collect())


def test_edges_of_empty_tables(spark):
    empty = spark.createDataFrame([], "post_id long, embedding array<float>")
    assert search.top(search.scored(empty, [1.0, 0.0]), 3).count() == 0
    assert trends.term_counts(spark.createDataFrame([(1, None), (1, "")], "g long, t string"), ["g"], F.col("t")).count() == 0
    posts = spark.createDataFrame([], "thread_id long, poster string, post_id long, t string")
    assert stylometry.similar(stylometry.weights(posts, text.word_ngrams(F.col("t")))).count() == 0
    assert lineage.leaders(spark, spark.createDataFrame([], "node long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "post_id long, score double")
    b = spark.createDataFrame([(2, 3.0), (3, 2.0)], "post_id long, score double")
    got = [(r["post_id"], round(r["score"], 6)) for r in search.fused(a, b).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]


def test_download_policy_and_sample(spark):
    rows = [(True, True, True), (False, None, False), (None, None, None), (None, True, False)]
    df = spark.createDataFrame(rows, "t boolean, b boolean, s boolean")
    got = [r[0] for r in df.select(archive.download_policy(F.col("t"), F.col("b"), F.col("s"), F.lit(True))).collect()]
    assert got == [False, False, True, True]
    a, b = (archive.sample(spark.range(100), "id", 10, 3).collect() for _ in range(2))
    assert a == b and len(a) == 10


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _titles_alike(a, b):
    x, y = (a or "").lower().strip().encode(), (b or "").lower().strip().encode()
    if not x or not y:
        return 0.0
    if x.startswith(y) or y.startswith(x):
        return round(min(len(x), len(y)) / max(len(x), len(y)), 6)
    return round(1 - _levenshtein(x, y) / max(len(x), len(y)), 6)


def _texts_alike(a, b):
    x, y = (a or "").lower().split(), (b or "").lower().split()
    return round(sum(w in x for w in y) / max(len(x), len(y)), 6) if x and y else 0.0


_ALIEN = ["caf\u00e9 du matin", "Caf\u00e9  du  soir", "\u5929\u6c17 \u306e \u8a71", "\u5929\u6c17\u3000\u306e\u3000\u8a71", "\u3000\u5929\u6c17 \u306e\u3000", "plain words", None, " ", "plain w\u00f6rds", "plain words \U0001f600"]


def test_similarity_queries_take_any_script(spark, tmp_path):
    q, d = plans.queries(), str(tmp_path)
    spark.createDataFrame(list(enumerate(_ALIEN)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    rows = [(i, 1, str(i), s, False, False, True, T) for i, s in enumerate(_ALIEN)]
    spark.createDataFrame(rows, "id long, board_id long, thread_native_id string, subject string, sticky boolean, locked boolean, archived boolean, created_at timestamp_ntz").write.parquet(f"{d}/threads.parquet")
    pairs = [(i, i + 1) for i in range(len(_ALIEN) - 1) if _ALIEN[i] is not None and _ALIEN[i + 1] is not None]
    got = {(r["a"], r["b"]): r["similarity"] for r in q["text_similarity"](spark, d).collect()}
    assert got == {(a, b): _texts_alike(_ALIEN[a], _ALIEN[b]) for a, b in pairs}
    got = {(r["a"], r["b"]): r["similarity"] for r in q["title_similarity"](spark, d).collect()}
    assert got == {(a, b): _titles_alike(_ALIEN[a], _ALIEN[b]) for a, b in pairs if _ALIEN[a].strip(" ") and _ALIEN[b].strip(" ")}


def test_thread_continuity_takes_any_subject_and_opening_posts(spark, monkeypatch):
    subjects = ["\u5929\u6c17\u306e\u8a71 1", "\u5929\u6c17\u306e\u8a71 2", None, "", "apples", "pears"]
    bodies = ["a", "b", "one two three four", "one two three four", "the same text here", "the same text here"]
    rows = [(i, 1, s, True, T + timedelta(hours=3 * i), T + timedelta(hours=3 * i + 1), b) for i, (s, b) in enumerate(zip(subjects, bodies))]
    spans = spark.createDataFrame(rows, "thread_id long, board_id long, subject string, archived boolean, first_ts timestamp_ntz, last_ts timestamp_ntz, op_text string")
    monkeypatch.setattr(plans.reference, "_thread_spans", lambda s, d: spans)
    got = {(r[0], r[1]): r["title_similarity"] for r in plans.queries()["thread_continuity"](spark, "").collect()}
    alike = {(i, j): _titles_alike(subjects[i], subjects[j]) for i in range(6) for j in range(i + 1, 6)}
    assert got == {(i, j): t for (i, j), t in alike.items() if t >= 0.8 or _texts_alike(bodies[i], bodies[j]) >= 0.75}
    assert set(got) == {(0, 1), (2, 3), (4, 5)}


def test_crosspost_queries_use_all_signs(spark, tmp_path):
    r = random.Random(5)
    base = [[r.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(6)]
    flip = lambda v, at: [-x if i in at else x for i, x in enumerate(v)]
    vecs = base + [flip(base[0], range(60, 64)), flip(base[0], range(24, 64)), flip(base[1], range(8)), flip(base[1], range(9)), flip(base[2], [0, 30, 63]), base[3]]
    spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    far = lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(vecs[a], vecs[b]))
    want = {(a, b): far(a, b) for a in range(len(vecs)) for b in range(a + 1, len(vecs)) if far(a, b) <= 8}
    assert {(0, 6), (1, 8), (2, 10), (3, 11), (8, 9)} == set(want)
    q, d = plans.queries(), str(tmp_path)
    want = {p: n for p, n in want.items() if 11 not in p}  # 11 is a copy of 3
    got = q["crosspost_near_pairs"](spark, d).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["distance"] for r in got} == want
    leader = {i: i for i in range(len(vecs))} | {6: 0, 8: 1, 10: 2, 11: 3}
    assert {r["node"]: r["leader"] for r in q["crosspost_clusters"](spark, d).collect()} == leader
    tree = {r["node"]: r["parent"] for r in q["lineage_tree"](spark, d).collect()}
    assert {n: p for n, p in tree.items() if p is not None} == {6: 0, 8: 1, 10: 2, 11: 3}


@pytest.mark.parametrize("large", [2_000_000, 300])
def test_styles_in_threads_equal_the_joins(spark, large, monkeypatch):
    """Threads in a task, or by joins if they are larger, give what joins over all n-grams give."""
    monkeypatch.setattr(stylometry, "LARGE", large)
    said = ["Well, I <b>think</b>  so", "well i THINK not", "\u017elut\u00fd k\u016f\u0148 \U0001f40e je tu", "< <i>>odd", "", "a", "no way to know it", "   ", None]
    posts = [(t, f"u{i % (3 + t)}", 100 * t + i, " ".join(filter(None, (said[(i * (t + 2) + k) % len(said)] for k in range(1 + i % 3)))) if i % 7 else said[i % 9]) for t in range(4) for i in range(9 + 4 * t)]
    df = spark.createDataFrame(posts, "thread_id long, poster string, post_id long, comment_raw string")
    grams = F.concat(text.char_ngrams(F.col("comment_raw")), text.word_ngrams(F.col("comment_raw")))
    want = {tuple(r)[:3]: r["similarity"] for r in stylometry.similar(stylometry.weights(df, grams), 0.05).collect()}
    got = {tuple(r)[:3]: r["similarity"] for r in stylometry.similar_in_threads(spark, df, 0.05).collect()}
    assert len(want) > 5 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
