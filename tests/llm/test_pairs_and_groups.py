"""Near duplicates, components, splits and nearest vectors against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA, compare, connect
from pyspark.sql import functions as F

from skeinlake.llm import components, near_duplicates, neighbours, plans, splits

data = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test data")


def jaccard_pairs(texts, threshold, least):
    sets = {k: set(near_duplicates.words(t)) for k, t in texts.items()}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def edited(r, base, n):
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    r.shuffle(w)
    return " ".join(w)


def corpus(seed=1):
    r = random.Random(seed)
    texts, key = {}, 1
    for _ in range(25):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(24, 80)))
        for n in (0, 0, 2, 5, 12):
            texts[key] = edited(r, base, n) if n else base
            key += 1
    texts[key] = "few words only"
    return texts


def frame(spark, texts):
    rows = [(k, t, "x") for k, t in texts.items()]
    return spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1], "x"), (9999, None, "x"), (9998, "", "x")], "id long, comment_raw string, rep string")


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in near_duplicates.pairs(spark, frame(spark, texts), "id", "comment_raw").collect()}
    want = jaccard_pairs(texts, 0.7, 24)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_groups_hold_every_taking_part_text_once(spark):
    texts = corpus(2)
    rows = near_duplicates.groups(spark, frame(spark, texts), "id", "comment_raw").collect()
    part = {k for k, t in texts.items() if len(near_duplicates.words(t)) >= 24}
    assert sorted(r["id"] for r in rows) == sorted(part)
    group = {r["id"]: r["group"] for r in rows}
    found = {tuple(r) for r in near_duplicates.pairs(spark, frame(spark, texts), "id", "comment_raw").collect()}
    assert all(group[a] == group[b] for a, b in found)


def test_many_copies_of_one_text(spark):
    text = " ".join(f"c{i}" for i in range(40))
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("t"))
    rows = near_duplicates.groups(spark, df, "id", "t").collect()
    assert len(rows) == 1000 and {r["group"] for r in rows} == {0} and {r["links"] for r in rows} == {0}


def test_words_and_estimate():
    assert near_duplicates.words('<b>Ab</b>c &gt;&gt;123 >>>/tek/9 caf&eacute; ab_2') == ["ab", "c", "café", "2"]
    assert near_duplicates.words(None) == [] and near_duplicates.words("") == []
    r = random.Random(4)
    base = [f"a{i}" for i in range(200)]
    other = base[:150] + [f"b{i}" for i in range(50)]
    _, _, sig = near_duplicates.signatures([base, other])
    x = (int(v) for v in (sig[0] ^ sig[1]).view(np.uint64))
    same = sum(32 - ((v | v >> 1) & 0x5555555555555555).bit_count() for v in x)
    assert abs((same / 256 - 0.25) / 0.75 - 150 / 250) < 0.12 and r


def naive_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed, n, m", [(1, 30, 20), (2, 300, 320), (3, 2000, 1500)])
def test_components_equal_union_find(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 200)] + [(5000, i) for i in range(6000, 6300)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges] + [(None, 1, 1), (7, None, 1), (8, 8, 1)], "a long, b long, root long").repartition(7)
    want = {k: v for k, v in naive_roots([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["root"] for r in components.components(spark, df).collect()} == want


def test_components_of_nothing(spark):
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def naive_assign(sizes, shares):
    total = sum(sizes)
    below = [s * total for s in shares]
    out = []
    for s in sorted(sizes, reverse=True):
        k = max(range(len(shares)), key=lambda i: (below[i], -i))
        below[k] -= s
        out.append(k)
    return below


def test_greedy_shares_match_the_loop():
    r = random.Random(6)
    sizes = [r.randint(1, 9) for _ in range(3000)] + [500, 40, 40, 7]
    values, counts = np.unique(sizes, return_counts=True)
    got = splits.assign(values[::-1], counts[::-1], splits.SHARES)
    total = sum(sizes)
    left = np.array(splits.SHARES) * total - sum(g * v for g, v in zip(got, values[::-1].tolist()))
    assert all((g >= 0).all() for g in got) and [int(g.sum()) for g in got] == counts[::-1].tolist()
    assert np.allclose(sorted(left), sorted(naive_assign(sizes, splits.SHARES)), atol=3)


def test_group_splits(spark):
    groups = spark.range(1000).select(F.col("id").alias("group"), (F.col("id") % 4).alias("size"), F.lit("q").alias("split"))
    rows = splits.group_splits(spark, groups).collect()
    assert len(rows) == 1000
    posts = {k: sum(r["size"] for r in rows if r["split"] == k) for k in splits.SPLITS}
    assert posts["train"] == pytest.approx(1200, abs=4) and posts["test"] == pytest.approx(150, abs=4)
    assert splits.group_splits(spark, groups.limit(0)).count() == 0


@data
def test_threads_keep_together(spark):
    compare(spark, "p2_found", plans.p2_found, plans.oracle_sql()["p2_found"])
    rows = plans.p2_splits(spark, str(DATA / "sf0.001")).collect()
    split = {r["thread_id"]: r["split"] for r in rows}
    assert len(split) == len(rows)
    assert all(split[a] == split[b] for a, b in plans.p2_found(spark, str(DATA / "sf0.001")).collect())


@data
def test_neighbours_on_the_smallest_table(spark):
    got = {tuple(r) for r in plans.p7_found(spark, str(DATA / "sf0.001")).collect()}
    every = plans._SQL["p7_exact"].replace("AND a.post_id <> b.post_id WHERE a.post_id % 20 = 0", "AND a.post_id <> b.post_id")
    want = {(min(q, c), max(q, c)) for q, c, _ in connect("sf0.001").execute(every).fetchall()}
    assert len(got & want) >= 0.9 * len(want)


def test_word_sets_meet_whatever_the_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_duplicates, "HOT", 5)
    rng = random.Random(3)
    for _ in range(200):
        k = sorted(x for j in range(rng.randint(1, 8)) for x in [rng.randint(-9, 9)] * rng.choice((1, 1, 2, 3, 5, 6, 12)))
        rows = [(x, i) for i, x in enumerate(k)]
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(0, 6)
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[at : at + n]], pa.int64()) for j in (0, 1)], names=["k", "h"]))
            at += n
        got = [tuple(r.values()) for b in near_duplicates._meet(iter(batches)) for r in b.to_pylist()]
        count = {x: k.count(x) for x in k}
        want = {(x, i, True) for x, i in rows if count[x] > 5} | {(i, j, False) for x, i in rows for y, j in rows if x == y and i < j and count[x] <= 5}
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_bands_lose_no_link(spark, monkeypatch):
    """A template with small edits: many differing word sets share bands, which are split."""
    rng = random.Random(9)
    base = [f"word{i}" for i in range(40)]
    texts = [(i, " ".join(w if rng.random() > 0.04 else f"x{rng.randrange(999)}" for w in base)) for i in range(120)]
    texts += [(200 + i, " ".join(f"y{rng.randrange(9999)}" for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(texts, "id long, text string")
    whole = {tuple(r) for r in near_duplicates.pairs(spark, df, "id", "text").collect()}
    monkeypatch.setattr(near_duplicates, "HOT", 8)
    split = {tuple(r) for r in near_duplicates.pairs(spark, df, "id", "text").collect()}
    assert split == whole and len(whole) > 1000


def exact_nearest(rows, k):
    out = {}
    for p, v, m in rows:
        s = []
        for q, w, n in rows:
            if q != p and n == m:
                a, b = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                s.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), q))
        out[p] = [q for _, q in sorted(s)[:k]]
    return out


def test_neighbours_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=384).astype(np.float32).round(2) for _ in range(12)]
    rows = [(i, [float(x) for x in base[i % 12]], "m1" if i < 30 else "m2") for i in range(40)]
    odd = [(100, [0.0] * 384, "m1"), (101, [1.0] * 10, "m1"), (102, None, "m1"), (None, rows[0][1], "m1"), (103, [None] + [1.0] * 383, "m1"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "post_id long, embedding array<float>, model_version string, rank int")
    got: dict = {}
    for r in neighbours.nearest(spark, df).orderBy("post_id", "rank").collect():
        got.setdefault(r["post_id"], []).append(r["neighbour"])
    assert got == exact_nearest(rows, 5)
    assert neighbours.nearest(spark, df.limit(0)).count() == 0


def test_hot_vector(spark):
    """A third of all rows share one vector: each has its smallest fellows."""
    rng = np.random.default_rng(4)
    hot = [float(x) for x in rng.normal(size=384)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(size=384)], "m") for i in range(300)]
    df = spark.createDataFrame(rows, "post_id long, embedding array<float>, model_version string")
    got = {}
    for r in neighbours.nearest(spark, df).collect():
        got.setdefault(r["post_id"], set()).add(r["neighbour"])
    assert got[0] == {3, 6, 9, 12, 15} and got[3] == {0, 6, 9, 12, 15} and got[297] == {0, 3, 6, 9, 12}


@pytest.mark.parametrize("n, block", [(40, 1 << 15), (700, 64)])
def test_rounds_retrieve_each_code_within_reach_once(n, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "KEPT", 10_000)
    rng = np.random.default_rng(n)
    words = rng.integers(-(1 << 63), 1 << 63, (n, 2), dtype=np.int64)
    words[n // 2 :] = words[: n - n // 2] ^ (1 << rng.integers(0, 62, (n - n // 2, 2))) ^ (1 << rng.integers(0, 62, (n - n // 2, 2)))
    shape, ids = neighbours.Shape(n), np.arange(n)
    assert (shape.high > 0) == (block == 64)
    bits = neighbours._bits(words[:, 0].copy(), words[:, 1].copy())
    apart = (bits[:, None, :] != bits[None]).sum(2)
    flips_of = np.stack([(bits[:, None, a:b] != bits[None, :, a:b]).sum(2) for a, b in zip(shape.edges, shape.edges[1:])])
    met: list = []
    for flips in (1, 2):
        for j in range(shape.m):
            prefix = shape.substring(bits, j) >> shape.low(j)
            for p in np.unique(prefix):
                held = prefix == p
                b = neighbours._Block(int(p) | j << 32, shape, ids[held], words[held, 0], words[held, 1])
                for used in range(min(flips, shape.high) + 1):
                    asks = np.bitwise_count(prefix ^ p) == used
                    q, c, d = b.ask(ids[asks], words[asks, 0].copy(), words[asks, 1].copy(), used, flips)
                    assert (d == apart[q, c]).all()
                    met += zip(q.tolist(), c.tolist())
        assert (flips_of.min(0) <= flips)[apart <= shape.reach(flips)].all()
        want = {(i, k) for i, k in np.argwhere(apart <= shape.reach(flips)).tolist() if i != k}
        assert len(met) == len(set(met)) and set(met) == want


def test_hot_cluster_is_split(spark, monkeypatch):
    """A third of all rows are much alike, and no block may hold them."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "VECTORS", 64)
    rng = np.random.default_rng(5)
    heart = rng.normal(size=384)
    ways = rng.normal(size=(6, 384))
    rows = [(i, [float(x) for x in (heart + 0.4 * rng.normal(size=6) @ ways if i % 3 == 0 else rng.normal(size=384)).astype(np.float32)], "m") for i in range(400)]
    df = spark.createDataFrame(rows, "post_id long, embedding array<float>, model_version string")
    got: dict = {}
    for r in neighbours.nearest(spark, df).collect():
        got.setdefault(r["post_id"], set()).add(r["neighbour"])
    want = exact_nearest([(i, v, m) for i, v, m in rows if i % 3 == 0], 5)
    assert sum(len(got[i] & set(w)) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))


@data
def test_recall_against_brute_force(spark):
    compare(spark, "p7_exact", plans.p7_exact, plans.oracle_sql()["p7_exact"])
    want = {(r["post_id"], r["neighbour"]) for r in plans.p7_exact(spark, str(DATA / "sf0.01")).collect()}
    got = {(r["post_id"], r["neighbour"]) for r in plans.p7_neighbours(spark, str(DATA / "sf0.01")).where("post_id % 20 = 0").collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_dense_cluster_is_complete(spark, monkeypatch):
    """Vectors around one point, whose codes can't tell which is nearest: none of the exact lists is missed."""
    monkeypatch.setattr(neighbours, "VECTORS", 64)
    monkeypatch.setattr(neighbours, "TILE", (1, 2))
    rng = np.random.default_rng(6)
    heart = rng.normal(size=384)
    rows = [(i, [float(x) for x in (heart + 0.3 * rng.normal(size=384) if i % 2 else rng.normal(size=384)).astype(np.float32)], "m") for i in range(600)]
    df = spark.createDataFrame(rows, "post_id long, embedding array<float>, model_version string")
    got: dict = {}
    for r in neighbours.nearest(spark, df).orderBy("post_id", "rank").collect():
        got.setdefault(r["post_id"], []).append(r["neighbour"])
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = -np.round(x @ x.T, 6)
    np.fill_diagonal(s, 9)
    assert got == {i: np.argsort(s[i], kind="stable")[:5].tolist() for i in range(600)}


def test_bounds_keep_every_pair_that_reaches_a_limit():
    """Odd vectors, of which rounding to 16 bits takes most, and tiles of few rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 384)) * np.exp(3 * rng.normal(size=(90, 384)))
    x[60:] = x[:30] + 1e-3 * rng.normal(size=(30, 384))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    axes = neighbours.learn(x)[1]
    limit, tiles = np.full(90, -2, dtype=np.float32), []
    for rows in (slice(0, 87), slice(87, 90)):
        w, scale, lost = neighbours._packed(x[rows])
        table = pa.table({"id": np.arange(90)[rows], "w": w, "scale": scale, "lost": lost})
        own = neighbours._Tile(table, axes)
        limit[own.ids] = own.limits(5)
        tiles.append(table.append_column("limit", pa.array(limit[rows])))
    a, b = (neighbours._Tile(t, axes) for t in tiles)
    met = [tuple(sorted(p)) for one, two in ((a, a), (a, b), (b, b)) for q, c in one.meet(two) for p in zip(q.tolist(), c.tolist())]
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    fifth = np.sort(s, axis=1)[:, -5]
    assert (limit <= fifth).all() and (limit[87:] == -2).all() and len(met) == len(set(met))
    assert {(min(p), max(p)) for p in np.argwhere(s >= fifth[:, None] - 1e-6).tolist()} <= set(met)
