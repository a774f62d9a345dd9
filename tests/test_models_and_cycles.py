"""Embedders, workers, image hashes and the periodic jobs."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.functions import text, vectors
from skeinlake.operators import cycles, models

T = datetime(2024, 1, 1)


def test_embedder_equals_the_expression(spark):
    df = spark.createDataFrame([(1, "Hello big world"), (2, "Hello big world"), (3, "tiny"), (4, None)], "post_id long, text string")
    got = {r["post_id"]: r for r in models.embed(df, models.HashedWords()).collect()}
    assert set(got) == {1, 2} and got[1]["embedding"] == got[2]["embedding"] and got[1]["model_version"] == "hashed-words"
    same = df.where("post_id = 1").select(vectors.hashed_vector(F.split(F.lower("text"), " ")).alias("v")).first()["v"]
    assert np.allclose(got[1]["embedding"], same)


def test_pooling():
    states = np.array([[[1.0, 0.0], [3.0, 0.0], [9.0, 9.0]]])
    assert np.allclose(models.mean_pool(states, np.array([[1, 1, 0]])), [[1.0, 0.0]])
    assert np.allclose(models.mean_pool(states, np.zeros((1, 3))), [[0.0, 0.0]])
    ids, mask = models.rectangular([[1, 2], [3]])
    assert ids.tolist() == [[1, 2], [3, 0]] and mask.tolist() == [[1, 1], [1, 0]]


def test_vocabulary(tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": {"[UNK]": 0}}}))
    assert models.vocabulary(str(tmp_path / "t.json")) == {"[UNK]": 0}
    (tmp_path / "u.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": {}}}))
    with pytest.raises(ValueError):
        models.vocabulary(str(tmp_path / "u.json"))


def test_image_hashes(spark):
    r = np.random.default_rng(1)
    image = np.cumsum(np.cumsum(r.normal(size=(40, 60)), 0), 1)
    near = image + r.normal(size=image.shape) * 0.05
    other = np.cumsum(np.cumsum(r.normal(size=(40, 60)), 0), 1)
    for f in models.HASHES.values():
        bits = lambda a, b: ((f(a) ^ f(b)) & (2**64 - 1)).bit_count()
        assert bits(image, image) == 0 and bits(image, near) <= 8 < bits(image, other)
    df = spark.createDataFrame([("a", 60, image.ravel().tolist()), ("b", 7, [1.0]), ("c", None, None)], "blob_id string, width int, pixels array<double>")
    got = models.image_hashes(df).collect()
    assert {(x["blob_id"], x["algo"]) for x in got} == {("a", n) for n in models.HASHES}


def test_worker_failures_do_not_stop_others(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, None)], "post_id long, content binary")

    def process(content):
        if content == b"bad":
            raise ValueError("no image")
        return content.decode()

    got = {r["post_id"]: (r["text"], r["error"]) for r in models.run_worker(df, "ocr", process).collect()}
    assert got == {1: ("ok", None), 2: (None, "no image"), 3: (None, None)}


def test_ocr_confidence(spark):
    line = lambda c: "\t".join(["x"] * 10 + [c, "w"])
    df = spark.createDataFrame([("\n".join([line("conf"), line("90"), line("-1"), line("70.5")]),), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(models.ocr_confidence(F.col("t"))).collect()][:2] == [80.25, 0.0]


def test_context(spark):
    e = spark.createDataFrame([(2, 1), (2, 3), (3, None)], "source_post_id long, target_post_id long")
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "post_id long, text string")
    assert {r["post_id"]: r["text"] for r in models.with_context(e, t).collect()} == {1: "a", 2: "a [SEP] b", 3: "c"}


def test_crosspost_cycle(spark):
    uses = spark.createDataFrame([("a", 1, 1, 1, T), ("a", 2, 2, 1, T), ("b", 3, 3, 2, T + timedelta(hours=1)), ("c", 4, 1, 1, T)], "file_hash string, post_id long, board_id long, site_id long, ts timestamp_ntz")
    codes = spark.createDataFrame([("a", 0), ("b", 7), ("c", -1)], "blob_id string, code long")
    got = {(r["file_hash"], r["match_type"]): r["post_ids"] for r in cycles.crosspost_cycle(spark, uses, codes).collect()}
    assert got == {("a", "exact"): [1, 2], ("a", "near"): [1, 2, 3]}


def test_searches_boards_and_canonical(spark):
    wide = spark.createDataFrame([(1, "tek", T, "old kettle"), (2, "rnd", T, "x")], "post_id long, board string, ts timestamp_ntz, comment_raw string")
    none = spark.createDataFrame([], "post_id long, mime string, filename string, quoted_post_native_id string")
    hits, mistakes = cycles.saved_searches([(1, "board:tek"), (2, "colour:red"), (3, "old kettle")], wide, none, none)
    assert {tuple(r)[:2] for r in hits.collect()} == {(1, 1), (3, 1)} and set(mistakes) == {2}
    again = cycles.record_hits(hits, hits)
    assert again.count() == 2
    boards = spark.createDataFrame([(5, 1, "g", "Old", False, True)], "id long, site_id long, code string, title string, nsfw boolean, worksafe boolean")
    listed = spark.createDataFrame([("g", None, True), ("h", "New", False)], "code string, title string, nsfw boolean")
    assert {r["code"]: (r["id"], r["title"], r["worksafe"]) for r in cycles.discovered_boards(boards, listed, 1).collect()} == {"g": (5, "Old", False), "h": (None, "New", True)}
    texts = spark.createDataFrame([(1, "Hi!"), (2, "new")], "post_id long, t string")
    known = spark.createDataFrame([("hi", [1.0])], "normalized_text string, embedding array<float>")
    have, rest = cycles.canonical_vectors(texts, known, text.canonicalize(F.col("t")))
    assert [r["post_id"] for r in have.collect()] == [1] and [r["post_id"] for r in rest.collect()] == [2]


def test_arms(spark):
    wide = spark.createDataFrame([(i, f"kettle {i}") for i in range(6)], "post_id long, comment_raw string")
    v = spark.createDataFrame([(i, [float(i == j) + 0.01 for j in range(64)]) for i in range(6)], "post_id long, embedding array<float>")
    found = cycles.arms(wide, wide, {"plain": v, "context": v, "struct": v})
    q = ([float(j == 3) for j in range(64)], "kettle 3")
    assert len(found) == 13 and all(run(q, 2)[0] == 3 for name, run in found.items() if not name.startswith("candidates_"))
