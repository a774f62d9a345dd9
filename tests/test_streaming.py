"""Streams over files, run until nothing is left."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skeinlake.functions import text
from skeinlake.streaming import jobs

T = datetime(2024, 1, 1)


def write(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{n}")


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def run(df, name, checkpoint, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_hourly_counts_drop_late_rows(spark, tmp_path):
    schema = "board string, ts timestamp_ntz"
    write(spark, tmp_path / "in", [("a", T), ("a", T + timedelta(minutes=5)), ("a", T + timedelta(hours=5))], schema, 0)
    out = run(jobs.hourly_counts(source(spark, tmp_path / "in", schema), ["board"]), "hourly", tmp_path / "c", "update")
    assert {(r["window_start"].hour, r["n"]) for r in out.collect()} == {(0, 2), (5, 1)}


def test_first_deliveries(spark, tmp_path):
    schema = "id long, ts timestamp_ntz"
    write(spark, tmp_path / "in", [(1, T), (1, T), (2, T), (None, T), (None, T)], schema, 0)
    out = run(jobs.first_deliveries(source(spark, tmp_path / "in", schema), ["id"]), "firsts", tmp_path / "c", "append")
    assert sorted((r["id"] or 0) for r in out.collect()) == [0, 1, 2]


def test_embed_changes_only(spark, tmp_path):
    schema = "post_id long, text string"
    embed = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float")))
    write(spark, tmp_path / "in", [(1, "first text"), (2, "short"), (3, "third text")], schema, 0)
    jobs.embed_changes(source(spark, tmp_path / "in", schema), embed, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    write(spark, tmp_path / "in", [(1, "first text"), (3, "third text, edited")], schema, 1)
    jobs.embed_changes(source(spark, tmp_path / "in", schema), embed, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    last = jobs.read_version(spark, str(tmp_path / "out"), 99)
    assert {r["post_id"]: r["embedding"][0] for r in last.collect()} == {1: 10.0, 3: 18.0}


def test_missing_threads(spark, tmp_path):
    schema = "thread_id long, poll int, present boolean"
    write(spark, tmp_path / "in", [(1, p, False) for p in range(3)] + [(2, 0, False), (2, 1, True)], schema, 0)
    out = run(jobs.missing_threads(source(spark, tmp_path / "in", schema)), "missing", tmp_path / "c", "update")
    assert {(r["thread_id"], r["misses"], r["status"]) for r in out.collect()} == {(1, 3, "archived"), (2, 0, "active")}


def test_alerts_cool_down(spark, tmp_path):
    schema = "saved_search_id long, post_id long, matched_at timestamp"
    write(spark, tmp_path / "in", [(1, i, T + timedelta(minutes=m)) for i, m in enumerate((0, 10, 20, 75))], schema, 0)
    out = run(jobs.alerts(source(spark, tmp_path / "in", schema)), "alerts", tmp_path / "c", "append")
    assert sorted(r["hits"] for r in out.collect()) == [1, 3]


def test_promoted_texts(spark, tmp_path):
    write(spark, tmp_path / "in", [("Hi there!",), ("hi  there",), ("HI THERE.",), ("other",), ("",), (None,)], "t string", 0)
    out = run(jobs.promoted_texts(source(spark, tmp_path / "in", "t string"), text.canonicalize(F.col("t"))), "promoted", tmp_path / "c", "update")
    assert [tuple(r) for r in out.collect()] == [("hi there", 3)]


def test_sliding_counts_and_unprocessed(spark, tmp_path):
    schema = "key string, ts timestamp_ntz"
    write(spark, tmp_path / "in", [("a", T), ("a", T + timedelta(minutes=3))], schema, 0)
    out = run(jobs.sliding_counts(source(spark, tmp_path / "in", schema), "key"), "sliding", tmp_path / "c", "update")
    assert out.agg(F.max("n")).first()[0] == 2
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert {r[0] for r in jobs.unprocessed(rows, rows.where("k = 'b'"), "k").collect()} == {"a", None}
