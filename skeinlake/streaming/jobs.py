"""Polling loops as streams: each takes new rows once, keeps its place in a checkpoint and can be stopped at any time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge


def hourly_counts(stream: DataFrame, by: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows of each hour and group. Rows later than ``late`` behind the newest are not counted; use output mode update or
    append. Times without a zone are taken as UTC."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 hour"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def sliding_counts(stream: DataFrame, by: str, ts: str = "ts", length: str = "10 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows of each window of ``length`` that starts each ``step``: bursts as they come, to the step's precision."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, length, step), by).agg(F.count("*").alias("n"))


def first_deliveries(stream: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Each key once within the time: repeated deliveries and repeated jobs are dropped. Null keys are equal."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def embed_changes(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, least_bytes: int = 8) -> Any:
    """Embeds new and changed texts (post_id, text) into a parquet table of versions below ``path``, by batches.

    A text is changed if its hash is not the stored one, so unchanged deliveries cost no embedding. Short texts are
    skipped. ``embed`` adds ``embedding`` to post_id, text, text_hash. A failed batch is taken again from the checkpoint.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_version(spark, path, number - 1)
        new = batch.where(F.octet_length("text") >= least_bytes).withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["post_id"])
        if old is not None:
            new = new.join(old.select("post_id", "text_hash"), ["post_id", "text_hash"], "left_anti")
        done = embed(new).select("post_id", "text_hash", "embedding")
        out = done if old is None else merge.upsert(old, done, ["post_id"], {})
        out.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The table after the batch of that number or the last one before it; None before the first."""
    while number >= 0:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number}/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(f"{path}/v{number}")
        number -= 1
    return None


def missing_threads(stream: DataFrame, archive_after: int = 3) -> DataFrame:
    """thread_id, misses, status after each poll of (thread_id, present): misses count up, at so many a thread is archived,
    and one that is seen again is active."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses = state.get[0] if state.exists else 0
        for pdf in batches:
            for present in pdf.sort_values("poll")["present"]:
                misses = 0 if present else misses + 1
        state.update((misses,))
        yield pd.DataFrame({"thread_id": [key[0]], "misses": [misses], "status": ["archived" if misses >= archive_after else "active"]})

    return stream.groupBy("thread_id").applyInPandasWithState(step, "thread_id long, misses int, status string", "misses int", "update", GroupStateTimeout.NoTimeout)


def alerts(stream: DataFrame, threshold: int = 1, cooldown_minutes: int = 60) -> DataFrame:
    """saved_search_id, fired_at, hits: fires when so many hits have gathered and the last alert is long enough ago.

    ``stream``: saved_search_id, post_id, matched_at. Hits within the cooldown gather for the next alert.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gathered, last = state.get if state.exists else (0, None)
        fired: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values(["matched_at", "post_id"])
        for t in rows["matched_at"]:
            gathered += 1
            at = int(pd.Timestamp(t).value // 1000)
            if gathered >= threshold and (last is None or at - last >= cooldown_minutes * 60_000_000):
                fired.append((key[0], pd.Timestamp(t), gathered))
                gathered, last = 0, at
        state.update((gathered, last))
        yield pd.DataFrame(fired, columns=["saved_search_id", "fired_at", "hits"])

    return stream.groupBy("saved_search_id").applyInPandasWithState(step, "saved_search_id long, fired_at timestamp, hits long", "gathered long, last long", "append", GroupStateTimeout.NoTimeout)


def promoted_texts(stream: DataFrame, canonical, threshold: int = 3) -> DataFrame:
    """normalized_text, n of texts that have come up ``threshold`` times, as they do (output mode update)."""
    return stream.select(canonical.alias("normalized_text")).where("normalized_text <> ''").groupBy("normalized_text").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been worked on; unlike a cursor it finds keys that sort before the last one."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
