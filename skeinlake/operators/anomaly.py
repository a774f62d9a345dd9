"""Unusual volume, bursts and coordinated posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import misc


def volume(counts: DataFrame, by: str, at: str = "hour", n: str = "n", z: float = 3.0, least_hours: int = 12, least_history: int = 6, fill_gaps: bool = False) -> DataFrame:
    """Groups whose latest hour is unusual: z-score against the mean and population deviation of the hours before it.

    Hours without rows are not part of the history, unless ``fill_gaps`` counts them as 0.
    """
    if fill_gaps:
        span = counts.groupBy(by).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).select(by, F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias(at))
        counts = span.join(counts, [by, at], "left").select(by, at, F.coalesce(n, F.lit(0)).alias(n))
    last = counts.groupBy(by).agg(F.max(at).alias("_last"), F.count("*").alias("hours"), F.max_by(n, at).alias("current"))
    joined = counts.join(last, by)
    before = joined.where(F.col(at) < F.col("_last")).groupBy(by).agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"), F.count("*").alias("history"))
    out = last.join(before, by).where((F.col("hours") >= least_hours) & (F.col("history") >= least_history) & (F.col("sd") > 0))
    return out.select(by, F.col("_last").alias(at), "current", "mean", "sd", ((F.col("current") - F.col("mean")) / F.col("sd")).alias("z")).where(F.col("z") >= z)


def all_hours(counts: DataFrame, by: str, n: str = "n", z: float = 3.0) -> DataFrame:
    """Every hour whose z-score against the group's mean and deviation reaches z."""
    w = Window.partitionBy(by)
    out = counts.withColumn("mean", F.avg(n).over(w)).withColumn("sd", F.stddev_pop(n).over(w))
    return out.where(F.col("sd") > 0).withColumn("z", (F.col(n) - F.col("mean")) / F.col("sd")).where(F.col("z") >= z)


def bursts(rows: DataFrame, by: str, key: str, ts: str = "ts", minutes: float = 10.0, ratio: float = 5.0, least: int = 3) -> DataFrame:
    """Rows from which many follow: how many of the group lie within ``minutes`` after, both ends included, and how many
    times as many that is as the group's hourly rate lets expect.

    Rows of equal time follow each other by key, so each counts those at or after its place.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    span = int(minutes * 60e6)
    reach = Window.partitionBy(by).orderBy(t).rangeBetween(Window.unboundedPreceding, span)
    place = Window.partitionBy(by).orderBy(t, key)
    everything = Window.partitionBy(by)
    out = rows.where(F.col(ts).isNotNull()).select(by, key, ts, (F.count("*").over(reach) - F.row_number().over(place) + 1).alias("count"), F.count("*").over(everything).alias("n"), F.min(ts).over(everything).alias("lo"), F.max(ts).over(everything).alias("hi"))
    rate = F.col("n") / F.greatest(misc.hours_between(F.col("hi"), F.col("lo")), F.lit(1.0))
    out = out.withColumn("ratio", F.col("count") / (rate * (minutes / 60)))
    return out.where((F.col("count") >= least) & (F.col("ratio") >= ratio)).select(by, key, ts, "count", "ratio")


def coordinated(crossposts: DataFrame, as_of: Column, spread: int = 3, minutes: float = 60.0, recent_hours: float = 24.0) -> DataFrame:
    """Crossposts that reached ``spread`` posts within ``minutes``, and were last seen recently."""
    span = misc.hours_between(F.col("last_seen_at"), F.col("first_seen_at")) * 60
    recent = misc.hours_between(as_of, F.col("last_seen_at")) <= recent_hours
    return crossposts.where((F.col("spread_count") >= spread) & (span <= minutes) & recent).withColumn("span_minutes", span)


def events(volumes: DataFrame, bursts_: DataFrame, coordination: DataFrame) -> DataFrame:
    """kind, subject, severity, details (JSON): the three kinds of anomaly as one table."""
    row = lambda df, kind, subject, value, *fields: df.select(
        F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), misc.severity(F.lit(kind), F.col(value).cast("double")).alias("severity"), F.to_json(F.struct(*fields)).alias("details")
    )
    return row(volumes, "volume", volumes.columns[0], "z", "current", "mean", "sd", "z").unionByName(row(bursts_, "burst", bursts_.columns[0], "ratio", "count", "ratio")).unionByName(
        row(coordination, "coordination", "file_hash", "spread_count", "spread_count", "span_minutes")
    )
