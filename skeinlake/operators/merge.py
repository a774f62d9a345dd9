"""Keyed merges: parquet tables take no MERGE, so a merge is a join and a rule for each column.

Rules say what a column is when the key is on both sides: ``new``, ``old``, ``fill`` (new, else old), ``keep`` (old, else new),
``max``, ``min``, ``or``, ``sum``, or a function of (old, new). A key on one side only keeps its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import first_per

Rule = str | Callable[[Column, Column], Column]

RULES: dict[str, Callable[[Column, Column], Column]] = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(new, old),
    "keep": lambda old, new: F.coalesce(old, new),
    "max": lambda old, new: F.greatest(old, new),
    "min": lambda old, new: F.least(old, new),
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "sum": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, Rule], order: list[Column] | None = None, created: str | None = None) -> DataFrame:
    """The merged table, with the target's columns (and ``created``, whether the key is new, if named).

    The source is reduced to one row for each key, the first by ``order``. Null keys are equal to each other. Columns
    without a rule take the source's value; columns that the source lacks keep the target's.
    """
    one = first_per(source, keys, order, 1, "_first").drop("_first") if order else source.dropDuplicates(keys)
    old = target.select(*(F.col(c).alias(f"_o_{c}") for c in target.columns), F.lit(True).alias("_old"))
    new = one.select(*(F.col(c).alias(f"_n_{c}") for c in one.columns), F.lit(True).alias("_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
    joined = old.join(new, on, "full")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = []
    for c in target.columns:
        o = F.col(f"_o_{c}")
        if c not in one.columns:
            out.append(o.alias(c))
            continue
        n = F.col(f"_n_{c}")
        rule = rules.get(c, "new")
        both = (RULES[rule] if isinstance(rule, str) else rule)(o, n)
        kind = target.schema[c].dataType
        out.append(F.when(is_old & is_new, both).when(is_new, n).otherwise(o).cast(kind).alias(c))
    if created:
        out.append((~is_old).alias(created))
    return joined.select(*out)


def replace_sets(target: DataFrame, source: DataFrame, owner: str) -> DataFrame:
    """All rows of each owner in the source replace the owner's rows in the target; repeated rows count once."""
    return target.join(source.select(owner).distinct(), owner, "left_anti").unionByName(source.select(*target.columns).distinct())


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those source rows whose key it lacks."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert_threads(threads: DataFrame, seen: DataFrame) -> DataFrame:
    """Threads after a poll: metadata of the poll, the last known bump, no misses, archived ones alive again; created."""
    return upsert(
        threads, seen, ["board_id", "thread_native_id"],
        {"id": "keep", "last_bump_time": "fill", "missing_count": lambda o, n: F.lit(0), "status": lambda o, n: F.lit("active"), "first_seen_at": "keep"}, created="created",
    )


def upsert_posts(posts: DataFrame, seen: DataFrame) -> DataFrame:
    """Posts after a poll: empty texts are null, and a changed comment is to be embedded again."""
    texts = ("author_name", "tripcode", "poster_id", "comment_raw", "country", "flag")
    seen = seen.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts if c in seen.columns})
    before = posts.select("thread_id", "post_native_id", F.col("comment_raw").alias("_before"), F.lit(True).alias("_known"))
    seen = seen.join(before, ["thread_id", "post_native_id"], "left")
    seen = seen.withColumn("pending_embedding", F.col("_known").isNull() | ~F.col("_before").eqNullSafe(F.col("comment_raw"))).drop("_before", "_known")
    return upsert(posts, seen, ["thread_id", "post_native_id"], {"id": "keep", "pending_embedding": "or", "created_at": "keep"})


def bind_files(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files with the blob of their MD5, else of their SHA-1; blank digests match nothing. Sizes of 0 or less are unknown."""
    md5 = blobs.where("platform_md5 <> ''").groupBy(F.col("platform_md5").alias("md5")).agg(F.min("file_hash").alias("_by_md5"))
    sha1 = blobs.where("platform_sha1 <> ''").groupBy(F.col("platform_sha1").alias("sha1")).agg(F.min("file_hash").alias("_by_sha1"))
    out = files.join(md5, "md5", "left").join(sha1, "sha1", "left")
    known = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("width", "height") if c in files.columns}
    return out.withColumn("file_hash", F.coalesce("_by_md5", "_by_sha1")).withColumns(known).drop("_by_md5", "_by_sha1")


def record_downloads(blobs: DataFrame, downloads: DataFrame) -> DataFrame:
    """Blobs after downloads (file_hash, mime_type, size_bytes, newly_full): one reference more for each newly full file."""
    per = downloads.groupBy("file_hash").agg(F.max("mime_type").alias("mime_type"), F.max("size_bytes").alias("size_bytes"), F.count_if("newly_full").alias("ref_count"))
    return upsert(blobs, per, ["file_hash"], {"mime_type": "keep", "size_bytes": "max", "ref_count": "sum"})


def reconcile(threads: DataFrame, catalog: DataFrame, archive_after: int = 3) -> DataFrame:
    """Active threads missing from their board's catalog miss once more, and are archived at so many misses; others at 0."""
    keys = ["board_id", "thread_native_id"]
    present = catalog.select(*keys).distinct().withColumn("_in", F.lit(True))
    out = threads.join(present, keys, "left")
    active = F.col("status") == "active"
    misses = F.when(~active, F.col("missing_count")).when(F.col("_in"), 0).otherwise(F.col("missing_count") + 1)
    return out.withColumn("missing_count", misses.cast("int")).withColumn("status", F.when((F.col("status") == "active") & (F.col("missing_count") >= archive_after), "archived").otherwise(F.col("status"))).select(*threads.columns)


def promote(texts: DataFrame, canonical: Column, threshold: int = 3, ts: str = "ts") -> DataFrame:
    """Canonical texts that occur ``threshold`` times or more, with their counts and first and last time."""
    out = texts.select(canonical.alias("normalized_text"), ts).where("normalized_text <> ''").groupBy("normalized_text")
    return out.agg(F.count("*").alias("ref_count"), F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at")).where(F.col("ref_count") >= threshold)


def overriding_union(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``override`` and those of ``base`` whose key it lacks."""
    return override.unionByName(base.join(override.select(*keys), keys, "left_anti"))


def due_alerts(alerts: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """Enabled alerts with as many new hits as their threshold whose cooldown is over; new since the search's last run.

    ``alerts``: alert_id, saved_search_id, threshold, cooldown_minutes, enabled, last_triggered, last_evaluated.
    """
    new = alerts.join(hits, "saved_search_id").where(F.col("last_evaluated").isNull() | (F.col("matched_at") > F.col("last_evaluated")))
    n = new.groupBy("alert_id").agg(F.count("*").alias("hit_count"), F.sort_array(F.collect_set("post_id")).alias("new_post_ids"))
    cool = F.col("last_triggered").isNull() | (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_triggered").cast("timestamp")) >= F.col("cooldown_minutes").cast("long") * 60_000_000)
    return alerts.where("enabled").join(n, "alert_id").where(cool & (F.col("hit_count") >= F.col("threshold"))).select("alert_id", "saved_search_id", "hit_count", "new_post_ids")
