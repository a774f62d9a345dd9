"""Plain files that the archive reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """hash: the lines of a blocklist, in lower case, without comments and blanks."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("hash")).where("hash <> '' and not startswith(hash, '#')").distinct()


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """query_text, post_id of a CSV file with a header; ids are separated by commas."""
    df = spark.read.schema("query_text string, relevant_ids string").option("header", True).option("enforceSchema", False).csv(path)
    return df.select("query_text", F.explode(F.split("relevant_ids", ",")).alias("id")).select("query_text", F.try_to_number(F.trim("id"), F.lit("999999999999999999")).cast("long").alias("post_id")).where("post_id is not null")


def cases_with_judgements(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """Each query with a map of its judged posts to grades, empty where there are none."""
    maps = relevance.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("post_id", "grade")))).alias("judged"))
    return queries.join(maps, queries["id"] == maps["query_id"], "left").select("id", "query_text", F.coalesce("judged", F.create_map().cast("map<bigint,int>")).alias("judged"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """anchor, positive of lines of JSON."""
    return spark.read.schema("anchor string, positive string").json(path).where("anchor is not null and positive is not null")


def write_pairs(df: DataFrame, path: str) -> None:
    df.select("anchor", "positive").write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of evaluations, as CSV with a header. It has a row for each arm and query, so one file holds it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def captures(raw: DataFrame, parser_version: str) -> DataFrame:
    """Rows to append to the log of raw captures: the body with its hash and length, not processed."""
    return raw.select(
        "site_id", "url", "status_code", "body", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").cast("long").alias("content_length"), "fetched_at",
        F.to_date("fetched_at").alias("fetched_on"), F.lit(parser_version).alias("parser_version"), F.lit(False).alias("processed"),
    )


def append_captures(df: DataFrame, path: str) -> None:
    """Appends by day, so that a reader of some days scans only those."""
    df.write.mode("append").partitionBy("fetched_on").parquet(path)


def blob_bytes(spark: SparkSession, files: DataFrame, blobs: DataFrame, root: str) -> DataFrame:
    """post_id, file_hash, content of downloaded files: stored paths joined to the files below ``root``."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"(full/.*)$", 1).alias("storage_path"), "content")
    return files.where("downloaded_full").join(blobs.select("file_hash", "storage_path"), "file_hash").join(stored, "storage_path").select("post_id", "file_hash", "content")
