"""Landing of captured files: pages and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_scan(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: a Parquet table, or a folder of HTML files."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select(
        F.col("path").alias("page_key"), F.col("content").cast("string").alias("html"),
        F.unix_seconds("modificationTime").alias("fetched_epoch"))


def snapshot_manifest(captures: DataFrame, pins: DataFrame) -> DataFrame:
    """Catalogue of captures: ref, kind, source, digest, bytes, time, pin.

    ``captures`` is (kind, source, content, fetched_epoch); ``pins`` is
    (pin, capture_ref). The reference names kind, source, time and whole digest,
    so two captures share one only if they are the same.
    """
    sha = F.sha2("content", 256)
    rows = captures.select(
        F.concat_ws("-", "kind", "source", F.date_format(
            F.timestamp_seconds("fetched_epoch"), "yyyyMMdd'T'HHmmss'Z'"), sha)
        .alias("capture_ref"), "kind", "source", sha.alias("sha256"),
        F.length("content").cast("bigint").alias("bytes"), "fetched_epoch")
    return rows.join(pins, "capture_ref", "left")
