"""The operators on streams of page edits, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_comments
from ..operators.html import html2wt


def edits(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def edited_markup(stream: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, wikitext of every edit; native expressions hold no state, so any trigger works."""
    return stream.select(key, html2wt(strip_comments(F.col(html))).alias("wikitext"))


def edit_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling windows with a watermark: late rows beyond it are left out, state stays bounded."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def edit_sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_seen(stream: DataFrame, key: str, ts: str = "ts", ttl: str = "5 minutes") -> DataFrame:
    """One row for each key until the time to live has passed: a cache of bounded state."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
