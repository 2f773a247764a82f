"""Streams of pages: the parser is stateless per page, so it runs on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.kernel.config import SiteConfig
from quillspark.operators.parse import Engine

PAGE_DDL = "page_id bigint, title string, rev_id string, wikitext string, rev_ts timestamp, loaded_at timestamp"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(PAGE_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_revisions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (page_id, rev_id) once; repeats later than the delay behind the newest load may come through again."""
    known = stream.withColumn("rev_id", F.coalesce("rev_id", F.lit("")))
    return known.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["page_id", "rev_id"])


def token_stream(stream: DataFrame, config: SiteConfig | None = None) -> DataFrame:
    """Token rows of a stream of pages; a page that fails gives one row of kind ``error`` and the stream goes on."""
    return Engine(stream.sparkSession, config).parsed(stream, page_col="title")


def revisions_per_window(stream: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, revisions, pages): loads per window; what comes later than the delay is left out."""
    return stream.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window)).agg(F.count("*").alias("revisions"), F.approx_count_distinct("page_id").alias("pages")).select("window.start", "revisions", "pages")
