"""Readers for stored tables, and the schemas they are kept to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import config
from pageloom.functions.urls import robots_txt_url

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
    ]
)

CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("publish_date", T.TimestampType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("reading_time", T.IntegerType()),
        T.StructField("readability_score", T.DoubleType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def as_content(rows: DataFrame) -> DataFrame:
    """``rows`` in the shape of the content table: its columns and types, missing ones null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CONTENT_SCHEMA
        ]
    )


def read_table(
    spark: SparkSession, folder: str, name: str, columns: list[str] | None = None
) -> DataFrame:
    """Scan ``folder/name.parquet``; only ``columns`` where the caller needs a few."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return table.select(*columns) if columns else table


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that arrived as HTML; tables without response columns hold only such pages."""
    rule: Column = F.col("html").isNotNull()
    if "status" in pages.columns:
        rule &= F.col("status") == 200
    if "content_type" in pages.columns:
        rule &= F.col("content_type").contains("text/html")
    return pages.where(rule)


def seed_urls(
    urls: DataFrame, url: str = "url", priority: int = config.DEFAULTS.seed_priority
) -> DataFrame:
    """Frontier rows of seed URLs, taken as written."""
    return urls.select(F.col(url).alias("url"), F.lit(priority).alias("priority"))


def robots_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """The robots.txt address of every host in the table."""
    return urls.select(robots_txt_url(F.col(url)).alias("robots_url")).distinct()


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """``(term, doc_freq)`` over a text column.

    Terms are made distinct inside each row, so the one shuffle carries partial counts per term.
    """
    from pageloom.functions.text import tokens

    return (
        docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"))
    )
