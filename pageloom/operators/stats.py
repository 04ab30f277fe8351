"""Counts over the content table and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_stats(content: DataFrame, as_of: Column) -> DataFrame:
    """``total_content`` and ``content_today`` (by the date of ``as_of``) in one pass."""
    today = F.to_date("extracted_at") == F.to_date(as_of)
    return content.agg(
        F.count(F.lit(1)).alias("total_content"), F.count_if(today).alias("content_today")
    )


def top_tag_sets(content: DataFrame, sets: int = 10, tags: int = 10) -> DataFrame:
    """Most frequent whole tag lists, taken apart: ``tag, count, position``.

    A tag in several lists appears once for each. Ties of lists go by their text.
    """
    ranked = (
        content.where(F.size("tags") > 0)
        .groupBy("tags")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.array_join("tags", ",", "null"))
        .limit(sets)
    )
    # At most ``sets`` rows are left; numbering their tags in one task costs nothing.
    return (
        ranked.select(
            F.posexplode("tags").alias("at", "tag"),
            "count",
            F.array_join("tags", ",", "null").alias("of"),
        )
        .orderBy(F.desc("count"), "of", "at")
        .limit(tags)
        .select("tag", "count")
    )


def trending_topics(
    index: DataFrame, as_of: Column, days: int = 7, limit: int = 20
) -> DataFrame:
    """Tags of documents indexed in the last ``days``, each document once for each tag."""
    since = as_of - F.make_interval(days=F.lit(days))
    return (
        index.where(F.col("indexed_at") >= since)
        .select(F.explode(F.array_distinct("tags")).alias("topic"))
        .where(F.col("topic").isNotNull())
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "topic")
        .limit(limit)
    )


def index_stats(index: DataFrame, content: DataFrame) -> DataFrame:
    """``total_documents``: size of the index, or of the content table if the index is empty."""
    stored = content.agg(F.count(F.lit(1)).alias("n")).scalar()
    indexed = index.agg(F.count(F.lit(1)).alias("n"))
    return indexed.select(
        F.coalesce(F.nullif("n", F.lit(0)), stored).alias("total_documents")
    )


def crawl_progress(crawled: DataFrame) -> DataFrame:
    """Pages crawled in each round and up to it. One row a round, so the running sum is small."""
    from pyspark.sql import Window as W

    return (
        crawled.groupBy("round")
        .agg(F.count(F.lit(1)).alias("pages"))
        .withColumn("crawled_count", F.sum("pages").over(W.orderBy("round")))
    )
