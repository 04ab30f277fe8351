"""Queries over the content table: recent, by topic, ranked substring search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom import config

COLUMNS = (
    "url", "title", "description", "content", "author", "publish_date", "tags",
    "word_count", "reading_time", "readability_score", "extracted_at",
)


def _shown(content: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in content.columns]


def recent_content(content: DataFrame, limit: int = 50) -> DataFrame:
    """The newest records; ties by url."""
    return (
        content.select(*_shown(content)).orderBy(F.desc("extracted_at"), F.asc("url")).limit(limit)
    )


def _contains(column: str, topic: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the topic act as wildcards."""
    return F.coalesce(F.col(column).ilike(f"%{topic}%"), F.lit(False))


def about(topic: str) -> Column:
    """The topic occurs in a tag, the title or the text."""
    in_tag = F.exists("tags", lambda t: t.ilike(f"%{topic}%"))
    return (
        F.coalesce(in_tag, F.lit(False)) | _contains("title", topic) | _contains("content", topic)
    )


def content_by_topic(content: DataFrame, topic: str, limit: int = 50) -> DataFrame:
    """The newest records about a topic."""
    return recent_content(content.where(about(topic)), limit)


def content_by_topics(
    content: DataFrame, topics: Sequence[str], limit: int = config.DEFAULTS.max_feed_items
) -> DataFrame:
    """The newest records of each topic, in one pass: ``topic``, ``rank`` and the record.

    Topics are arguments, so each row tests them itself and no join is needed. The rank limit is
    applied before the shuffle too, so a topic that fits every row sends ``limit`` rows a task.
    """
    matched = F.array_compact(F.array(*[F.when(about(t), F.lit(t)) for t in topics]))
    newest = W.partitionBy("topic").orderBy(F.desc("extracted_at"), F.asc("url"))
    return (
        content.select(*_shown(content), F.explode(matched).alias("topic"))
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit)
    )


def search_content(content: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Substring search: matches in the title first, then description, then text; newest first."""
    in_title, in_description = _contains("title", query), _contains("description", query)
    place = F.when(in_title, 1).when(in_description, 2).otherwise(3)
    return (
        content.where(in_title | in_description | _contains("content", query))
        .select(*_shown(content), place.alias("place"))
        .orderBy("place", F.desc("extracted_at"), "url")
        .limit(limit)
        .drop("place")
    )
