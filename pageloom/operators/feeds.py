"""RSS 2.0 and JSON Feed 1.1 documents, for the whole table or for each topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions.text import iso_date, rss_date

_D = config.DEFAULTS


def _title() -> Column:
    return F.coalesce("title", F.lit("Untitled"))


def rss_items(content: DataFrame, *keep: str) -> DataFrame:
    """Fields of an RSS item for each record; ``guid`` is the url, ``category`` the tags."""
    return content.select(
        *keep,
        _title().alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("url").alias("link"),
        F.col("url").alias("guid"),
        rss_date(F.col("publish_date")).alias("pubDate"),
        F.nullif("author", F.lit("")).alias("author"),
        F.col("tags").alias("category"),
    )


def json_items(content: DataFrame, *keep: str) -> DataFrame:
    """Fields of a JSON feed item for each record; ``authors`` is null without an author."""
    return content.select(
        *keep,
        F.col("url").alias("id"),
        "url",
        _title().alias("title"),
        F.coalesce("content", F.lit("")).alias("content_text"),
        F.coalesce("description", F.lit("")).alias("summary"),
        iso_date(F.col("publish_date")).alias("date_published"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("author") != "", F.array(F.struct(F.col("author").alias("name")))).alias(
            "authors"
        ),
    )


def _joined(items: DataFrame, text: Column, separator: str, group: str | None) -> DataFrame:
    """Item texts of each feed in rank order, the first ``max_feed_items`` of them."""
    rows = items.where(F.col("rank") <= config.DEFAULTS.max_feed_items).select(*([group] if group else []), F.struct("rank", text.alias("text")).alias("i"))
    collected = F.array_join(
        F.transform(F.sort_array(F.collect_list("i")), lambda i: i["text"]), separator
    ).alias("items")
    return rows.groupBy(group).agg(collected) if group else rows.agg(collected)


def _xml(tag: str, value: str | Column) -> Column:
    text = F.lit(value) if isinstance(value, str) else value
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


def rss_feed(ranked: DataFrame, built_at: Column, group: str | None = None) -> DataFrame:
    """One RSS document as ``feed``, or one for each ``group``. ``ranked`` holds the records of
    the feed with their ``rank``."""
    keep = ["rank"] + ([group] if group else [])
    items = rss_items(ranked, *keep)
    names = ("title", "description", "link", "guid", "pubDate", "author", "category")
    item = F.to_xml(F.struct(*names), {"rowTag": "item"})
    head = F.concat_ws(
        "\n",
        F.lit('<?xml version="1.0" ?>\n<rss version="2.0">\n<channel>'),
        _xml("title", _D.feed_title),
        _xml("description", _D.feed_description),
        _xml("link", _D.feed_home),
        _xml("lastBuildDate", rss_date(built_at)),
    )
    document = F.concat_ws("\n", head, "items", F.lit("</channel>\n</rss>\n"))
    joined = _joined(items, item, "\n", group)
    return joined.select(*([group] if group else []), document.alias("feed"))


def json_feed(ranked: DataFrame, group: str | None = None) -> DataFrame:
    """One JSON Feed document as ``feed``, or one for each ``group``."""
    keep = ["rank"] + ([group] if group else [])
    items = json_items(ranked, *keep)
    # Null fields stay, but an item without an author has no such field at all.
    names = ("id", "url", "title", "content_text", "summary", "date_published", "tags")
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    item = F.when(F.col("authors").isNull(), body).otherwise(
        F.concat(
            F.substring(body, F.lit(1), F.length(body) - 1),
            F.lit(',"authors":'),
            F.to_json("authors"),
            F.lit("}"),
        )
    )
    head = F.to_json(
        F.struct(
            F.lit("https://jsonfeed.org/version/1.1").alias("version"),
            F.lit(_D.feed_title).alias("title"),
            F.lit(_D.feed_description).alias("description"),
            F.lit(_D.feed_home).alias("home_page_url"),
            F.lit(_D.feed_url).alias("feed_url"),
        )
    )
    document = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"items":['),
        F.col("items"),
        F.lit("]}"),
    )
    joined = _joined(items, item, ",", group)
    return joined.select(*([group] if group else []), document.alias("feed"))


def with_rank(recent: DataFrame, size: int = config.DEFAULTS.max_feed_items) -> DataFrame:
    """The newest ``size`` records, ranked."""
    from pyspark.sql import Window as W

    order = [F.desc("extracted_at"), F.asc("url")]
    return recent.orderBy(*order).limit(size).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def write_feeds(feeds: DataFrame, path: str, groups: Sequence[str] = ()) -> None:
    """Feed documents as text, one file for each in a folder for its group."""
    writer = feeds.select(*groups, "feed").write.mode("overwrite")
    (writer.partitionBy(*groups) if groups else writer).text(path)
