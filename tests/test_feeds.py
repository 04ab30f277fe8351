import json
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import content as ct
from pageloom.operators import feeds, stats
from pageloom.plans import views as vw
from pageloom.session import new_path

ROWS = [
    ("http://a/1?x=1&y=2", "A <b> & c", "d1", 'text "one"', "ann", datetime(2024, 1, 1), ["x", "é&"], datetime(2024, 2, 1)),
    ("http://a/2", None, None, "two", None, None, [], datetime(2024, 2, 3)),
    ("http://a/3", "Third X", "d3", "three", "", datetime(2024, 1, 3, 4, 5, 6), ["x"], datetime(2024, 2, 2)),
]
SCHEMA = (
    "url string, title string, description string, content string, author string,"
    " publish_date timestamp, tags array<string>, extracted_at timestamp"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_rss(rows):
    ranked = feeds.with_rank(ct.recent_content(rows))
    text = feeds.rss_feed(ranked, vw.moment("2024-03-01 00:00:00")).first()["feed"]
    channel = ET.fromstring(text.encode()).find("channel")
    assert channel.findtext("title") == "Web Crawler Feed"
    assert channel.findtext("description") == "Curated content from web crawling"
    assert channel.findtext("link") == "https://example.com"
    assert channel.findtext("lastBuildDate") == "Fri, 01 Mar 2024 00:00:00 GMT"
    items = channel.findall("item")
    assert [i.findtext("link") for i in items] == ["http://a/2", "http://a/3", "http://a/1?x=1&y=2"]
    assert items[2].findtext("guid") == "http://a/1?x=1&y=2"
    assert items[2].findtext("title") == "A <b> & c"
    assert [c.text for c in items[2].findall("category")] == ["x", "é&"]
    assert items[1].findtext("pubDate") == "Wed, 03 Jan 2024 04:05:06 GMT"
    assert items[0].findtext("title") == "Untitled" and items[0].find("author") is None
    assert items[0].find("description") is not None and items[0].find("pubDate") is None
    assert items[1].find("author") is None and items[2].findtext("author") == "ann"


def test_json(rows):
    ranked = feeds.with_rank(ct.recent_content(rows))
    feed = json.loads(feeds.json_feed(ranked).first()["feed"])
    assert feed["version"] == "https://jsonfeed.org/version/1.1"
    assert feed["feed_url"] == "https://example.com/feed.json"
    last = feed["items"][2]
    assert last == {
        "id": "http://a/1?x=1&y=2",
        "url": "http://a/1?x=1&y=2",
        "title": "A <b> & c",
        "content_text": 'text "one"',
        "summary": "d1",
        "date_published": "2024-01-01T00:00:00",
        "tags": ["x", "é&"],
        "authors": [{"name": "ann"}],
    }
    first = feed["items"][0]
    assert first["date_published"] is None and first["tags"] == [] and "authors" not in first


def test_empty_feed(rows):
    none = feeds.with_rank(rows.where("url = ''"))
    assert json.loads(feeds.json_feed(none).first()["feed"])["items"] == []
    text = feeds.rss_feed(none, vw.moment(vw.EPOCH)).first()["feed"]
    assert ET.fromstring(text.encode()).find("channel/item") is None


def test_topic_feeds(spark, rows):
    ranked = ct.content_by_topics(rows, ["x", "TWO", "none"], limit=1)
    got = {r["topic"]: r["url"] for r in ranked.collect()}
    assert got == {"x": "http://a/3", "TWO": "http://a/2"}
    both = feeds.json_feed(ranked, "topic")
    path = new_path(spark, "feeds")
    feeds.write_feeds(both, path, ["topic"])
    files = spark.read.text(path, wholetext=True).collect()
    assert {r["topic"]: json.loads(r["value"])["items"][0]["url"] for r in files} == got


def test_content_queries(rows):
    assert [r["url"] for r in ct.search_content(rows, "t%e").collect()] == ["http://a/3", "http://a/1?x=1&y=2"]
    assert [r["url"] for r in ct.search_content(rows, "D_").collect()] == [
        "http://a/3", "http://a/1?x=1&y=2",
    ]
    assert [r["url"] for r in ct.content_by_topic(rows, "É").collect()] == ["http://a/1?x=1&y=2"]


def test_stats(rows):
    got = stats.content_stats(rows, vw.moment("2024-02-02 23:00:00")).first()
    assert tuple(got) == (3, 1)
    tags = [tuple(r) for r in stats.top_tag_sets(rows).collect()]
    assert tags == [("x", 1), ("x", 1), ("é&", 1)]
    index = rows.select(F.col("extracted_at").alias("indexed_at"), F.array_repeat("url", 2).alias("tags"))
    got = stats.trending_topics(index, vw.moment("2024-02-08 00:00:00"), days=6)
    assert [tuple(r) for r in got.collect()] == [("http://a/2", 1), ("http://a/3", 1)]
