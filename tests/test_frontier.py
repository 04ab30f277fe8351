import hashlib
import random

from pyspark.sql import functions as F

from pageloom.operators import frontier
from pageloom.operators import robots as rb
from pageloom.sources import tables


def queue(spark, rows):
    return spark.createDataFrame(rows, "url string, priority int")


def hashes(spark, urls):
    rows = [(hashlib.md5(u.encode()).hexdigest(),) for u in urls]
    return spark.createDataFrame(rows, "url_hash string")


def pairs(found):
    return sorted(map(tuple, found.select("url", "priority").collect()))


def test_last_priority_wins(spark):
    start = queue(spark, [("a", 10), ("b", 10)])
    added = spark.createDataFrame(
        [("a", 1, 1), ("c", 5, 1), ("c", 2, 2), ("d", 1, 1)], "url string, priority int, seq int"
    )
    got = frontier.add_urls(start, added, hashes(spark, ["d"]))
    assert pairs(got) == [("a", 1), ("b", 10), ("c", 2)]


def test_next_urls(spark):
    rows = queue(spark, [("a", 1), ("c", 1), ("b", 5)])
    got = [r["url"] for r in frontier.next_urls(rows, 2).collect()]
    assert got == ["b", "c"]
    plan = frontier.next_urls(rows, 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_mark_crawled(spark):
    got = frontier.mark_crawled(hashes(spark, ["a", "b"]), queue(spark, [("b", 1), ("c", 1)]))
    assert got.count() == 3


def one_page_at_a_time(seeds, pages, links, most):
    """The strict order: best URL, its links, mark."""
    waiting, crawled, taken = dict(seeds), [], 0
    while waiting and taken < most:
        url = max(waiting, key=lambda u: (waiting[u], u))
        del waiting[url]
        taken += 1
        if url not in pages:
            continue
        for target in links.get(url, []):
            if target not in crawled and target != url:
                waiting[target] = 1
        crawled.append(url)
    return crawled


def graph(spark, seed):
    rng = random.Random(seed)
    names = [f"p{i:02}" for i in range(14)]
    links = {n: [rng.choice(names) for _ in range(2)] for n in names}
    pages = set(names) - {"p03", "p07"}
    frame = spark.createDataFrame([(u,) for u in pages], "url string")
    edges = spark.createDataFrame(
        [(s, d) for s in pages for d in links[s]], "src_url string, dst_url string"
    )
    return pages, links, frame, edges


def test_crawl_in_strict_order(spark):
    pages, links, frame, edges = graph(spark, 2)
    seeds = [("p00", 10), ("p05", 10)]
    for most in (4, 9):
        got = frontier.crawl(queue(spark, seeds), frame, edges, max_pages=most, batch=1)
        order = [r["url"] for r in got.orderBy("round").collect()]
        assert order == one_page_at_a_time(seeds, pages, links, most)


def test_crawl_reaches_all(spark):
    pages, links, frame, edges = graph(spark, 4)
    seeds = [("p00", 10)]
    got = frontier.crawl(queue(spark, seeds), frame, edges)
    everything = one_page_at_a_time(seeds, pages, links, 1000)
    assert sorted(r["url"] for r in got.collect()) == sorted(everything)
    assert frontier.crawl(queue(spark, []), frame, edges).count() == 0


def test_polite_schedule(spark):
    rng = random.Random(1)
    rows = [
        (f"http://{'github.com' if i % 3 else 'reddit.com'}/{i}", rng.randrange(3))
        for i in range(200)
    ]
    got = frontier.polite_schedule(queue(spark, rows)).collect()
    assert len(got) == 200
    for domain, delay in (("github.com", 1.0), ("reddit.com", 3.0)):
        mine = sorted(
            (r for r in rows if domain in r[0]), key=lambda r: (r[1], r[0]), reverse=True
        )
        expected = {url: (i + 1, i * delay) for i, (url, _) in enumerate(mine)}
        assert {
            r["url"]: (r["position"], r["fetch_offset"]) for r in got if r["domain"] == domain
        } == expected


def test_delays(spark):
    rows = spark.createDataFrame([("wikipedia.org",), ("en.wikipedia.org",), (None,)], "d string")
    got = [r[0] for r in rows.select(frontier.rate_limit_delay(F.col("d"), 1.5)).collect()]
    assert got == [0.5, 1.5, 1.5]


BODY = """
# User-agent: *
Sitemap: http://a/top.xml
Disallow: /before
User-agent: bot
  Disallow: /bot # kept
Allow: /open
ALLOW:
Crawl-delay: 2
crawl-delay: soon
Sitemap: http://a/hidden.xml
User-agent: other
Disallow: /other
sitemap: http://a/other.xml
User-agent: one
User-agent: *
Disallow: /all\r
Crawl-delay: 1.5
"""


def parsed(spark, body, **options):
    rows = spark.createDataFrame([("h", body)], "host string, body string")
    return rb.parse_robots(rows, **options).first().asDict()


def test_robots(spark):
    got = parsed(spark, BODY, user_agent="bot")
    assert got["disallowed"] == ["/bot # kept", "/all"]
    assert got["allowed"] == ["/open"]
    assert got["crawl_delay"] == 1.5
    assert got["sitemap"] == ["http://a/top.xml", "http://a/other.xml"]
    everyone = parsed(spark, BODY)
    assert everyone["disallowed"] == ["/all"] and everyone["crawl_delay"] == 1.5
    anywhere = parsed(spark, BODY, user_agent="bot", sitemaps_anywhere=True)
    assert anywhere["sitemap"] == ["http://a/top.xml", "http://a/hidden.xml", "http://a/other.xml"]
    nothing = parsed(spark, None)
    assert nothing["allowed"] == [] and nothing["crawl_delay"] is None


def test_robots_rows(spark):
    rows = spark.createDataFrame([("h", BODY)], "host string, body string")
    got = rb.robots_rules(rows, user_agent="bot").collect()
    assert ("h", "crawl-delay", 0, "1.5") in [tuple(r) for r in got]
    assert [r["value"] for r in sorted(got, key=lambda r: r["position"]) if r["kind"] == "disallow"] == [
        "/bot # kept", "/all",
    ]


def test_seeds(spark):
    urls = spark.createDataFrame([("http://a/x",), ("http://a/y",)], "url string")
    assert pairs(tables.seed_urls(urls)) == [("http://a/x", 10), ("http://a/y", 10)]
    assert tables.robots_urls(urls).collect()[0][0] == "http://a/robots.txt"


def test_strict_order_over_links_in_pages(spark, small):
    from pageloom.operators import extract
    from pageloom.plans import views

    pages = views.linked_pages(spark, small).cache()
    found = extract.links(extract.page_nodes(pages), from_cleaned=False, patterns=None)
    found = found.join(pages.select(F.col("url").alias("dst_url")), "dst_url", "left_semi").cache()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    links = {}
    for r in found.collect():
        links.setdefault(r["src_url"], []).append(r["dst_url"])
    seeds = [(urls[0], 10), (urls[7], 10)]
    got = frontier.crawl(queue(spark, seeds), pages.select("url"), found, max_pages=12, batch=1)
    order = [tuple(r)[:2] for r in got.orderBy("round").select("url", "priority").collect()]
    want = one_page_at_a_time(seeds, set(urls.values()), links, 12)
    assert [u for u, _ in order] == want and len(want) > 8
    assert [p for _, p in order] == [10, 10, *[1] * (len(want) - 2)]


def test_save_crawled(spark, tmp_path):
    from pageloom.sources import store

    text = "<article>" + "word " * 60 + "</article>"
    rows = [("http://a.com/1", text), ("http://a.com/2", text), ("http://a.com/3", "<p>short</p>"), ("http://a.com/4", text + "x")]
    pages = spark.createDataFrame(rows, "url string, html string")
    reached = spark.createDataFrame([(u,) for u, _ in rows[:3]], "url string")
    at = F.lit("2024-01-01").cast("timestamp")
    written = frontier.save_crawled(spark, str(tmp_path / "t"), pages, reached, at)
    assert [r["url"] for r in written.collect()] == ["http://a.com/1"]
    assert store.read_content(spark, str(tmp_path / "t")).count() == 1
