from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import workers
from pageloom.operators import extract
from pageloom.sources import tables

LONG = "long words " * 30


def page(spark, html, url="http://a.com/dir/page"):
    return extract.page_nodes(spark.createDataFrame([(url, html)], "url string, html string"))


def record(spark, html, **options):
    found = extract.content_records(page(spark, html), **options).collect()
    return found[0].asDict() if found else None


def test_full_record(spark):
    html = f"""<!doctype html><html><head><title>Tab &amp; name</title>
    <meta name="description" content="  What it is ">
    <meta property="og:description" content="other"></head>
    <body class="page"><header><h1>Site</h1></header><nav><a href="/article/nav">n</a></nav>
    <article><h1> Real <i>title</i> </h1><!-- note --><p>{LONG}</p>
    <div class="Shadow-box">hidden</div><script>var x = "<p>no</p>"</script>
    <span class="byline"></span><span class="post-author">Ann</span>
    <time datetime="2024-05-01T10:00:00Z">May</time>
    <div class="tags"><a>x</a><a>y</a><a>x</a></div><b class="tag">z</b></article></body></html>"""
    got = record(spark, html)
    assert got["title"] == "Realtitle"
    assert got["description"] == "What it is"
    assert got["author"] == "Ann"
    assert got["publish_date"] == datetime(2024, 5, 1, 10)
    assert got["tags"] == ["x", "y", "z"]
    assert got["content"].startswith("Realtitlelong words")
    assert "hidden" not in got["content"] and "note" not in got["content"]
    assert got["word_count"] == len(got["content"].split())
    assert got["reading_time"] == 1


@pytest.mark.parametrize(
    "html",
    [
        f'<div role="main">{LONG}</div>',
        f'<div class="x content">{LONG}</div>',
        f'<div id="content">{LONG}</div>',
        f'<div class="post-content">{LONG}</div>',
        f'<div class="entry-content">{LONG}</div>',
        f'<section class="article-body">{LONG}</section>',
        f"<body>{LONG}</body>",
        f"<p>{LONG}</p>",
    ],
)
def test_content_selectors(spark, html):
    assert record(spark, html)["content"] == LONG.strip()


def test_only_first_match_is_tried(spark):
    html = f"<article>short</article><article>{LONG}</article><p>{'w' * 51}</p><p>few</p>"
    assert record(spark, html)["content"] == "w" * 51


def test_open_paragraphs_nest(spark):
    one, two = "a" * 60, "b" * 60
    assert record(spark, f"<p>{one}<p>{two}")["content"] == f"{one}{two} {two}"


def test_page_without_text_is_dropped(spark):
    assert record(spark, "<p>short</p>") is None
    assert record(spark, f'<body class="loaded">{LONG}</body>') is None
    assert record(spark, "") is None
    assert record(spark, None) is None


def test_end_tags(spark):
    # An unknown end tag is ignored; an end tag closes what is open inside its element.
    html = f"</div><article><b>{LONG}<i>x</article>outside"
    assert record(spark, html)["content"] == LONG.strip() + "x"


def test_title_falls_back(spark):
    assert record(spark, f"<title> T </title><h1> </h1><p>{LONG}")["title"] == "T"
    assert record(spark, f'<p class="title">C</p><p>{LONG}')["title"] == "C"
    assert record(spark, f'<meta property="og:title" content="M"><p>{LONG}')["title"] is None


def test_author_needs_exact_rel(spark):
    text = f'<a rel="author nofollow">A</a><a rel=" author ">B</a><p>{LONG}'
    assert record(spark, text)["author"] == "B"


def test_date_order(spark):
    meta = '<meta property="article:published_time" content="2024-01-02">'
    later = '<time datetime="2024-03-04">x</time>'
    assert record(spark, f"{later}{meta}<p>{LONG}")["publish_date"] == datetime(2024, 1, 2)
    # The first date text found ends the search even if it cannot be read.
    bad = '<span class="date">soon</span><time>2024-03-04</time>'
    assert record(spark, f"{bad}<p>{LONG}")["publish_date"] is None


def test_at_most_ten_tags(spark):
    tags = "".join(f'<b class="tag">t{i}</b>' for i in range(12))
    assert record(spark, f"{tags}<p>{LONG}")["tags"] == [f"t{i}" for i in range(10)]


def test_separator_and_template(spark):
    html = f"<article>{LONG}<b>one</b><b>two</b><template>no</template></article>"
    assert record(spark, html)["content"].endswith("onetwo")
    assert record(spark, html, separator=" ")["content"].endswith("one two")


def test_links(spark):
    html = """<nav><a href="/news/nav">n</a></nav><a href="/article/1#f">1</a><a>none</a>
    <a href="../blog/2?ref=x&a=1">2</a><a href="/article/x.pdf">pdf</a><a href="/other">o</a>
    <a href="/article/1">again</a><a href="mailto:x@y.z">m</a>"""
    nodes = page(spark, html)
    got = sorted(r["dst_url"] for r in extract.links(nodes).collect())
    assert got == ["http://a.com/article/1"] * 2 + ["http://a.com/blog/2?a=1"]
    everything = extract.links(nodes, from_cleaned=False, patterns=None).count()
    assert everything == 5


def test_fetched_and_useful(spark):
    pages = spark.createDataFrame(
        [("a", "x", 200, "text/html; charset=utf-8"), ("b", "x", 404, "text/html"),
         ("c", "x", 200, "image/png"), ("d", None, 200, "text/html")],
        tables.PAGE_SCHEMA,
    )
    assert [r["url"] for r in tables.fetched(pages).collect()] == ["a"]
    rows = spark.createDataFrame([("a" * 99,), ("a" * 100,), (None,)], "content string")
    assert extract.useful(rows).count() == 1
    assert extract.useful(rows, 10).agg(F.count("*")).first()[0] == 2


def test_broken_and_deep_pages_take_no_square_of_time(spark):
    import time

    from pageloom.functions.workers import NodeReader

    start = time.process_time()
    for html in ("<div>" * 20_000 + "</section>" * 20_000, "<p>" * 20_000 + "x", "<i>a</b>" * 20_000):
        NodeReader("", frozenset(), None).read(html)
    assert time.process_time() - start < 5
    many = "<article>" + "".join(f"<p>{'word ' * 12}{i}</p>" for i in range(5_000)) + "</article>"
    pages = spark.createDataFrame([("http://a.com/x", many.replace("article", "div"))], "url string, html string")
    record = extract.extract_pages(pages).first()
    assert record["content"].startswith("word word") and record["word_count"] == 5_000 * 13


def test_few_pages_are_held_as_nodes_at_a_time():
    html = "<p>" + "<b>x</b> " * 20_000 + "</p>"
    batch = pa.RecordBatch.from_pydict({"url": ["u"] * 12, "_url": ["u"] * 12, "html": [html] * 12})
    parts = list(workers.node_batches(["url"], (), ())(iter([batch])))
    assert [p.num_rows for p in parts] == [2] * 6
    assert max(p.nbytes for p in parts) < 30 * 2 * len(html)
