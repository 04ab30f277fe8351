import hashlib
from datetime import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import arrays, text as tx, urls as ux


def one(spark, value, make, kind="string"):
    """``make`` applied to a column holding one value."""
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def many(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    found = rows.select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


def test_normalize_url(spark):
    golden = {
        "http://a.com/x/?q=1&flag&REF=2#f": "http://a.com/x/?q=1",
        "http://a.com//": "http://a.com",
        "http://a.com?utm_source=x": "http://a.com",
        "http://a.com/p;v=1?b=2/": "http://a.com/p;v=1?b=2",
        "http://a.com/?x=http://y/#z?q=1": "http://a.com/?x=http://y",
        "HTTP://A.com/B": "http://A.com/B",
        "http://a.com/p;": "http://a.com/p",
        "http://a.com/p;a;": "http://a.com/p;a;",
        "http://a.com/?a=1&UTM_Medium=2&a=3": "http://a.com/?a=1&a=3",
    }
    assert many(spark, golden, ux.normalize_url) == list(golden.values())
    again = many(spark, golden.values(), ux.normalize_url)
    assert again == list(golden.values())


def test_valid_url(spark):
    golden = {
        "http://a.com": True,
        "https://a.b-c.org:8080/x?y": True,
        "HTTP://LOCALHOST/x": True,
        "http://999.1.1.1/": True,
        "http://a.com.": True,
        "http://a.technology": False,
        "ftp://a.com": False,
        "http://user@a.com": False,
        "http://a.com/x y": False,
        "http://a.com/x y": False,
        "http://-a.com": False,
        "": False,
        None: False,
    }
    assert many(spark, golden, ux.is_valid_url) == list(golden.values())


def test_crawl_filter(spark):
    golden = {
        "http://a.com/article/1": True,
        "http://a.com/ARTICLE/1": True,
        "http://a.com/article/1.PDF": False,
        "http://a.com/article/1.pdf;v=2?x": False,
        "http://a.com/article/?f=1.pdf": True,
        "http://a.com/x?u=/blog/": True,
        "http://a.com/x": False,
        "/article/1": False,
    }
    assert many(spark, golden, ux.is_crawl_candidate) == list(golden.values())


def test_rules_blocked_beats_allowed(spark):
    rule = lambda u: ux.should_crawl_url(u, ["a.com"], ["/x"], ["/x/private"])
    golden = {
        "http://a.com/x/1": True,
        "http://A.com/X/1": True,
        "http://a.com/x/PRIVATE": False,
        "http://a.com/y": False,
        "http://b.com/x": False,
    }
    assert many(spark, golden, rule) == list(golden.values())


def test_domains(spark):
    urls = ["http://A.com:80/x", "//h/x", "mailto:x", "http://h?q", None]
    assert many(spark, urls, ux.url_domain) == ["a.com:80", "h", "", "h", None]
    assert many(spark, urls, ux.url_netloc) == ["A.com:80", "h", "", "h", None]
    same = lambda u: ux.is_same_domain(u, F.lit("http://a.COM:80/z"))
    assert many(spark, urls, same) == [True, False, False, False, False]
    assert one(spark, "https://a.com/x?y", ux.robots_txt_url) == "https://a.com/robots.txt"


def test_domain_info(spark):
    urls = spark.createDataFrame(
        [("http://www.news.a.co.uk:80/x",), ("http://a.com",), ("http://com",), ("http://x.zz/",),
         ("http://localhost:8080/",), ("http://u@1.2.3.4:5/",)],
        "url string",
    )
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",)], "suffix string")
    got = {r["url"]: tuple(r["info"]) for r in ux.domain_info(urls, suffixes).collect()}
    assert got == {
        "http://www.news.a.co.uk:80/x": ("a", "www.news", "co.uk", "a.co.uk"),
        "http://a.com": ("a", "", "com", "a.com"),
        "http://com": ("", "", "com", ""),
        "http://x.zz/": ("zz", "x", "", ""),
        "http://localhost:8080/": ("localhost", "", "", ""),
        "http://u@1.2.3.4:5/": ("1.2.3.4", "", "", ""),
    }


def test_resolve_url(spark):
    base = "http://a.com/b/c?d"
    hrefs = ["x", "/x", "../../x", "//h/x", "?q", "#f", "", "mailto:m", "http://z/./y", ";p"]
    got = many(spark, hrefs, lambda h: ux.resolve_url(F.lit(base), h))
    assert got == [urljoin(base, h) for h in hrefs]
    assert one(spark, "http://[x", lambda h: ux.resolve_url(F.lit(base), h)) is None


def test_more_date_spellings(spark):
    golden = {
        "2024-1-5": "2024-01-05 00:00", "2024-01-05T10:00:00+0200": "2024-01-05 08:00",
        "2024-01-05 10:00:00 UTC": "2024-01-05 10:00", "5 January 2024 10:30": "2024-01-05 10:30",
        "January 5, 2024 3:30 PM": "2024-01-05 15:30", "Sept 5, 2024": "2024-09-05 00:00",
        "05.01.2024": "2024-01-05 00:00", "5th of May": None,
    }
    shown = lambda t: F.date_format(tx.parse_date(t), "yyyy-MM-dd HH:mm")
    assert many(spark, golden, shown) == list(golden.values())


def test_highlights_in_any_script(spark):
    pattern = tx.hit_pattern(F.array(F.lit("über"), F.lit("été")))
    text = "Über ÜBER über uber Été"
    got = one(spark, text, lambda t: tx.highlight(t, pattern, 100, 1))
    assert got == ["<em>Über</em> <em>ÜBER</em> <em>über</em> uber <em>Été</em>"]


def test_clean_text(spark):
    golden = {
        " a \t\n b ": "a b",
        "a & b": "a  b",
        "naïve_1 – (x)!": "naïve_1  (x)!",
        "a \x1cb": "a b",
        "café": "cafe",
        "": "",
        None: "",
    }
    assert many(spark, golden, tx.clean_text) == list(golden.values())


def test_keywords(spark):
    text = "Zeta alpha, zeta! beta beta ALPHA gamma this that cat dog1 dogs_ über straße delta"
    assert one(spark, text, tx.keywords) == ["zeta", "alpha", "beta", "gamma", "delta"]
    assert one(spark, text, lambda t: tx.keywords(t, 2)) == ["zeta", "alpha"]
    assert one(spark, None, tx.keywords) == []


def test_value_counts(spark):
    got = one(spark, ["b", "a", "b", "c", "b"], arrays.value_counts, "array<string>")
    assert [tuple(r) for r in got] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, [], arrays.value_counts, "array<string>") == []


@pytest.mark.parametrize("words, floor, even", [(1, 1, 1), (399, 1, 2), (500, 2, 2), (700, 3, 4)])
def test_reading_time(spark, words, floor, even):
    text = "w " * words
    assert one(spark, text, lambda t: tx.reading_time(tx.word_count(t))) == floor
    assert one(spark, text, tx.estimate_reading_time) == even
    assert one(spark, "", tx.estimate_reading_time) == 0


def test_truncate(spark):
    cut = lambda n: lambda t: tx.truncate_text(t, n)
    assert one(spark, "ab cd ef", cut(8)) == "ab cd ef"
    assert one(spark, "ab cd ef", cut(7)) == "ab cd..."
    assert one(spark, "abcdefgh", cut(4)) == "abcd..."
    assert one(spark, " bcdefgh", cut(4)) == " bcd..."
    assert one(spark, None, cut(4)) is None


def test_hashes(spark):
    assert one(spark, "A  b&", tx.content_hash) == hashlib.md5(b"A  b&").hexdigest()
    assert one(spark, "A  b&", tx.normalized_content_hash) == hashlib.md5(b"a b").hexdigest()
    assert one(spark, "", tx.normalized_content_hash) == ""


def test_flesch(spark):
    # 6 words, 2 sentences, 6 syllables.
    assert one(spark, "The cat sat. The dog ran.", tx.flesch_reading_ease) == 119.19
    assert one(spark, "  ", tx.flesch_reading_ease) == 206.84


def test_duplicate_test(spark):
    same = lambda other: lambda t: tx.is_content_duplicate(t, F.lit(other))
    assert one(spark, "a b c d", same("D c b A e"))  # 4 of 5
    assert not one(spark, "a b c d", same("a b c"))
    assert not one(spark, "", same(""))
    assert not one(spark, "&", same("&"))


def test_tags(spark):
    bad = ["[1,", "{}", None, '["a","é"]']
    assert many(spark, bad, tx.decode_tags) == [[], [], [], ["a", "é"]]
    assert one(spark, ["é"], tx.encode_tags, "array<string>") == '["é"]'
    assert one(spark, None, tx.encode_tags, "array<string>") == "[]"


def test_dates(spark):
    golden = {
        "2024-05-01T10:20:30Z": datetime(2024, 5, 1, 10, 20, 30),
        "2024-05-01T10:20:30.500+02:00": datetime(2024, 5, 1, 8, 20, 30, 500000),
        "2024-05-01": datetime(2024, 5, 1),
        "May 1, 2024": datetime(2024, 5, 1),
        "1 May 2024": datetime(2024, 5, 1),
        "Wed, 01 May 2024 10:20:30 GMT": datetime(2024, 5, 1, 10, 20, 30),
        "5/1/2024": datetime(2024, 5, 1),
        "yesterday": None,
        "": None,
    }
    assert many(spark, golden, tx.parse_date) == list(golden.values())
    assert one(spark, datetime(2024, 5, 1), tx.rss_date, "timestamp") == (
        "Wed, 01 May 2024 00:00:00 GMT"
    )


def test_highlight(spark):
    pattern = tx.hit_pattern(F.array(F.lit("fox"), F.lit("dog")))
    text = "The fox, the dog. " + "filler words here " * 10 + "Another FOX foxes"
    got = one(spark, text, lambda t: tx.highlight(t, pattern, 20, 3))
    assert got[0] == "The <em>fox</em>, the <em>dog</em>."
    assert len(got) == 2 and "<em>FOX</em> foxes" in got[1]
    assert all(len(p.replace("<em>", "").replace("</em>", "")) <= 20 for p in got)


def test_suffix_rules(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "公司.cn", "cn", "xn--p1ai", "*.kawasaki.jp", "!city.kawasaki.jp", "jp"]
    golden = {
        "foo.ck": ("", "", "foo.ck", ""),
        "a.foo.ck": ("a", "", "foo.ck", "a.foo.ck"),
        "b.a.foo.ck": ("a", "b", "foo.ck", "a.foo.ck"),
        "www.ck": ("www", "", "ck", "www.ck"),
        "x.www.ck": ("www", "x", "ck", "www.ck"),
        "x.co.uk.": ("x", "", "co.uk", "x.co.uk"),
        "X.Co.Uk": ("x", "", "co.uk", "x.co.uk"),
        "co.uk": ("", "", "co.uk", ""),
        "bücher.com": ("bücher", "", "com", "bücher.com"),
        "www.xn--bcher-kva.com": ("xn--bcher-kva", "www", "com", "xn--bcher-kva.com"),
        "a.公司.cn": ("a", "", "公司.cn", "a.公司.cn"),
        "a.xn--55qx5d.cn": ("a", "", "xn--55qx5d.cn", "a.xn--55qx5d.cn"),
        "пример.рф": ("пример", "", "рф", "пример.рф"),
        "b.city.kawasaki.jp": ("city", "b", "kawasaki.jp", "city.kawasaki.jp"),
        "b.c.kawasaki.jp": ("b", "", "c.kawasaki.jp", "b.c.kawasaki.jp"),
        "kawasaki.jp": ("kawasaki", "", "jp", "kawasaki.jp"),
        "a。co．uk": ("a", "", "co.uk", "a.co.uk"),
        "host.unknown": ("unknown", "host", "", ""),
        "xn--.unknown": ("unknown", "xn--", "", ""),
        "127.0.0.1": ("127.0.0.1", "", "", ""),
        "user@a.com:8080": ("a", "", "com", "a.com"),
    }
    urls = spark.createDataFrame([(f"http://{h}/p",) for h in golden], "url string")
    table = spark.createDataFrame([(r,) for r in rules], "suffix string")
    got = {r["url"][7:-2]: tuple(r["info"]) for r in ux.domain_info(urls, table).collect()}
    assert got == golden


def test_pair_test_makes_each_word_set_once(spark):
    rows = [("A  b\tc, d!", "d! c, b a"), ("x y", "x z"), ("", ""), (None, "a"), (" é* _b", "é _b"), (" ", "a")]
    table = spark.createDataFrame(rows, "first string, second string")
    found = table.select(tx.is_content_duplicate(F.col("first"), F.col("second")).alias("d"))
    assert [r["d"] for r in found.collect()] == [True, False, False, False, True, False]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2


def test_word_set_is_that_of_the_cleaned_text(spark):
    texts = ["A  b\tb c, *d* -  E\n", " \n ", "", None, "​ x ​", "a*b a b"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.filter(F.split(F.lower(tx.clean_text(F.col("t"))), " "), lambda w: w != "")
    for r in table.select(tx.word_set(F.col("t")).alias("a"), F.sort_array(F.array_distinct(words)).alias("b")).collect():
        assert r["a"] == r["b"]
