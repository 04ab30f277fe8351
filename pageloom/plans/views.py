"""Views over the stored tables that stand for crawled content, links and the like.

Each has the same definition as SQL text, for checking results with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.urls import normalize_url
from pageloom.sources.tables import fetched, read_table

EPOCH = "2024-01-01 00:00:00"


def ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _shift(**parts: Column) -> Column:
    return ntz(moment(EPOCH) + F.make_interval(**parts))


SCAN_PARTITIONS = "pageloom.scan.partitions"


def dealt(table: DataFrame) -> DataFrame:
    """``table``, dealt to as many partitions as the session asks for by ``SCAN_PARTITIONS``.

    Unset, as by default, rows are worked on where they are read. Whoever keeps a table in a file of
    a single row group, which one task has to read, can set it to use all cores.
    """
    asked = table.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return table.repartition(int(asked)) if asked else table


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return dealt(read_table(spark, folder, "documents", list(columns) or ["doc_id", "text"]))


def content(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as content records."""
    docs = dealt(read_table(spark, folder, "documents", ["doc_id", "text", "lang", "source"]))
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/article/"), "doc_id").alias("url"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.substring(text, 1, 160).alias("description"),
        text.alias("content"),
        F.col("source").alias("author"),
        _shift(days=(F.col("doc_id") % 30).cast("int")).alias("publish_date"),
        F.array("lang", "source").alias("tags"),
        _shift(mins=F.col("doc_id").cast("int")).alias("extracted_at"),
        F.md5(text).alias("content_hash"),
    )


CONTENT_SQL = """content AS (
  SELECT doc_id, concat('https://', source, '.example.org/article/', doc_id) AS url,
         split_part(text, chr(10), 1) AS title, substr(text, 1, 160) AS description,
         text AS content, source AS author,
         timestamp '2024-01-01' + to_days(cast(doc_id % 30 AS int)) AS publish_date,
         [lang, source] AS tags,
         timestamp '2024-01-01' + to_minutes(cast(doc_id AS int)) AS extracted_at,
         md5(text) AS content_hash
  FROM documents)"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(fetched(read_table(spark, folder, "pages", ["page_id", "url", "html"])))


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page URL as stored and in five variants: ``page_id, variant, url``."""
    url = F.col("url")
    variants = F.array(
        url,
        F.concat(url, F.lit("&flag&UTM_medium=m&b=2/")),
        F.concat(F.lit("ftp"), F.substring_index(url, ":", -1)),
        F.concat(F.regexp_replace(url, r"[?#].*", ""), F.lit("/news/Doc.PDF;v=1?q=a=b&ref=1#x?y=1")),
        F.concat(F.regexp_replace(url, r"^(https?://[^/?#]*).*", "$1"), F.lit(":8080/blog//")),
        F.replace(url, F.lit("example"), F.lit("exa mple")),
    )
    return read_table(spark, folder, "pages", ["page_id", "url"]).select(
        "page_id", F.posexplode(variants).alias("variant", "url")
    )


URLS_SQL = r"""urls AS (
  SELECT page_id, cast(variant AS int) AS variant, url FROM (
    SELECT page_id, unnest(range(6)) AS variant, unnest([url,
      concat(url, '&flag&UTM_medium=m&b=2/'),
      concat('ftp', split_part(url, ':', -1)),
      concat(regexp_replace(url, '[?#].*', ''), '/news/Doc.PDF;v=1?q=a=b&ref=1#x?y=1'),
      concat(regexp_replace(url, '^(https?://[^/?#]*).*', '\1'), ':8080/blog//'),
      replace(url, 'example', 'exa mple')]) AS url
    FROM pages))"""


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, html`` of the stored pages, one for each normalised url, with links to each
    other woven into their articles: to the two pages of twice the number and to that of a third of
    it. A link within the host is written from its root, others in full."""
    url = F.col("url")
    site, rest = r"^https?://[^/?#]*", F.regexp_replace("url", r"^https?://[^/?#]*", "")
    stored = pages(spark, folder)
    p = F.col("page_id")
    edges = stored.select(
        p.alias("src"),
        F.regexp_extract(url, site, 0).alias("src_site"),
        F.explode(F.array(2 * p + 1, 2 * p + 2, F.floor(p / 3).cast("bigint"))).alias("dst"),
    )
    targets = stored.select(
        p.alias("dst"), url.alias("target"), F.regexp_extract(url, site, 0).alias("site"), rest.alias("rest")
    )
    near = (F.col("site") == F.col("src_site")) & F.col("rest").startswith("/")
    href = F.replace(F.when(near, F.col("rest")).otherwise(F.col("target")), F.lit("&"), F.lit("&amp;"))
    anchor = F.concat(F.lit('<a href="'), href, F.lit('">on</a>'))
    woven = (
        edges.join(targets, "dst")
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("dst", anchor.alias("anchor")))).alias("found"))
        .select(F.col("src").alias("page_id"), F.array_join("found.anchor", "").alias("anchors"))
    )
    article = F.concat(F.lit("<article>"), F.coalesce("anchors", F.lit("")))
    first = stored.groupBy(normalize_url(url).alias("url")).agg(F.min("page_id").alias("page_id"))
    return (
        stored.drop("url")
        .join(first, "page_id")
        .join(woven, "page_id", "left")
        .select("page_id", "url", F.replace("html", F.lit("<article>"), article).alias("html"))
    )


def linked_pages_sql(normal: str) -> str:
    """``linked`` as SQL; ``normal`` is the normalised form of ``url``."""
    return rf"""hosted AS (SELECT page_id, url, html, regexp_extract(url, '^https?://[^/?#]*') AS site,
    regexp_replace(url, '^https?://[^/?#]*', '') AS rest FROM pages WHERE html IS NOT NULL),
  woven AS (SELECT e.page_id, string_agg('<a href="' || replace(CASE WHEN t.site = e.site AND starts_with(t.rest, '/')
      THEN t.rest ELSE t.url END, '&', '&amp;') || '">on</a>', '' ORDER BY t.page_id) AS anchors
    FROM (SELECT page_id, site, unnest([2 * page_id + 1, 2 * page_id + 2, page_id // 3]) AS dst FROM hosted) e
    JOIN hosted t ON t.page_id = e.dst GROUP BY e.page_id),
  linked AS (SELECT page_id, {normal} AS url, replace(html, '<article>', '<article>' || coalesce(anchors, '')) AS html
    FROM hosted LEFT JOIN woven USING (page_id) QUALIFY row_number() OVER (PARTITION BY {normal} ORDER BY page_id) = 1)"""


def robots(spark: SparkSession, folder: str) -> DataFrame:
    """A robots file for each page, ``page_id, body``, built from its number and path."""
    path = F.regexp_replace("url", r"^https?://[^/?#]*", "")
    number = F.col("page_id").cast("string")
    lines = F.array(
        F.concat(F.lit("Sitemap: /top-"), number, F.lit(".xml")),
        F.lit("# User-agent: *"),
        F.concat(F.lit("User-Agent: "), F.when(F.col("page_id") % 3 == 0, "*").otherwise("bot")),
        F.concat(F.lit("  Disallow: "), path, F.lit("\r")),
        F.concat(F.lit("ALLOW: /a/"), number),
        F.lit("Disallow:"),
        F.concat(F.lit("Crawl-delay: "), F.when(F.col("page_id") % 2 == 0, number).otherwise("x")),
        F.lit("Sitemap: /inside.xml"),
        F.lit("user-agent: other"),
        F.concat(F.lit("disallow: /other/"), number),
        F.concat(F.lit("sitemap: /other-"), number, F.lit(".xml")),
    )
    return read_table(spark, folder, "pages", ["page_id", "url"]).select(
        "page_id", F.array_join(lines, "\n").alias("body")
    )


ROBOTS_SQL = r"""robots AS (
  SELECT page_id, array_to_string([
    concat('Sitemap: /top-', page_id, '.xml'), '# User-agent: *',
    concat('User-Agent: ', CASE WHEN page_id % 3 = 0 THEN '*' ELSE 'bot' END),
    concat('  Disallow: ', regexp_replace(url, '^https?://[^/?#]*', ''), chr(13)),
    concat('ALLOW: /a/', page_id), 'Disallow:',
    concat('Crawl-delay: ', CASE WHEN page_id % 2 = 0 THEN cast(page_id AS varchar) ELSE 'x' END),
    'Sitemap: /inside.xml', 'user-agent: other', concat('disallow: /other/', page_id),
    concat('sitemap: /other-', page_id, '.xml')], chr(10)) AS body
  FROM pages)"""


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products: ``p_partkey, product_name, spellcheck``."""
    return dealt(read_table(spark, folder, "part", ["p_partkey", "p_name", "p_type"])).select(
        "p_partkey",
        F.col("p_name").alias("product_name"),
        F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("spellcheck"),
    )


PRODUCTS_SQL = """products AS (
  SELECT p_partkey, p_name AS product_name, lower(p_name) || ' ' || lower(p_type) AS spellcheck
  FROM part)"""


def misspelt(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct part names with errors: ``query_id, query``. In one form the last letter of each word
    of five or more is dropped and the third of each longer word doubled, in the other the second and
    third letters of each word are swapped."""
    name = F.lower("p_name")
    wrong = F.regexp_replace(F.regexp_replace(name, r"([a-z]{4})[a-z](?![a-z])", "$1"), r"\b([a-z]{2})([a-z])", "$1$2$2")
    swapped = F.regexp_replace(name, r"\b([a-z])([a-z])([a-z])", "$1$3$2")
    return (
        read_table(spark, folder, "part", ["p_name"])
        .select(F.explode(F.array(wrong, swapped)).alias("query"))
        .distinct()
        .select(F.col("query").alias("query_id"), "query")
    )


MISSPELT_SQL = r"""misspelt AS (
  SELECT DISTINCT query AS query_id, query FROM (
    SELECT unnest([regexp_replace(regexp_replace(lower(p_name), '([a-z]{4})[a-z]( |$)', '\1\2', 'g'),
                          '\b([a-z]{2})([a-z])', '\1\2\2', 'g'),
                   regexp_replace(lower(p_name), '\b([a-z])([a-z])([a-z])', '\1\3\2', 'g')]) AS query
    FROM part))"""
