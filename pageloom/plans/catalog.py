"""Named queries: each a Spark job over whole tables, most with the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions import text as tx
from pageloom.functions import urls as ux
from pageloom.functions.chars import NON_WORDS, SPACE_CHARS, SPACES, WORD_CHARS
from pageloom.functions.passages import SENTENCE, passages
from pageloom.functions.words import words_sql
from pageloom.operators import content as ct
from pageloom.operators import dedup, extract, feeds, frontier
from pageloom.operators import index as ix
from pageloom.operators import robots as rb
from pageloom.operators import search as se
from pageloom.operators import segments as sg
from pageloom.operators import readability, seen, stats, suggest
from pageloom.plans import views as vw
from pageloom.session import cut, new_path
from pageloom.sources import store
from pageloom.sources import tables as tb
from pageloom.streaming import content as st

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[job.__name__] = Query(job.__name__, job, sql)
        return job

    return register


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


C = F.col
DOC_QUERY = "anble antion bleing"

# --------------------------------------------------------------------------- search, first


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT url, title, extracted_at FROM content
    WHERE title ILIKE '%anble%' OR description ILIKE '%anble%' OR content ILIKE '%anble%'
    ORDER BY CASE WHEN title ILIKE '%anble%' THEN 1 WHEN description ILIKE '%anble%' THEN 2
             ELSE 3 END, extracted_at DESC, url LIMIT 20"""
)
def ranked_search(spark, folder):
    found = ct.search_content(vw.content(spark, folder), "anble")
    return found.select("url", "title", "extracted_at")


def _tokens(column: str) -> str:
    return words_sql(column)


def _bm25_sql(
    source: str, key: str, boosts: dict[str, float], terms: str, where: str = "true"
) -> str:
    """CTEs ending in ``scored (query_id, key, score)``; ``terms`` is ``qterms (query_id, term)``."""
    fields = " UNION ALL ".join(
        f"SELECT {key} AS k, '{f}' AS field, {_tokens(f)} AS toks FROM {source}"
        for f in boosts
    )
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items()) + " END"
    return f"""tokens AS ({fields}),
    qterms AS ({terms}),
    stats AS (SELECT field, count(*) AS n, avg(len(toks)) AS avgdl FROM tokens
              WHERE len(toks) > 0 GROUP BY field),
    tf AS (SELECT k, field, dl, term, count(*) AS tf FROM (
             SELECT k, field, len(toks) AS dl, unnest(toks) AS term FROM tokens)
           WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
    parts AS (SELECT q.query_id, tf.k, tf.field,
        sum(2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))
          AS s
      FROM qterms q JOIN tf USING (term) JOIN df USING (field, term) JOIN stats USING (field)
      GROUP BY q.query_id, tf.k, tf.field),
    scored AS (SELECT query_id, k AS {key}, round(max({boost} * s), 4) AS score
      FROM parts GROUP BY query_id, k)"""


_ONE_QUERY = f"SELECT 1 AS query_id, unnest(string_split('{DOC_QUERY}', ' ')) AS term"
_SCORED = _bm25_sql("content", "url", se.BOOSTS, _ONE_QUERY)
_HITS = "SELECT c.url, c.title, c.author, c.publish_date, s.score FROM scored s JOIN content c USING (url)"


def _hits(found: DataFrame) -> DataFrame:
    return found.select("url", "title", "author", "publish_date", "score")


@query(
    _with(vw.CONTENT_SQL, _SCORED)
    + _HITS
    + " ORDER BY score DESC, publish_date DESC NULLS LAST, url LIMIT 20"
)
def bm25_search(spark, folder):
    return _hits(se.scan_search(vw.content(spark, folder), DOC_QUERY, key="url"))


_FILTER_SQL = """ WHERE c.author = 'src3' AND list_has_any(c.tags, ['en', 'fr'])
  AND c.publish_date BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-25'"""


def _filter():
    return se.filters(
        "src3", ["en", "fr"], vw.moment("2024-01-05 00:00:00"), vw.moment("2024-01-25 00:00:00")
    )


@query(
    _with(vw.CONTENT_SQL, _SCORED)
    + _HITS
    + _FILTER_SQL
    + " ORDER BY score DESC, publish_date DESC NULLS LAST, url LIMIT 20"
)
def search_filtered(spark, folder):
    return _hits(se.scan_search(vw.content(spark, folder), DOC_QUERY, _filter(), key="url"))


@query(
    _with(vw.CONTENT_SQL, _SCORED)
    + _HITS
    + " ORDER BY score DESC, publish_date DESC NULLS LAST, url LIMIT 10 OFFSET 10"
)
def search_page(spark, folder):
    return _hits(
        se.scan_search(vw.content(spark, folder), DOC_QUERY, size=10, offset=10, key="url")
    )


@query(
    _with(vw.CONTENT_SQL, _SCORED)
    + "SELECT count(*) AS total FROM scored s JOIN content c USING (url)"
    + _FILTER_SQL
)
def search_total(spark, folder):
    return se.scan_total(vw.content(spark, folder), DOC_QUERY, _filter())


_HIT = f"({'|'.join(DOC_QUERY.split())})"
_HIGHLIGHTS = f"""hits AS (SELECT url, score, title, content FROM scored JOIN content USING (url)
    ORDER BY score DESC, publish_date DESC NULLS LAST, url LIMIT 20),
  fields AS (SELECT url, 'title' AS f, 100 AS size, 5 AS n, title AS t FROM hits
    UNION ALL SELECT url, 'content', 150, 3, content FROM hits),
  words AS (SELECT *, list_filter(string_split_regex(t, '{SPACES}'), lambda w: w <> '') AS ws FROM fields),
  packed AS (SELECT *, list_reduce(list_transform(ws, lambda w: [w]), lambda a, x:
      CASE WHEN length(a[-1]) + 1 + length(x[1]) <= size THEN list_append(a[:-2], a[-1] || ' ' || x[1])
        ELSE list_append(a, x[1]) END) AS pieces FROM words WHERE len(ws) > 0),
  pieces AS (SELECT url, f, n, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM packed),
  marked AS (SELECT *, regexp_replace(piece, '([{WORD_CHARS}]+)', chr(1) || '\\1' || chr(2), 'g') AS m FROM pieces),
  counted AS (SELECT *, len(regexp_extract_all(m, chr(1) || '(?i){_HIT}' || chr(2))) AS k FROM marked),
  best AS (SELECT *, row_number() OVER (PARTITION BY url, f ORDER BY k DESC, i) AS r FROM counted WHERE k > 0),
  shown AS (SELECT url, f, string_agg(translate(regexp_replace(m, chr(1) || '(?i){_HIT}' || chr(2),
      '<em>\\1</em>', 'g'), chr(1) || chr(2), ''), ' … ' ORDER BY r) AS h FROM best WHERE r <= n GROUP BY url, f)"""


@query(
    _with(vw.CONTENT_SQL, _SCORED, _HIGHLIGHTS)
    + """SELECT url, score,
      coalesce((SELECT h FROM shown s WHERE s.url = hits.url AND f = 'title'), '') AS title_highlights,
      coalesce((SELECT h FROM shown s WHERE s.url = hits.url AND f = 'content'), '') AS content_highlights
    FROM hits"""
)
def search_highlight(spark, folder):
    found = se.scan_search(vw.content(spark, folder), DOC_QUERY, key="url", highlights=True)
    return found.select(
        "url",
        "score",
        F.array_join("highlights.title", " … ").alias("title_highlights"),
        F.array_join("highlights.content", " … ").alias("content_highlights"),
    )


_DOC_TERMS = sorted(DOC_QUERY.split())


def _over_terms(form: str, joined: str) -> str:
    return joined.join(form.format(t=t) for t in _DOC_TERMS)


@query(
    _with(
        vw.CONTENT_SQL,
        _SCORED,
        f"""hits AS (SELECT url, content FROM scored JOIN content USING (url)
      ORDER BY score DESC, publish_date DESC NULLS LAST, url LIMIT 20),
    cut AS (SELECT url, regexp_extract_all(regexp_replace(content, '{SPACES}', ' ', 'g'),
      '{SENTENCE.replace("'", "''")}') AS found FROM hits),
    pieces AS (SELECT url, trim(unnest(found)) AS passage, generate_subscripts(found, 1) - 1 AS position FROM cut),
    pwords AS (SELECT *, {_tokens('passage')} AS ws FROM pieces),
    ptf AS (SELECT *, len(ws) AS dl, {_over_terms("len(list_filter(ws, lambda w: w = '{t}')) AS tf_{t}", ", ")} FROM pwords),
    pstats AS (SELECT *, count(*) OVER w AS n, avg(dl) OVER w AS average,
      {_over_terms("count(*) FILTER (tf_{t} > 0) OVER w AS df_{t}", ", ")} FROM ptf WINDOW w AS (PARTITION BY url)),
    pranked AS (SELECT *, {_over_terms("(tf_{t} > 0)::int", " + ")} AS coverage, round({_over_terms(
      "CASE WHEN tf_{t} > 0 THEN ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5)) * tf_{t} * 2.2"
      " / (tf_{t} + 1.2 * (0.25 + 0.75 * dl / average)) ELSE 0 END", " + ")}, 6) AS score FROM pstats)""",
    )
    + """SELECT url, cast(rank AS int) AS rank, cast(position AS int) AS position, coverage, score, passage FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY coverage DESC, score DESC, position) AS rank
      FROM pranked WHERE coverage > 0) WHERE rank <= 3"""
)
def search_passages(spark, folder):
    """The best sentences of the first page of hits."""
    docs = vw.content(spark, folder)
    best = passages(C("content"), tx.query_terms(DOC_QUERY))
    page = se.scan_search(docs, DOC_QUERY, key="url").select("url")
    found = docs.select("url", "content").join(F.broadcast(page), "url")
    return found.select("url", F.posexplode(best).alias("at", "p")).select(
        "url", (C("at") + 1).alias("rank"), "p.position", "p.coverage", "p.score", "p.passage"
    )


_BENCH_TERMS = f"SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark"


def _batch_scores(spark, folder):
    path = new_path(spark, "postings")
    ix.write_postings(ix.postings(vw.content(spark, folder), key="url", mark=True), path, buckets=16)
    statistics = cut(ix.stored_field_stats(spark.read.parquet(path)))
    queries = tb.read_table(spark, folder, "benchmark").select(
        C("item_id").alias("query_id"), C("text").alias("query")
    )
    terms = queries.select(F.explode(F.array_distinct(tx.tokens(C("query")))).alias("term"))
    index = ix.read_postings(spark, path, terms, buckets=16)
    return se.score(index, statistics, ix.term_stats(index), queries, key="url", scattered=True)


_BATCH = _with(vw.CONTENT_SQL, _bm25_sql("content", "url", se.BOOSTS, _BENCH_TERMS))


@query(
    _BATCH
    + """SELECT query_id, cast(rank AS int) AS rank, url, score FROM (
      SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, publish_date DESC NULLS LAST, url) AS rank
      FROM scored JOIN content USING (url)) WHERE rank <= 10"""
)
def search_batch(spark, folder):
    scores = _batch_scores(spark, folder)
    return se.search(scores, vw.content(spark, folder), size=10, key="url")


@query(_BATCH + "SELECT query_id, count(*) AS total FROM scored GROUP BY query_id")
def search_batch_totals(spark, folder):
    return se.totals(_batch_scores(spark, folder))


# --------------------------------------------------------------------------- URL functions


def _on_urls(name: str, value) -> Job:
    def job(spark, folder):
        return vw.urls(spark, folder).select("page_id", "variant", value(C("url")).alias(name))

    return job


def _url_query(query_name: str, column: str, value, sql: str) -> None:
    text = _with(vw.URLS_SQL) + f"SELECT page_id, variant, {sql} AS {column} FROM urls"
    QUERIES[query_name] = Query(query_name, _on_urls(column, value), text)


_VALID = f"regexp_matches(url, '{ux.VALID_URL}')"
_NETLOC = f"regexp_extract(url, '{ux.NETLOC}', 1)"
_PATH = f"lower(regexp_replace(regexp_extract(url, '{ux.PATH}', 1), ';[^/]*$', ''))"
_EXTENSIONS = "|".join(e.lstrip(".") for e in config.EXCLUDED_EXTENSIONS)
_USEFUL = "|".join(config.USEFUL_URL_PATTERNS)
_TRACKING = ", ".join(f"'{t}'" for t in config.TRACKING_PARAMETERS)


def _normal_sql(url: str) -> str:
    kept = (
        f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'),"
        f" lambda p: contains(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKING})), '&')"
    )
    return (
        f"rtrim(concat(regexp_extract({url}, '^[^?#]*'), CASE WHEN {kept} <> '' THEN '?' || {kept}"
        f" ELSE '' END), '/')"
    )


_url_query("url_valid", "valid", ux.is_valid_url, _VALID)
_url_query("url_normalize", "normalized", ux.normalize_url, _normal_sql("url"))
_url_query("url_domain", "domain", ux.url_domain, f"lower({_NETLOC})")
_url_query("url_netloc", "netloc", ux.url_netloc, _NETLOC)
_url_query("url_hash", "url_hash", ux.url_hash, "md5(url)")
_url_query(
    "url_crawl_filter",
    "wanted",
    ux.is_crawl_candidate,
    f"{_VALID} AND NOT regexp_matches({_PATH}, '\\.({_EXTENSIONS})$')"
    f" AND regexp_matches(url, '(?i){_USEFUL}')",
)
_url_query(
    "url_should_crawl",
    "allowed",
    lambda u: ux.should_crawl_url(u, None, ["/en/", "/blog/"], ["page=", "\\.pdf"]),
    f"{_VALID} AND NOT regexp_matches(url, '(?i)page=|\\.pdf')"
    " AND regexp_matches(url, '(?i)/en/|/blog/')",
)


@query(
    _with(
        vw.URLS_SQL,
        f"""seeds AS (SELECT DISTINCT lower(regexp_extract(url, '{ux.NETLOC}', 1)) AS domain
        FROM pages WHERE page_id % 5 = 0)""",
    )
    + f"""SELECT page_id, variant, url FROM urls WHERE {_VALID}
      AND lower({_NETLOC}) IN (SELECT domain FROM seeds)
      AND NOT regexp_matches(url, '(?i)page=')"""
)
def crawl_allowed(spark, folder):
    seeds = tb.read_table(spark, folder, "pages", ["page_id", "url"]).where(C("page_id") % 5 == 0)
    return ux.crawlable(vw.urls(spark, folder), seeds, blocked_patterns=["page="])


@query(
    _with(vw.URLS_SQL)
    + f"""SELECT a.page_id, a.variant,
      lower(regexp_extract(a.url, '{ux.NETLOC}', 1)) = lower(regexp_extract(b.url, '{ux.NETLOC}', 1))
        AS same_domain
      FROM urls a JOIN pages b ON b.page_id = a.page_id + a.variant"""
)
def same_domain_links(spark, folder):
    pages = tb.read_table(spark, folder, "pages", ["page_id", "url"])
    other = pages.select(C("page_id").alias("other_id"), C("url").alias("other"))
    return (
        vw.urls(spark, folder)
        .join(other, C("other_id") == C("page_id") + C("variant"))
        .select("page_id", "variant", ux.is_same_domain(C("url"), C("other")).alias("same_domain"))
    )


def _suffix_rules(pages: DataFrame) -> DataFrame:
    """Rules derived from the hosts: their last labels, one suffix of two labels, any name under
    another, and exceptions from that for the names that have a blog."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)
    last = F.substring_index(host, ".", -1)
    blog = host.startswith("blog.") & host.endswith(".example.net")
    rules = F.array(
        last, F.concat(F.lit("example."), last), F.lit("*.example.net"),
        F.when(blog, F.concat(F.lit("!"), F.regexp_replace(host, r"^blog\.", ""))),
    )
    found = pages.select(F.explode(rules).alias("suffix")).distinct()
    return found.where(C("suffix").isNotNull() & ~C("suffix").isin("example.com", "example.net"))


@query(
    r"""WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages),
    rules AS (SELECT DISTINCT rule FROM (SELECT unnest([split_part(host, '.', -1),
        'example.' || split_part(host, '.', -1), '*.example.net',
        CASE WHEN starts_with(host, 'blog.') AND ends_with(host, '.example.net') THEN '!' || substr(host, 6) END])
        AS rule FROM hosts) WHERE rule IS NOT NULL AND rule NOT IN ('example.com', 'example.net')),
    split AS (SELECT page_id, host, string_split(host, '.') AS l FROM hosts),
    tails AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM split),
    fits AS (SELECT page_id, l, CASE WHEN starts_with(rule, '!') THEN k - 1 ELSE k END AS k,
        starts_with(rule, '!') AS exception FROM tails JOIN rules
      ON rule IN (array_to_string(l[len(l) - k + 1:], '.'), '!' || array_to_string(l[len(l) - k + 1:], '.'))
        OR (k > 1 AND rule = '*.' || array_to_string(l[len(l) - k + 2:], '.'))),
    best AS (SELECT page_id, l, arg_max(k, exception::int * 1000 + k) AS k FROM fits GROUP BY page_id, l),
    parts AS (SELECT page_id, coalesce(l[len(l) - k], '') AS domain,
      array_to_string(l[:len(l) - k - 1], '.') AS subdomain, array_to_string(l[len(l) - k + 1:], '.') AS suffix,
      len(l) - k AS n FROM best)
    SELECT page_id, CASE WHEN n > 0 THEN domain ELSE '' END AS domain, CASE WHEN n > 1 THEN subdomain ELSE '' END
      AS subdomain, suffix, CASE WHEN n > 0 THEN domain || '.' || suffix ELSE '' END AS registered_domain FROM parts"""
)
def domain_info(spark, folder):
    """Every second page's host with a dot at its end."""
    pages = tb.read_table(spark, folder, "pages", ["page_id", "url"])
    dotted = F.when(C("page_id") % 2 == 0, F.regexp_replace("url", r"^(https?://[^/?#]*)", "$1.")).otherwise(C("url"))
    return ux.domain_info(pages.withColumn("url", dotted), _suffix_rules(pages)).select("page_id", "info.*")


@query(
    r"""SELECT page_id, cast(kind AS int) AS kind, CASE kind WHEN 0 THEN root || '/w/' || page_id
        WHEN 1 THEN split_part(url, ':', 1) || '://h/x' WHEN 2 THEN path || '?q=1'
        WHEN 3 THEN 'http://other.org/./y' WHEN 4 THEN split_part(url, '#', 1) || '#f'
        WHEN 5 THEN 'mailto:x@y.org' ELSE root || '/v' END AS resolved
      FROM (SELECT page_id, url, unnest(range(7)) AS kind, regexp_extract(url, '^[^?#]*') AS path,
        regexp_extract(url, '^https?://[^/?#]*') AS root FROM pages)"""
)
def url_resolve(spark, folder):
    hrefs = F.array(
        F.concat(F.lit("/w/"), "page_id"),
        *[
            F.lit(h)
            for h in ("//h/x", "?q=1", "http://other.org/./y", "#f", "mailto:x@y.org", "/u/./../v")
        ],
    )
    pages = tb.read_table(spark, folder, "pages", ["page_id", "url"])
    found = pages.select("page_id", "url", F.posexplode(hrefs).alias("kind", "href"))
    return found.select(
        "page_id", "kind", ux.resolve_url(C("url"), C("href")).alias("resolved")
    )


@query(
    f"""SELECT DISTINCT concat(regexp_extract(url, '^([a-z]+):', 1), '://',
      regexp_extract(url, '{ux.NETLOC}', 1), '/robots.txt') AS robots_url FROM pages"""
)
def robots_urls(spark, folder):
    return tb.robots_urls(tb.read_table(spark, folder, "pages", ["url"]))


# --------------------------------------------------------------------------- text functions


def _text_query(name: str, column: str, value, sql: str) -> None:
    def job(spark, folder):
        return vw.documents(spark, folder).select("doc_id", value(C("text")).alias(column))

    QUERIES[name] = Query(name, job, f"SELECT doc_id, {sql} AS {column} FROM documents")


_CLEAN = (
    f"trim(regexp_replace(regexp_replace(text, '{SPACES}', ' ', 'g'),"
    f""" '[^{WORD_CHARS} .,!?;:()\\-"]', '', 'g'))"""
)
_WORDS = f"len(list_filter(string_split_regex(text, '{SPACES}'), lambda w: w <> ''))"

_FLESCH_EXACT = f"""(206.835::double
  - 1.015::double * ({_WORDS} / greatest(1, len(regexp_extract_all(text, '[.!?]+'))))
  - 84.6::double * (greatest({_WORDS}, len(regexp_extract_all(lower(text), '[aeiouy]+'))) / {_WORDS}))"""
_FLESCH = f"""CASE WHEN {_WORDS} = 0 THEN 206.84::double
  ELSE sign({_FLESCH_EXACT}) * (floor(abs({_FLESCH_EXACT}) * 100 + 0.5) / 100) END"""

_text_query("clean_text", "cleaned", tx.clean_text, _CLEAN)
_text_query("word_count", "words", tx.word_count, f"cast({_WORDS} AS int)")
_text_query(
    "reading_time_floor",
    "minutes",
    lambda t: tx.reading_time(tx.word_count(t)),
    f"cast(greatest(1, {_WORDS} // 200) AS int)",
)
_text_query(
    "reading_time_round",
    "minutes",
    tx.estimate_reading_time,
    f"CASE WHEN text = '' THEN 0 ELSE cast(greatest(1, round_even({_WORDS} / 200, 0)) AS int) END",
)
_text_query(
    "truncate_text",
    "short",
    tx.truncate_text,
    r"""CASE WHEN length(text) <= 200 THEN text
        ELSE CASE WHEN regexp_matches(left(text, 200), '(?s)^.+ ')
          THEN regexp_extract(left(text, 200), '(?s)^(.+) ', 1) ELSE left(text, 200) END
          || '...' END""",
)
_text_query("content_hash", "content_hash", tx.content_hash, "md5(text)")
_text_query(
    "normalized_hash",
    "content_hash",
    tx.normalized_content_hash,
    f"CASE WHEN text = '' THEN '' ELSE md5(lower({_CLEAN})) END",
)
_text_query(
    "flesch",
    "score",
    tx.flesch_reading_ease,
    _FLESCH,
)
_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxz", "aeiouy"


@query(
    f"""WITH counted AS (SELECT doc_id, {_WORDS} AS words,
      greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences,
      regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+') AS runs FROM documents),
    broken AS (SELECT *, list_sum(list_transform(runs, lambda w: 1 + len(regexp_extract_all(
      substr(regexp_replace(w, 'st([{_VOWELS}])', 's_\\1', 'g'), 3), '[{_CONSONANTS}][{_VOWELS}]')))) AS syllables FROM counted),
    exact AS (SELECT *, 206.835::double - 1.015::double * (words / sentences)
      - 84.6::double * (coalesce(syllables, 0) / words) AS x FROM broken)
    SELECT doc_id, CASE WHEN words = 0 THEN 206.84::double ELSE sign(x) * (floor(abs(x) * 100 + 0.5) / 100) END AS score
    FROM exact"""
)
def flesch_patterns(spark, folder):
    """By a table of patterns made by a rule: a break before a consonant and a vowel, but not in "st"."""
    rule = [f"1{c}{v}" for c in _CONSONANTS for v in _VOWELS] + [f"s2t{v}" for v in _VOWELS]
    patterns = spark.createDataFrame([(p,) for p in rule], "pattern string")
    return readability.flesch_reading_ease(vw.documents(spark, folder), patterns)


_STOP = ", ".join(f"'{w}'" for w in config.STOP_WORDS)


def _keywords_sql(text: str, source: str, key: str, n: int) -> str:
    return f"""kw_words AS (SELECT {key} AS k, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
        SELECT {key}, string_split_regex(lower({text}), '{NON_WORDS}') AS ws FROM {source})),
    kw_ranked AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY n DESC, first) AS rn FROM (
        SELECT k, w, count(*) AS n, min(pos) AS first FROM kw_words
        WHERE regexp_full_match(w, '[a-z]{{4,}}') AND w NOT IN ({_STOP}) GROUP BY k, w)),
    kw AS (SELECT k, string_agg(w, ' ' ORDER BY rn) AS words FROM kw_ranked WHERE rn <= {n}
      GROUP BY k)"""


@query(
    _with(_keywords_sql("text", "documents", "doc_id", 10))
    + "SELECT doc_id, coalesce(words, '') AS keywords FROM documents LEFT JOIN kw ON k = doc_id"
)
def keywords(spark, folder):
    words = F.array_join(tx.keywords(C("text")), " ")
    return vw.documents(spark, folder).select("doc_id", words.alias("keywords"))


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT doc_id, cast(to_json(tags) AS varchar) AS encoded,
      array_to_string(tags, ',') AS decoded, '' AS broken FROM content"""
)
def tags_json(spark, folder):
    encoded = tx.encode_tags(C("tags"))
    return vw.content(spark, folder).select(
        "doc_id",
        encoded.alias("encoded"),
        F.array_join(tx.decode_tags(encoded), ",").alias("decoded"),
        F.array_join(tx.decode_tags(F.concat(F.lit("{"), "title")), ",").alias("broken"),
    )


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT doc_id, strftime(publish_date, '%a, %d %b %Y %H:%M:%S GMT') AS rss_date,
      strftime(extracted_at, '%Y-%m-%dT%H:%M:%S') AS iso_date FROM content"""
)
def rss_date(spark, folder):
    return vw.content(spark, folder).select(
        "doc_id",
        tx.rss_date(C("publish_date")).alias("rss_date"),
        tx.iso_date(C("extracted_at")).alias("iso_date"),
    )


# Patterns of the formatter, and how much of the moment each tells: all, the minute, the day, the month, nothing.
_DATE_SPELLINGS = (
    ("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("yyyy-MM-dd", "day"),
    ("MMMM d, yyyy", "day"), ("EEE, d MMM yyyy HH:mm:ss 'GMT'", "second"), ("'posted' d MMMM", None),
    ("dd-MMM-yyyy", "day"), ("yyyy-MM-dd h:mm a", "minute"), ("h:mm a, MMM d, yyyy", "minute"), ("MMMM yyyy", "month"),
    ("yyyy'年'M'月'd'日'", "day"), ("d.M.yy HH:mm", "minute"), ("M/d/yyyy", "day"), ("yyyyMMdd'T'HHmmss", "second"),
    ("yyyy-DDD", "day"), ("EEE MMM d HH:mm:ss 'UTC' yyyy", "second"), ("d 'de' MMMM 'de' yyyy 'às' H'h'mm", "minute"),
    ("'the' d'th of' MMMM yyyy", "day"), ("MMM. d yyyy, hh:mm:ss a 'EST'", "second"), ("HH:mm", None),
)
_READ = " ".join(
    f"WHEN {i} THEN " + ("NULL" if part is None else f"date_trunc('{part}', extracted_at)")
    + (" + INTERVAL 5 HOURS" if "EST" in pattern else "")
    for i, (pattern, part) in enumerate(_DATE_SPELLINGS)
)


@query(
    _with(vw.CONTENT_SQL)
    + f"SELECT doc_id, CASE doc_id % {len(_DATE_SPELLINGS)} {_READ} END AS parsed FROM content"
)
def parse_date(spark, folder):
    kind, at = C("doc_id") % len(_DATE_SPELLINGS), C("extracted_at")
    spelt = F.coalesce(
        *[F.when(kind == i, F.date_format(at, f)) for i, (f, _) in enumerate(_DATE_SPELLINGS)]
    )
    return vw.content(spark, folder).select(
        "doc_id", vw.ntz(tx.parse_date(spelt)).alias("parsed")
    )


# --------------------------------------------------------------------------- content table


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT url, title, description, author, publish_date, array_to_string(tags, ',') AS tags,
      extracted_at FROM content ORDER BY extracted_at DESC, url LIMIT 50"""
)
def recent_content(spark, folder):
    recent = ct.recent_content(vw.content(spark, folder))
    return recent.withColumn("tags", F.array_join("tags", ",")).drop("content")


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT url, extracted_at FROM content
      WHERE len(list_filter(tags, lambda t: t ILIKE '%RC1%')) > 0 OR title ILIKE '%RC1%'
        OR content ILIKE '%RC1%' ORDER BY extracted_at DESC, url LIMIT 50"""
)
def topic_content(spark, folder):
    return ct.content_by_topic(vw.content(spark, folder), "RC1").select("url", "extracted_at")


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT count(*) AS total_content,
      count(*) FILTER (cast(extracted_at AS date) = date '2024-01-01') AS content_today FROM content"""
)
def content_stats(spark, folder):
    return stats.content_stats(
        vw.content(spark, folder), vw.moment("2024-01-01 18:00:00")
    )


@query(
    _with(
        vw.CONTENT_SQL,
        """ranked AS (SELECT tags, array_to_string(tags, ',') AS label, count(*) AS count FROM content
        WHERE len(tags) > 0 GROUP BY tags ORDER BY count DESC, label LIMIT 10)""",
    )
    + """SELECT tag, count FROM (SELECT unnest(tags) AS tag, unnest(range(len(tags))) AS pos, label,
      count FROM ranked) ORDER BY count DESC, label, pos LIMIT 10"""
)
def top_tag_sets(spark, folder):
    return stats.top_tag_sets(vw.content(spark, folder))


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT topic, count(*) AS count FROM (SELECT unnest(list_distinct(tags)) AS topic FROM content
      WHERE extracted_at >= timestamp '2024-01-08' - interval 7 days + interval 2 hours)
      GROUP BY topic ORDER BY count DESC, topic LIMIT 20"""
)
def trending_topics(spark, folder):
    index = vw.content(spark, folder).withColumnRenamed("extracted_at", "indexed_at")
    return stats.trending_topics(index, vw.moment("2024-01-08 02:00:00"))


_FIRST_OF_HASH = """SELECT url, extracted_at, content_hash FROM (SELECT *, row_number() OVER (
  PARTITION BY content_hash ORDER BY extracted_at, url) AS rn FROM content) WHERE rn = 1"""


@query(_with(vw.CONTENT_SQL) + _FIRST_OF_HASH)
def exact_dedup(spark, folder):
    rows = vw.content(spark, folder).select("url", "extracted_at", "content_hash")
    return dedup.exact_dedup(rows)


@query(_with(vw.CONTENT_SQL) + _FIRST_OF_HASH)
def save_content(spark, folder):
    """Two batches into an empty table: the rows of the first hours, then all rows again."""
    path = new_path(spark, "content")
    rows = vw.content(spark, folder).drop("doc_id")
    store.save_content(spark, path, rows.where(C("extracted_at") < vw.moment("2024-01-01 06:00:00")))
    store.save_content(spark, path, rows)
    saved = store.read_content(spark, path)
    return saved.select("url", vw.ntz(C("extracted_at")).alias("extracted_at"), "content_hash")


_CONFLICTS = """saves AS (
  SELECT doc_id, concat('https://', source, '.example.org/', doc_id % 40) AS url,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(concat(lang, doc_id % 60)) END AS content_hash,
    timestamp '2024-01-01' + to_minutes(cast(doc_id * 7919 % 10007 AS int)) AS extracted_at
  FROM documents)"""


@query(
    f"""WITH RECURSIVE {_CONFLICTS},
    numbered AS (SELECT *, row_number() OVER (ORDER BY extracted_at, url, coalesce(content_hash, ''),
      doc_id) AS n FROM saves),
    steps AS (
      SELECT cast(0 AS bigint) AS n, cast(NULL AS bigint) AS kept, cast([] AS varchar[]) AS urls,
        cast([] AS varchar[]) AS hashes
      UNION ALL
      SELECT r.n, CASE WHEN ok THEN r.doc_id END,
        CASE WHEN ok THEN list_append(urls, r.url) ELSE urls END,
        CASE WHEN ok AND r.content_hash IS NOT NULL THEN list_append(hashes, r.content_hash)
          ELSE hashes END
      FROM (SELECT r.*, s.urls, s.hashes, NOT list_contains(s.urls, r.url) AND (r.content_hash IS NULL
              OR NOT list_contains(s.hashes, r.content_hash)) AS ok
            FROM steps s JOIN numbered r ON r.n = s.n + 1) r)
    SELECT url, content_hash, extracted_at FROM saves WHERE doc_id IN (SELECT kept FROM steps)"""
)
def save_content_conflicts(spark, folder):
    """Rows that collide in url and in hash, also in chains."""
    docs = tb.read_table(spark, folder, "documents", ["doc_id", "lang", "source"])
    rows = docs.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), C("doc_id") % 40).alias("url"),
        F.when(C("doc_id") % 7 != 0, F.md5(F.concat("lang", C("doc_id") % 60))).alias(
            "content_hash"
        ),
        vw.ntz(
            vw.moment(vw.EPOCH)
            + F.make_interval(mins=(C("doc_id") * 7919 % 10007).cast("int"))
        ).alias("extracted_at"),
    )
    return store.accepted(rows)


# --------------------------------------------------------------------------- page extraction


def _nodes(spark, folder):
    return extract.page_nodes(vw.pages(spark, folder), ("page_id", "url"))


_UNESCAPE = (
    "regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
    " '&#x27;', ''''), '&amp;?', '&', 'g')"
)


def _element_sql(html: str) -> str:
    """Text of a piece of HTML: pieces between tags, trimmed and joined."""
    text = _UNESCAPE.format("t")
    return (
        f"array_to_string(list_transform(string_split_regex({html}, '<[^>]*>'),"
        f" lambda t: regexp_replace({text}, '^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$', '', 'g')), '')"
    )


_TITLE = (
    "coalesce(nullif("
    + _element_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
    + ", ''), "
    + _element_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
    + ")"
)


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, folder):
    visible = extract.visible_nodes(_nodes(spark, folder), ("page_id",))
    return visible.select("page_id", extract.page_title().alias("title"))


@query(
    """SELECT page_id, concat('About ', page_id) AS description,
      CASE WHEN page_id % 3 > 0 THEN concat('Writer ', page_id % 7) END AS author,
      CASE page_id % 4 WHEN 3 THEN NULL ELSE timestamp '2024-01-01' + to_days(cast(page_id % 28 AS int)) END
        AS publish_date,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('t', page_id % 5, ',u', page_id % 11) END AS tags
    FROM pages WHERE html IS NOT NULL"""
)
def page_metadata(spark, folder):
    """Author, date, tags and description, woven into the stored pages in several forms."""
    page, day = C("page_id"), vw.ntz(vw.moment(vw.EPOCH) + F.make_interval(days=(C("page_id") % 28).cast("int")))
    number = lambda n: (page % n).cast("string")
    written = F.concat(F.lit("Writer "), number(7))
    author = (
        F.when(page % 3 == 1, F.concat(F.lit('<a rel="author" href="/w"> '), written, F.lit("</a>")))
        .when(page % 3 == 2, F.concat(F.lit('<p class="byline x">'), written, F.lit("</p>")))
        .otherwise("")
    )
    date = (
        F.when(page % 4 == 0, F.concat(F.lit('<time datetime="'), F.date_format(day, "yyyy-MM-dd"), F.lit('">x</time>')))
        .when(page % 4 == 1, F.concat(F.lit('<i class="date">'), F.date_format(day, "MMMM d, yyyy"), F.lit("</i>")))
        .when(page % 4 == 2, F.concat(F.lit("<time>"), F.date_format(day, "dd.MM.yyyy"), F.lit("</time>")))
        .otherwise("")
    )
    tags = F.when(page % 5 == 0, F.lit("")).otherwise(
        F.concat(
            F.lit('<div class="tags"><a>t'), number(5), F.lit("</a><a>u"), number(11), F.lit("</a></div><b class=tag>t"),
            number(5), F.lit("</b>"),
        )
    )
    about = F.concat(F.lit('<head><meta name="description" content=" About '), page.cast("string"), F.lit(' ">'))
    woven = vw.pages(spark, folder).withColumn(
        "html",
        F.replace(
            F.replace("html", F.lit("<head>"), about), F.lit("<article>"), F.concat(F.lit("<article>"), author, date, tags)
        ),
    )
    visible = extract.visible_nodes(extract.page_nodes(woven, ("page_id",)), ("page_id",))
    return visible.select(
        "page_id",
        extract.page_description().alias("description"),
        extract.page_author().alias("author"),
        vw.ntz(tx.parse_date(extract.page_date_text())).alias("publish_date"),
        F.array_join(extract.page_tags(), ",").alias("tags"),
    )


_ARTICLE = (
    "regexp_extract(regexp_replace(html, '(?s)<footer.*?</footer>', '', 'g'),"
    " '(?s)<article>(.*?)(</article>|$)', 1)"
)


_BODY = f"""articles AS (SELECT page_id, url, html, {_ARTICLE} AS article FROM pages),
  texts AS (SELECT *, {_element_sql('article')} AS whole,
    list_filter(list_transform(list_transform(string_split(article, '<p>')[2:],
        lambda p, i: CASE WHEN i = 1 THEN article[strpos(article, '<p>') + 3:]
          ELSE split_part(p, '</p>', 1) END),
      lambda p: {_element_sql('p')}), lambda p: length(p) > 50) AS paragraphs FROM articles),
  bodies AS (SELECT page_id, url, html, CASE WHEN length(whole) > 200 THEN whole
    ELSE array_to_string(paragraphs, ' ') END AS text FROM texts)"""
@query(
    f"""WITH {_BODY}
    SELECT page_id, url, {_TITLE} AS title, cast(NULL AS varchar) AS description, text AS content,
      cast(NULL AS varchar) AS author, cast(NULL AS timestamp) AS publish_date, '[]' AS tags,
      cast({_WORDS} AS int) AS word_count, cast(greatest(1, {_WORDS} // 200) AS int) AS reading_time,
      {_FLESCH} AS readability_score, timestamp '2024-01-01' AS extracted_at,
      md5(text) AS content_hash
    FROM bodies WHERE length(text) >= 100"""
)
def page_content(spark, folder):
    """Whole content records."""
    records = extract.content_records(
        _nodes(spark, folder), vw.moment(vw.EPOCH), ("page_id", "url")
    )
    return (
        extract.useful(records)
        .withColumn("tags", tx.encode_tags(C("tags")))
        .withColumn("publish_date", vw.ntz(C("publish_date")))
    )


@query(
    f"""WITH {_BODY}
    SELECT min(url) AS url, md5(text) AS content_hash FROM bodies WHERE length(text) >= 100
    GROUP BY text"""
)
def save_pages(spark, folder):
    """Pages read, made into records by the clock of the job, and saved: one page for each text."""
    path = new_path(spark, "content")
    nodes = extract.page_nodes(vw.pages(spark, folder))
    store.save_content(spark, path, extract.useful(extract.content_records(nodes)))
    return store.read_content(spark, path).select("url", "content_hash")


@query(
    f"""SELECT page_id, md5(body) AS content_hash, cast(length(body) AS int) AS n_chars
      FROM (SELECT page_id, {_element_sql(_ARTICLE)} AS body FROM pages) WHERE length(body) > 200"""
)
def page_article(spark, folder):
    """Main text by the first content selector alone."""
    visible = extract.visible_nodes(_nodes(spark, folder), ("page_id",))
    found = visible.select("page_id", F.expr(
        extract.first_text_over("article", 200)
    ).alias("body"))
    return found.where(C("body").isNotNull()).select(
        "page_id",
        tx.content_hash(C("body")).alias("content_hash"),
        F.length("body").alias("n_chars"),
    )


@query(
    f"""WITH found AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS root,
      unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    resolved AS (SELECT page_id, concat(root, {_UNESCAPE.format('href')}) AS url FROM found)
    SELECT page_id, {_normal_sql('url')} AS dst_url FROM resolved
    WHERE {_VALID} AND NOT regexp_matches({_PATH}, '\\.({_EXTENSIONS})$')"""
)
def page_links(spark, folder):
    nodes = _nodes(spark, folder)
    found = extract.links(nodes, from_cleaned=False, patterns=None, keep=["page_id"])
    return found.select("page_id", "dst_url")


# --------------------------------------------------------------------------- index


@query(
    _with(vw.CONTENT_SQL)
    + f"""SELECT url, field, term, cast(count(*) AS int) AS tf, cast(dl AS int) AS dl FROM (
      SELECT url, field, len(toks) AS dl, unnest(toks) AS term FROM (
        SELECT url, 'title' AS field, {_tokens('title')} AS toks FROM content UNION ALL
        SELECT url, 'content', {_tokens('content')} FROM content UNION ALL
        SELECT url, 'description', {_tokens('description')} FROM content))
      GROUP BY url, field, term, dl"""
)
def index_postings(spark, folder):
    return ix.postings(vw.content(spark, folder), key="url")


@query(
    _with(vw.CONTENT_SQL)
    + f"""SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM (
        SELECT 'title' AS field, {_tokens('title')} AS toks FROM content UNION ALL
        SELECT 'content', {_tokens('content')} FROM content UNION ALL
        SELECT 'description', {_tokens('description')} FROM content)
      WHERE len(toks) > 0 GROUP BY field"""
)
def index_field_stats(spark, folder):
    return ix.field_stats(vw.content(spark, folder))


@query(
    _with(vw.CONTENT_SQL)
    + f"""SELECT term, count(*) AS doc_freq FROM (
      SELECT unnest(list_distinct({_tokens('content')})) AS term FROM content) GROUP BY term"""
)
def index_vocabulary(spark, folder):
    return tb.vocabulary(vw.content(spark, folder), "content")


def _clean_sql(column: str) -> str:
    return _CLEAN.replace("(text,", f"({column},")


@query(
    _with(
        vw.CONTENT_SQL,
        _keywords_sql("concat(title, ' ', content)", "content", "url", 20),
    )
    + f"""SELECT url, {_clean_sql('title')} AS title, md5({_clean_sql('content')}) AS content_md5,
      description, author, array_to_string(tags, ',') AS tags, coalesce(words, '') AS keywords,
      publish_date, 0 AS word_count, 0 AS reading_time, author || '.example.org' AS domain,
      content_hash FROM content LEFT JOIN kw ON k = url"""
)
def index_documents(spark, folder):
    docs = ix.prepare_documents(vw.content(spark, folder), vw.moment(vw.EPOCH))
    return docs.select(
        "url",
        "title",
        F.md5("content").alias("content_md5"),
        "description",
        "author",
        F.array_join("tags", ",").alias("tags"),
        F.array_join("keywords", " ").alias("keywords"),
        "publish_date",
        "word_count",
        "reading_time",
        "domain",
        "content_hash",
    )


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT url, title, md5(content) AS content_md5, description, author,
      array_to_string(tags, ',') AS tags, publish_date, 0 AS word_count, content_hash FROM content"""
)
def index_slim_documents(spark, folder):
    docs = ix.prepare_documents(vw.content(spark, folder), vw.moment(vw.EPOCH), raw=True)
    return docs.select(
        "url", "title", F.md5("content").alias("content_md5"), "description", "author",
        F.array_join("tags", ",").alias("tags"), "publish_date", "word_count", "content_hash",
    )


def _index(spark, folder):
    rows = vw.content(spark, folder)
    return rows.select("url", "content_hash", C("extracted_at").alias("indexed_at"))


_LAST_OF_HASH = """SELECT url, content_hash, extracted_at AS indexed_at FROM (SELECT *, row_number()
  OVER (PARTITION BY content_hash ORDER BY extracted_at DESC, url DESC) AS rn FROM content)
  WHERE rn = 1"""


@query(_with(vw.CONTENT_SQL) + _LAST_OF_HASH)
def index_upsert(spark, folder):
    """The earlier half of the documents indexed first, then the later half over it."""
    docs, half = _index(spark, folder), vw.moment("2024-01-01 06:00:00")
    first = ix.upsert(None, docs.where(C("indexed_at") < half))
    return ix.upsert(first, docs.where(C("indexed_at") >= half))


# Every tenth document has no hash and stands for itself.
_SPARSE = """sparse AS (SELECT * REPLACE (CASE WHEN doc_id % 10 > 0 THEN content_hash END AS content_hash)
  FROM content)"""
_LAST_OF_SPARSE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash,
    CASE WHEN content_hash IS NULL THEN url END ORDER BY extracted_at DESC, url DESC) AS rn FROM sparse)
  WHERE rn = 1"""


@query(
    f"""WITH {vw.CONTENT_SQL}, {_SPARSE}
    SELECT url, content_hash, extracted_at AS indexed_at FROM ({_LAST_OF_SPARSE})"""
)
def index_bulk(spark, folder):
    """The same over whole documents in a written index, where the later half is a second segment."""
    path = _written_index(spark, folder)
    return sg.read_index(spark, path).select("url", "content_hash", "indexed_at")


def _halves(spark, folder):
    half = vw.moment("2024-01-01 06:00:00")
    rows = vw.content(spark, folder)
    rows = rows.withColumn("content_hash", F.when(C("doc_id") % 10 > 0, C("content_hash")))
    docs = ix.prepare_documents(rows, C("extracted_at"))
    return docs.where(C("indexed_at") < half), docs.where(C("indexed_at") >= half)


def _written_index(spark, folder):
    path = new_path(spark, "index")
    for half in _halves(spark, folder):
        sg.bulk_index(spark, path, half)
    return path


@query(
    f"""WITH {vw.CONTENT_SQL}, {_SPARSE}, deleted AS (SELECT content_hash FROM sparse
      WHERE list_contains(tags, 'fr') AND content_hash IS NOT NULL)
    SELECT url, content_hash, md5({_clean_sql('content')}) AS content_md5 FROM ({_LAST_OF_SPARSE})
    WHERE content_hash IS NULL OR content_hash NOT IN (SELECT content_hash FROM deleted)"""
)
def index_bulk_delete(spark, folder):
    """French hashes deleted from the written index, which is then compacted."""
    path, small = _written_index(spark, folder), new_path(spark, "index")
    french = vw.content(spark, folder).where(F.array_contains("tags", "fr") & (C("doc_id") % 10 > 0))
    sg.bulk_delete(spark, path, french.select("content_hash"))
    sg.compact(spark, path, small)
    return sg.read_index(spark, small).select("url", "content_hash", F.md5("content").alias("content_md5"))


_THREE = ((1, DOC_QUERY), (2, "antion"), (3, "the anble of zzz the"))
_LIVE = f"""live AS (SELECT url, publish_date, {_clean_sql('title')} AS title, {_clean_sql('content')} AS content,
    description, content_hash FROM ({_LAST_OF_SPARSE}) WHERE content_hash IS NULL OR content_hash NOT IN (
      SELECT content_hash FROM sparse WHERE list_contains(tags, 'fr') AND content_hash IS NOT NULL))"""
_THREE_TERMS = " UNION ALL ".join(
    f"SELECT {i} AS query_id, unnest(string_split('{q}', ' ')) AS term" for i, q in _THREE
)
_LIVE_HITS = (
    _with(vw.CONTENT_SQL, _SPARSE, _LIVE, _bm25_sql("live", "url", se.BOOSTS, _THREE_TERMS))
    + """SELECT cast(query_id AS int) AS query_id, cast(rank AS int) AS rank, url, score FROM (
      SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
        publish_date DESC NULLS LAST, coalesce('h:' || content_hash, 'u:' || url)) AS rank
      FROM scored JOIN live USING (url)) WHERE rank <= 10"""
)


def _changed_index(spark, folder):
    path = _written_index(spark, folder)
    french = vw.content(spark, folder).where(F.array_contains("tags", "fr") & (C("doc_id") % 10 > 0))
    sg.bulk_delete(spark, path, french.select("content_hash"))
    return path


@query(_LIVE_HITS)
def search_segments(spark, folder):
    """Three searches of an index written in two parts and deleted from, without a rebuild."""
    queries = spark.createDataFrame(_THREE, "query_id int, query string")
    return sg.top_hits(spark, _changed_index(spark, folder), queries)


@query(_LIVE_HITS)
def search_merged(spark, folder):
    """The same after its segments were merged and what they were made of is gone."""
    path = _changed_index(spark, folder)
    sg.merge(spark, path, everything=True)
    sg.expire(spark, path)
    return sg.top_hits(spark, path, spark.createDataFrame(_THREE, "query_id int, query string"))


@query(
    f"""WITH {vw.CONTENT_SQL}, {_SPARSE}, last AS ({_LAST_OF_SPARSE}),
    halves AS (SELECT extracted_at < timestamp '2024-01-01 06:00:00' AS early,
      coalesce(content_hash, url) AS k FROM sparse)
    SELECT (SELECT count(DISTINCT k) FROM halves WHERE early) AS first_written,
      (SELECT count(DISTINCT k) FROM halves WHERE NOT early) AS then_written,
      (SELECT count(*) FROM last) AS total"""
)
def index_bulk_counts(spark, folder):
    """Numbers of documents that two writes report, and of the index after them."""
    path = new_path(spark, "index")
    written = [sg.bulk_index(spark, path, half) for half in _halves(spark, folder)]
    return spark.createDataFrame(
        [(*written, sg.count(spark, path))], "first_written bigint, then_written bigint, total bigint"
    )


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT url, content_hash, extracted_at AS indexed_at FROM content WHERE content_hash NOT IN (
      SELECT content_hash FROM content WHERE list_contains(tags, 'fr'))"""
)
def index_delete(spark, folder):
    rows = vw.content(spark, folder)
    deletes = rows.where(F.array_contains("tags", "fr")).select("content_hash")
    return ix.delete(_index(spark, folder), deletes)


@query(
    _with(vw.CONTENT_SQL)
    + f"""SELECT url, content_hash, {_clean_sql('title')} AS title FROM (SELECT *, row_number() OVER (
      PARTITION BY content_hash ORDER BY url DESC) AS rn FROM (
        SELECT * FROM content)) WHERE rn = 1"""
)
def index_rebuild(spark, folder):
    """From the whole table, all with one indexing time."""
    index = ix.reindex(vw.content(spark, folder), vw.moment(vw.EPOCH))
    return index.select("url", "content_hash", "title")


@query(
    _with(vw.CONTENT_SQL)
    + """SELECT count(DISTINCT content_hash) AS total_documents, 'index' AS source FROM content
      UNION ALL SELECT count(*), 'table' FROM content"""
)
def index_stats(spark, folder):
    rows, index = vw.content(spark, folder), ix.upsert(None, _index(spark, folder))
    full = stats.index_stats(index, rows).withColumn("source", F.lit("index"))
    empty = stats.index_stats(index.where(C("url") == ""), rows)
    return full.unionByName(empty.withColumn("source", F.lit("table")))


# --------------------------------------------------------------------------- similarity


_SETS = f"""docs AS (SELECT doc_id, list_distinct(list_filter(string_split(lower({_CLEAN}), ' '),
    lambda w: w <> '')) AS words FROM documents),
  words AS (SELECT doc_id, len(words) AS n, unnest(words) AS w FROM docs WHERE len(words) > 0)"""


@query(
    _with(
        _SETS,
        """shared AS (SELECT a.doc_id, b.doc_id AS other, a.n AS na, b.n AS nb, count(*) AS common
        FROM words a JOIN words b ON a.w = b.w AND b.doc_id < a.doc_id GROUP BY ALL),
        alike AS (SELECT doc_id, other, common / (na + nb - common) AS similarity FROM shared
          WHERE common / (na + nb - common) >= 0.8::double)""",
    )
    + """SELECT doc_id, min(other) AS duplicate_of, round(arg_min(similarity, other), 6) AS similarity
      FROM alike GROUP BY doc_id"""
)
def near_duplicates(spark, folder):
    found = dedup.near_duplicates(vw.documents(spark, folder), "doc_id", "text")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    _with(_SETS)
    + """SELECT a.doc_id, CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN false ELSE
        len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words)))
          >= 0.8::double END AS duplicate
      FROM docs a JOIN docs b ON b.doc_id = a.doc_id // 2"""
)
def duplicate_pairs(spark, folder):
    """The pair test on each document and the one with half its number."""
    docs = vw.documents(spark, folder)
    other = docs.select(C("doc_id").alias("other_id"), C("text").alias("other"))
    return docs.join(other, C("other_id") == F.expr("doc_id div 2")).select(
        "doc_id", tx.is_content_duplicate(C("text"), C("other")).alias("duplicate")
    )


def _vocabulary(spark, folder):
    return tb.vocabulary(vw.products(spark, folder), "spellcheck")


_VOCABULARY = f"""vocabulary AS (SELECT term, count(*) AS doc_freq FROM (
    SELECT unnest(list_distinct({_tokens('spellcheck')})) AS term FROM products) GROUP BY term)"""
_SUGGEST = f"""terms AS (SELECT DISTINCT unnest({_tokens('query')}) AS term FROM misspelt),
  suggested AS (SELECT *, row_number() OVER (PARTITION BY term
      ORDER BY doc_freq DESC, similarity DESC, suggestion) AS rank FROM (
    SELECT t.term, v.term AS suggestion, v.doc_freq, 1.0::double
      - damerau_levenshtein(t.term, v.term) / least(length(t.term), length(v.term)) AS similarity
    FROM terms t JOIN vocabulary v ON left(t.term, 1) = left(v.term, 1)
      AND damerau_levenshtein(t.term, v.term) <= 2
    WHERE t.term NOT IN (SELECT term FROM vocabulary) AND length(t.term) >= 4)
    WHERE similarity >= 0.5)"""
_CORRECTED = f"""corrected AS (SELECT query_id, query,
    string_agg(coalesce(suggestion, w.term), ' ' ORDER BY pos) AS corrected_query
  FROM (SELECT query_id, query, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (
      SELECT *, {_tokens('query')} AS ws FROM misspelt)) w
    LEFT JOIN suggested s ON s.term = w.term AND s.rank = 1
  GROUP BY query_id, query)"""
_SPELL = (vw.PRODUCTS_SQL, vw.MISSPELT_SQL, _VOCABULARY, _SUGGEST)


@query(
    _with(*_SPELL)
    + """SELECT term, cast(rank AS int) AS rank, suggestion, doc_freq, round(similarity, 6) AS similarity
      FROM suggested WHERE rank <= 3"""
)
def spell_suggest(spark, folder):
    terms = vw.misspelt(spark, folder).select(F.explode(tx.tokens(C("query"))).alias("term"))
    path, known = new_path(spark, "deletions"), _vocabulary(spark, folder)
    suggest.write_deletions(known, path)
    found = suggest.suggestions(terms, known, index=path)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_with(*_SPELL, _CORRECTED) + "SELECT query_id, query, corrected_query FROM corrected")
def spell_corrected_query(spark, folder):
    return suggest.corrected_queries(vw.misspelt(spark, folder), _vocabulary(spark, folder))


@query(
    _with(
        *_SPELL,
        _CORRECTED,
        _bm25_sql(
            "products",
            "p_partkey",
            {"product_name": 2.0, "spellcheck": 1.0},
            f"SELECT query_id, unnest({_tokens('corrected_query')}) AS term FROM corrected",
        ),
    )
    + """SELECT query_id, query, corrected_query, cast(rank AS int) AS rank, p_partkey, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS rank
      FROM scored) JOIN corrected USING (query_id) WHERE rank <= 10"""
)
def spell_search(spark, folder):
    products = cut(vw.products(spark, folder))
    return suggest.corrected_search(vw.misspelt(spark, folder), products, "p_partkey")


# --------------------------------------------------------------------------- frontier


def _frontier(spark, folder):
    pages = tb.read_table(spark, folder, "pages", ["page_id", "url"])
    return pages.select("url", (C("page_id") % 4).cast("int").alias("priority"), "page_id")


_FRONTIER = "frontier AS (SELECT url, cast(page_id % 4 AS int) AS priority, page_id FROM pages)"


@query("SELECT url, 10 AS priority FROM pages")
def seed_urls(spark, folder):
    return tb.seed_urls(tb.read_table(spark, folder, "pages", ["url"]))


@query(
    _with(_FRONTIER)
    + "SELECT url, priority FROM frontier ORDER BY priority DESC, url DESC LIMIT 25"
)
def frontier_next(spark, folder):
    return frontier.next_urls(_frontier(spark, folder), 25).select("url", "priority")


@query(
    _with(_FRONTIER)
    + """SELECT url, md5(url) AS url_hash, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS domain,
      arg_max(priority, seq) AS priority FROM (
        SELECT url, priority, -1 AS seq FROM frontier WHERE page_id % 3 <> 0
        UNION ALL SELECT url, 1, page_id FROM pages WHERE page_id % 5 <> 0
        UNION ALL SELECT url, 7, page_id + 100000000 FROM pages
          WHERE page_id % 10 = 1)
      GROUP BY url"""
)
def frontier_add(spark, folder):
    """Queue most pages again, some twice, where every fifth is crawled already."""
    rows = _frontier(spark, folder)
    page = C("page_id")
    added = rows.select("url", F.lit(1).alias("priority"), page.alias("seq")).unionByName(
        rows.where(page % 10 == 1).select(
            "url", F.lit(7).alias("priority"), (page + 100_000_000).alias("seq")
        )
    )
    crawled = rows.where(page % 5 == 0).select(ux.url_hash(C("url")).alias("url_hash"))
    queued = frontier.add_urls(rows.where(page % 3 != 0), added, crawled)
    details = frontier.described(queued, vw.moment(vw.EPOCH))
    return details.select("url", "url_hash", "domain", "priority")


@query(
    _with(vw.URLS_SQL)
    + """SELECT page_id, variant, url FROM urls WHERE md5(url) NOT IN (
      SELECT md5(url) FROM urls WHERE variant IN (0, 3) AND page_id % 3 <> 1)"""
)
def frontier_unseen(spark, folder):
    """All spellings of the URLs against a set of some, behind a filter that is built in two rounds."""
    urls = vw.urls(spark, folder).withColumn("url_hash", ux.url_hash(C("url")))
    first = urls.where((C("variant") == 0) & (C("page_id") % 3 != 1)).select("url_hash")
    then = urls.where((C("variant") == 3) & (C("page_id") % 3 != 1)).select("url_hash")
    blocks = seen.blocks_for(urls.count())
    table = cut(seen.extended(seen.seen_filter(first, blocks), then, blocks))
    return seen.not_seen(urls, first.unionByName(then), table, blocks).drop("url_hash")


@query(
    "SELECT DISTINCT md5(url) AS url_hash FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0"
)
def mark_crawled(spark, folder):
    rows = _frontier(spark, folder)
    crawled = rows.where(C("page_id") % 2 == 0).select(ux.url_hash(C("url")).alias("url_hash"))
    return frontier.mark_crawled(crawled, rows.where(C("page_id") % 3 == 0))


_CRAWL = f"""WITH RECURSIVE {vw.linked_pages_sql(_normal_sql('url'))},
    found AS (SELECT url AS src_url, regexp_extract(url, '^https?://[^/?#]*') AS site,
      unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM linked),
    resolved AS (SELECT src_url, CASE WHEN regexp_matches(href, '^https?://') THEN {_UNESCAPE.format('href')}
      ELSE concat(site, {_UNESCAPE.format('href')}) END AS url FROM found),
    links AS (SELECT DISTINCT src_url, {_normal_sql('url')} AS dst_url FROM resolved
      WHERE {_VALID} AND NOT regexp_matches({_PATH}, '\\.({_EXTENSIONS})$')),
    walk AS (SELECT url, 0 AS round FROM linked WHERE page_id = 0 UNION
      SELECT s.url, w.round + 1 FROM walk w JOIN links l ON l.src_url = w.url
      JOIN linked s ON s.url = l.dst_url WHERE w.round < 25),
    reached AS (SELECT url, cast(min(round) AS int) AS round FROM walk GROUP BY url)
"""


def _crawl(spark, folder):
    """From the first page over the links that stand in the pages."""
    pages = cut(vw.linked_pages(spark, folder))
    links = extract.links(extract.page_nodes(pages), from_cleaned=False, patterns=None)
    return pages, frontier.crawl(tb.seed_urls(pages.where(C("page_id") == 0)), pages.select("url"), links)


@query(_CRAWL + "SELECT url, round, CASE WHEN round = 0 THEN 10 ELSE 1 END AS priority FROM reached")
def crawl_pages(spark, folder):
    return _crawl(spark, folder)[1]


@query(
    _CRAWL
    + """SELECT round, count(*) AS pages, cast(sum(count(*)) OVER (ORDER BY round) AS bigint) AS crawled_count
      FROM reached GROUP BY round"""
)
def crawl_progress(spark, folder):
    return stats.crawl_progress(_crawl(spark, folder)[1])


@query(
    _CRAWL
    + f""", {_BODY.replace('FROM pages', 'FROM linked')}
    SELECT min(url) AS url, md5(text) AS content_hash, arg_min(round, url) AS round
    FROM bodies JOIN reached USING (url) WHERE length(text) >= 100 GROUP BY text"""
)
def crawl_bfs(spark, folder):
    """The whole job: pages crawled, made into records and saved, each text by its first url."""
    path = new_path(spark, "content")
    pages, reached = _crawl(spark, folder)
    frontier.save_crawled(spark, path, pages, reached, vw.moment(vw.EPOCH))
    saved = store.read_content(spark, path).select("url", "content_hash")
    return saved.join(reached.select("url", "round"), "url")


_DELAY = (
    "CASE {0} "
    + " ".join(f"WHEN '{d}' THEN {s}::double" for d, s in config.DOMAIN_DELAYS.items())
    + " ELSE 1.0::double END"
)
_KNOWN = ", ".join(f"'{d}'" for d in config.DOMAIN_DELAYS)


@query(
    f"""SELECT page_id, domain, {_DELAY.format('domain')} AS delay FROM (
      SELECT page_id, CASE WHEN page_id % 4 = 0 THEN ([{_KNOWN}])[1 + page_id // 4 % 6]
        ELSE lower(regexp_extract(url, '{ux.NETLOC}', 1)) END AS domain FROM pages)"""
)
def domain_delay(spark, folder):
    names = F.array(*[F.lit(d) for d in config.DOMAIN_DELAYS])
    page = C("page_id")
    domain = F.when(
        page % 4 == 0, F.get(names, (F.floor(page / 4) % 6).cast("int"))
    ).otherwise(ux.url_domain(C("url")))
    rows = tb.read_table(spark, folder, "pages", ["page_id", "url"]).select(
        "page_id", domain.alias("domain")
    )
    return rows.withColumn("delay", frontier.rate_limit_delay(C("domain")))


@query(
    _with(_FRONTIER)
    + f"""SELECT url, priority, domain, row_number() OVER w AS position, (row_number() OVER w - 1)
        * CASE WHEN domain LIKE 'm.%' THEN length(domain) / 2.0::double ELSE 1.0::double END AS fetch_offset
      FROM (SELECT *, lower(regexp_extract(url, '{ux.NETLOC}', 1)) AS domain FROM frontier)
      WINDOW w AS (PARTITION BY domain ORDER BY priority DESC, url DESC)"""
)
def polite_schedule(spark, folder):
    """With a table of delays for some hosts."""
    domain = ux.url_domain(C("url"))
    hosts = tb.read_table(spark, folder, "pages", ["url"]).select(domain.alias("domain"))
    delays = hosts.where(C("domain").startswith("m.")).withColumn("delay", F.length("domain") / 2)
    return frontier.polite_schedule(_frontier(spark, folder), delays=delays)


@query(
    f"""SELECT page_id, CASE WHEN host LIKE 'm.%' THEN concat('/', length(host), '/') END AS disallowed,
      CASE WHEN host LIKE 'm.%' THEN length(host)::DOUBLE END AS crawl_delay
    FROM (SELECT page_id, lower(regexp_extract(url, '{ux.NETLOC}', 1)) AS host FROM pages)"""
)
def robots_of_urls(spark, folder):
    """Pages with the rules of their host, where the table of robots files has any."""
    pages = tb.read_table(spark, folder, "pages", ["page_id", "url"])
    hosts = pages.select(ux.url_domain(C("url")).alias("host")).where(C("host").startswith("m."))
    size = F.length("host").cast("string")
    body = F.concat(F.lit("User-agent: *\nDisallow: /"), size, F.lit("/\nCrawl-delay: "), size)
    found = rb.rules_of_urls(pages, hosts.withColumn("body", body))
    return found.select("page_id", F.array_join("disallowed", ",").alias("disallowed"), "crawl_delay")


@query(
    _with(vw.ROBOTS_SQL)
    + r"""SELECT page_id, kind, cast(position AS int) AS position, value FROM (
      SELECT page_id, 'disallow' AS kind, 0 AS position,
        nullif(trim(regexp_extract(body, '\n  Disallow: ([^\n]*)', 1), chr(13) || ' '), '') AS value
        FROM robots
      UNION ALL SELECT page_id, 'allow', 0, '/a/' || page_id FROM robots
      UNION ALL SELECT page_id, 'crawl-delay', 0, cast(page_id::double AS varchar) FROM robots
        WHERE page_id % 2 = 0
      UNION ALL SELECT page_id, 'sitemap', 0, '/top-' || page_id || '.xml' FROM robots
      UNION ALL SELECT page_id, 'sitemap', 1, '/other-' || page_id || '.xml' FROM robots)
      WHERE value IS NOT NULL"""
)
def robots_rules(spark, folder):
    return rb.robots_rules(vw.robots(spark, folder), "page_id", "bot")


# --------------------------------------------------------------------------- feeds


def _recent(spark, folder):
    return ct.recent_content(vw.content(spark, folder), config.DEFAULTS.max_feed_items)


_RECENT = """recent AS (SELECT * FROM content ORDER BY extracted_at DESC, url LIMIT 50)"""


@query(
    _with(vw.CONTENT_SQL, _RECENT)
    + """SELECT title, description, url AS link, url AS guid,
      strftime(publish_date, '%a, %d %b %Y %H:%M:%S GMT') AS "pubDate", author,
      array_to_string(tags, ',') AS category FROM recent"""
)
def rss_items(spark, folder):
    items = feeds.rss_items(_recent(spark, folder))
    return items.withColumn("category", F.array_join("category", ","))


@query(
    _with(vw.CONTENT_SQL, _RECENT)
    + """SELECT url AS id, url, title, content AS content_text, description AS summary,
      strftime(publish_date, '%Y-%m-%dT%H:%M:%S') AS date_published,
      array_to_string(tags, ',') AS tags, author AS authors FROM recent"""
)
def json_feed_items(spark, folder):
    items = feeds.json_items(_recent(spark, folder))
    return items.withColumn("tags", F.array_join("tags", ",")).withColumn(
        "authors", C("authors")[0]["name"]
    )


TOPICS = ("fr", "src1", "anble", "WORTH_E%S")


@query(
    _with(
        vw.CONTENT_SQL,
        "topics AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS topic)",
    )
    + """SELECT topic, cast(rank AS int) AS rank, url FROM (
      SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY extracted_at DESC, url) AS rank
      FROM content, topics WHERE title ILIKE '%' || topic || '%' OR content ILIKE '%' || topic || '%'
        OR tags[1] ILIKE '%' || topic || '%' OR tags[2] ILIKE '%' || topic || '%')
      WHERE rank <= 50"""
)
def topic_items(spark, folder):
    return ct.content_by_topics(vw.content(spark, folder), TOPICS).select("topic", "rank", "url")


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_TAGGED = "concat(chr(10), '    <{0}>', {1}, '</{0}>')"
_ITEM_XML = (
    "concat('<item>', "
    + ", ".join(
        _TAGGED.format(name, value)
        for name, value in (
            ("title", _escaped("title")),
            ("description", _escaped("description")),
            ("link", "url"),
            ("guid", "url"),
            ("pubDate", "strftime(publish_date, '%a, %d %b %Y %H:%M:%S GMT')"),
            ("author", "author"),
            ("category", "tags[1]"),
            ("category", "tags[2]"),
        )
    )
    + ", chr(10), '</item>')"
)
_RSS_HEAD = "\n".join(
    [
        '<?xml version="1.0" ?>',
        '<rss version="2.0">',
        "<channel>",
        f"<title>{config.DEFAULTS.feed_title}</title>",
        f"<description>{config.DEFAULTS.feed_description}</description>",
        f"<link>{config.DEFAULTS.feed_home}</link>",
        "<lastBuildDate>Mon, 01 Jan 2024 00:00:00 GMT</lastBuildDate>",
        "",
    ]
)
_RSS_SQL = f"""concat('{_RSS_HEAD}', string_agg({_ITEM_XML}, chr(10) ORDER BY rank),
  chr(10), '</channel>', chr(10), '</rss>', chr(10))"""
_JSON_HEAD = (
    '{"version":"https://jsonfeed.org/version/1.1",'
    f'"title":"{config.DEFAULTS.feed_title}","description":"{config.DEFAULTS.feed_description}",'
    f'"home_page_url":"{config.DEFAULTS.feed_home}","feed_url":"{config.DEFAULTS.feed_url}",'
    '"items":['
)
_JSON_SQL = f"""concat('{_JSON_HEAD}', string_agg(cast(to_json({{'id': url, 'url': url, 'title': title,
  'content_text': content, 'summary': description,
  'date_published': strftime(publish_date, '%Y-%m-%dT%H:%M:%S'), 'tags': tags,
  'authors': [{{'name': author}}]}}) AS varchar), ',' ORDER BY rank), ']}}')"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (ORDER BY extracted_at DESC, url) AS rank FROM content
  ORDER BY rank LIMIT 50)"""


@query(
    _with(
        vw.CONTENT_SQL,
        "topics AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS topic)",
        """ranked AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY topic ORDER BY extracted_at DESC, url) AS rank
          FROM content, topics WHERE title ILIKE '%' || topic || '%'
            OR content ILIKE '%' || topic || '%' OR tags[1] ILIKE '%' || topic || '%'
            OR tags[2] ILIKE '%' || topic || '%') WHERE rank <= 50)""",
    )
    + f"""SELECT topic, 'rss' AS format, {_RSS_SQL} AS feed FROM ranked GROUP BY topic
      UNION ALL SELECT topic, 'json', {_JSON_SQL} FROM ranked GROUP BY topic"""
)
def topic_feeds(spark, folder):
    """RSS and JSON documents of every topic, written as files and read back."""
    ranked = cut(ct.content_by_topics(vw.content(spark, folder), TOPICS))
    both = feeds.rss_feed(ranked, vw.moment(vw.EPOCH), "topic").withColumn("format", F.lit("rss"))
    both = both.unionByName(feeds.json_feed(ranked, "topic").withColumn("format", F.lit("json")))
    path = new_path(spark, "feeds")
    feeds.write_feeds(both, path, ["format", "topic"])
    written = spark.read.schema("value string, format string, topic string").text(
        path, wholetext=True
    )
    # The writer ends each file with a line feed of its own.
    return written.select("topic", "format", F.regexp_replace("value", r"\n\z", "").alias("feed"))


@query(_with(vw.CONTENT_SQL, _RANKED) + f"SELECT {_RSS_SQL} AS feed FROM ranked")
def rss_feed(spark, folder):
    return feeds.rss_feed(feeds.with_rank(_recent(spark, folder)), vw.moment(vw.EPOCH))


@query(_with(vw.CONTENT_SQL, _RANKED) + f"SELECT {_JSON_SQL} AS feed FROM ranked")
def json_feed(spark, folder):
    return feeds.json_feed(feeds.with_rank(_recent(spark, folder)))


# --------------------------------------------------------------------------- streams

_DOC_SCHEMA = "doc_id bigint, text string, lang string, source string"


def _content_stream(spark, folder):
    docs = st.read_stream(spark, folder, "documents", _DOC_SCHEMA)
    text = C("text")
    return docs.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/article/"), "doc_id").alias("url"),
        text.alias("content"),
        F.timestamp_add("MINUTE", C("doc_id").cast("int"), F.lit(vw.EPOCH).cast("timestamp")).alias(
            "extracted_at"
        ),
        F.md5(text).alias("content_hash"),
        F.array("lang", "source").alias("tags"),
    )


_STREAMED = "SELECT url, content_hash FROM (" + _FIRST_OF_HASH + ")"


@query(_with(vw.CONTENT_SQL) + _STREAMED + " JOIN content USING (url, content_hash) WHERE length(content) >= 100")
def stream_ingest(spark, folder):
    table = new_path(spark, "ingest")
    useful = extract.useful(_content_stream(spark, folder))
    st.ingest(useful, table, new_path(spark, "state")).awaitTermination()
    return store.read_content(spark, table).select("url", "content_hash")


@query(_with(vw.CONTENT_SQL) + _STREAMED)
def stream_dedup(spark, folder):
    """Keys are remembered for thirty days of the documents' own time, which span a week."""
    kept = st.deduplicated(_content_stream(spark, folder), "extracted_at", "30 days")
    path = new_path(spark, "dedup")
    st.write_files(kept, path, new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(path).select("url", "content_hash")


@query(
    """WITH days AS (SELECT date_trunc('day', ts) AS day, event_type AS topic, count(*) AS n
      FROM events GROUP BY ALL),
    starts AS (SELECT DISTINCT day - to_days(cast(k AS int)) AS window_start
      FROM days, range(7) AS r(k)),
    counts AS (SELECT window_start, topic, cast(sum(n) AS bigint) AS count FROM starts
      JOIN days ON day >= window_start AND day < window_start + interval 7 days GROUP BY ALL)
    SELECT window_start, topic, count FROM counts"""
)
def stream_trending(spark, folder):
    """Sliding weeks of event kinds, the running ones included."""
    events = st.read_stream(spark, folder, "events", "ts timestamp_ntz, event_type string").select(
        C("ts").cast("timestamp").alias("ts"), F.array("event_type").alias("tags")
    )
    path = new_path(spark, "trending")
    st.write_changes(st.trending(events, "ts"), path, new_path(spark, "state")).awaitTermination()
    return st.read_changes(spark, path, ["window_start", "topic"]).select(
        vw.ntz(C("window_start")).alias("window_start"), "topic", "count"
    )
