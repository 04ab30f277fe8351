"""The URL frontier: queueing, taking, marking, the crawl over stored pages, polite timing.

A frontier is ``(url, priority)``, the set of crawled pages ``(url_hash)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions.urls import url_domain, url_hash, url_netloc
from pageloom.operators import extract
from pageloom.operators.ranking import positions
from pageloom.session import cut
from pageloom.sources.store import save_content


def not_crawled(urls: DataFrame, crawled: DataFrame) -> DataFrame:
    """Rows whose URL is not among the crawled ones, given by ``url_hash`` or by ``url``."""
    if "url_hash" not in crawled.columns:
        return urls.join(crawled.select("url"), "url", "left_anti")
    return (
        urls.withColumn("url_hash", url_hash(F.col("url")))
        .join(crawled.select("url_hash"), "url_hash", "left_anti")
        .drop("url_hash")
    )


def add_urls(frontier: DataFrame | None, added: DataFrame, crawled: DataFrame) -> DataFrame:
    """The frontier after queueing ``added (url, priority[, seq])`` in the order of ``seq``.

    Crawled URLs are skipped; a URL queued again takes the priority it was last given. The last
    one is found by a partial aggregate, so a URL linked from everywhere is no hot spot.
    """
    seq = F.col("seq") if "seq" in added.columns else F.lit(0)
    # First one row for each added URL, then the crawled ones are looked up.
    last = added.groupBy("url").agg(
        F.max_by("priority", F.struct(seq, "priority")).alias("priority")
    )
    new = not_crawled(last, crawled).select("url", "priority")
    if frontier is None:
        return new
    both = frontier.select("url", "priority", F.lit(False).alias("new")).unionByName(
        new.withColumn("new", F.lit(True))
    )
    return both.groupBy("url").agg(
        F.max_by("priority", F.struct("new", "priority")).alias("priority")
    )


def described(frontier: DataFrame, added_at: Column | None = None) -> DataFrame:
    """Frontier rows with the details kept for each URL."""
    return frontier.select(
        url_hash(F.col("url")).alias("url_hash"),
        "url",
        "priority",
        url_netloc(F.col("url")).alias("domain"),
        (F.current_timestamp() if added_at is None else added_at).alias("added_at"),
    )


def next_urls(frontier: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` URLs to crawl next: highest priority, ties by descending url."""
    return frontier.orderBy(F.desc("priority"), F.desc("url")).limit(k)


def mark_crawled(crawled: DataFrame, urls: DataFrame) -> DataFrame:
    """The crawled set with ``urls`` added."""
    return crawled.select("url_hash").union(urls.select(url_hash(F.col("url")))).distinct()


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    max_pages: int | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Crawl over stored pages: ``(url, round, priority)`` of every page reached.

    ``seeds (url, priority)``, ``pages (url)`` that can be fetched, ``links (src_url, dst_url)``
    as extracted. Each round takes the ``batch`` best URLs of the frontier (all by default), so
    the number of jobs follows the depth of the graph and not its size; ``batch=1`` is the strict
    one-page order. URLs without a page count towards ``max_pages`` and may be queued again.
    Each round is written to the shared folder before the next is planned.
    """
    fetchable = cut(pages.select("url").distinct())
    found = cut(links.select("src_url", "dst_url").distinct())
    frontier = cut(seeds.groupBy("url").agg(F.max("priority").cast("int").alias("priority")))
    done: list[DataFrame] = []  # pages of the rounds before, (url, round, priority)
    taken, number = 0, 0
    while (max_pages is None or taken < max_pages) and not frontier.isEmpty():
        left = None if max_pages is None else max_pages - taken
        size = left if batch is None else batch if left is None else min(batch, left)
        picked, waiting = frontier, None
        if size is not None:
            picked = cut(next_urls(frontier, size))
            waiting = frontier.join(picked.select("url"), "url", "left_anti")
        taken += 0 if max_pages is None else picked.count()
        got = picked.join(fetchable, "url", "left_semi").select(
            "url", F.lit(number).alias("round"), "priority"
        )
        crawled = reduce(DataFrame.unionByName, [*done, got])
        added = found.join(
            got.select(F.col("url").alias("src_url")), "src_url", "left_semi"
        ).select(
            F.col("dst_url").alias("url"),
            F.lit(config.DEFAULTS.link_priority).alias("priority"),
        )
        queued = add_urls(waiting, added, crawled)
        # One table a round holds both what was reached and what is queued next.
        both = cut(
            got.unionByName(queued.select("url", F.lit(-1).alias("round"), "priority"))
        )
        frontier = both.where(F.col("round") < 0).select("url", "priority")
        done.append(both.where(F.col("round") >= 0))
        if len(done) > 16:  # keep the plan short over many rounds
            done = [cut(reduce(DataFrame.unionByName, done))]
        number += 1
    if not done:
        return seeds.select("url", F.lit(0).alias("round"), "priority").limit(0)
    return reduce(DataFrame.unionByName, done)


def save_crawled(
    spark: SparkSession, path: str, pages: DataFrame, reached: DataFrame, extracted_at: Column | None = None
) -> DataFrame:
    """Make records of the ``pages (url, html)`` that a crawl reached and save the useful ones to the
    content table at ``path``; returns what was written."""
    fetched = pages.select("url", "html").join(reached.select("url"), "url", "left_semi")
    return save_content(spark, path, extract.useful(extract.extract_pages(fetched, extracted_at)))


def rate_limit_delay(
    domain: Column, default: float = 1.0, delays: dict[str, float] | None = None
) -> Column:
    """Seconds between requests to a domain; exact match, else the default."""
    known = config.DOMAIN_DELAYS if delays is None else delays
    if not known:
        return F.lit(float(default))
    pairs = [F.lit(x) for name, seconds in known.items() for x in (name, float(seconds))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), domain), F.lit(float(default)))


def polite_schedule(
    frontier: DataFrame, default_delay: float = 1.0, delays: DataFrame | None = None
) -> DataFrame:
    """Planned fetch time of each URL, in seconds from the start, with a pause between requests to
    one domain: ``(url, priority, domain, position, fetch_offset)``.

    The pause is fixed for a domain, so the offset follows from the position, which is found
    without gathering a domain in one task. ``delays (domain, delay)``, such as the crawl delays of
    robots files, come before the configured ones; of several for a domain the longest counts.
    """
    placed = positions(
        frontier.select("url", "priority", url_domain(F.col("url")).alias("domain")),
        "domain",
        [F.desc("priority"), F.desc("url")],
    )
    delay = rate_limit_delay(F.col("domain"), default_delay)
    if delays is None:
        return placed.withColumn("fetch_offset", (F.col("position") - 1) * delay)
    known = delays.groupBy("domain").agg(F.max("delay").alias("_delay"))
    return (
        placed.join(known, "domain", "left")
        .withColumn("fetch_offset", (F.col("position") - 1) * F.coalesce("_delay", delay))
        .select(*placed.columns, "fetch_offset")
    )
