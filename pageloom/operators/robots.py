"""Rules of robots.txt files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.chars import INLINE_SPACE_CHARS, strip
from pageloom.functions.urls import url_domain

_GAP = f"[{INLINE_SPACE_CHARS}]*"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def parse_robots(
    robots: DataFrame, user_agent: str = "*", body: str = "body", sitemaps_anywhere: bool = False
) -> DataFrame:
    """Adds ``allowed``, ``disallowed``, ``sitemap`` (arrays) and ``crawl_delay`` to each file.

    Lines belong to the latest ``User-agent`` line; the asked agent and ``*`` count. A sitemap
    counts only outside such groups unless ``sitemaps_anywhere``. Files are split at their agent
    lines inside the row, so nothing is shuffled.
    """
    text = F.concat(F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    parts = F.split(text, f"(?i)\n{_GAP}user-agent:")
    # The part before the first agent line has no agent; the others start with its name.
    groups = F.transform(
        parts,
        lambda part, i: F.struct(
            F.when(i > 0, strip(F.substring_index(part, "\n", 1))).alias("agent"),
            F.filter(
                F.transform(
                    F.split(
                        F.when(i > 0, F.regexp_replace(part, "^[^\n]*", "")).otherwise(part), "\n"
                    ),
                    lambda line: strip(line),
                ),
                lambda line: (line != "") & ~line.startswith("#"),
            ).alias("lines"),
        ),
    )
    staged = robots.withColumn("_groups", groups)
    ours = lambda g: F.coalesce(g["agent"].isin(user_agent, "*"), F.lit(False))

    def values(chosen: Column, field: str) -> Column:
        lines = F.flatten(F.transform(chosen, lambda g: g["lines"]))
        named = F.filter(lines, lambda v: F.lower(v).startswith(field + ":"))
        stripped = F.transform(named, lambda v: strip(F.substring(v, len(field) + 2, 2**31 - 1)))
        return F.filter(stripped, lambda v: v != "")

    mine = F.filter("_groups", ours)
    others = F.filter("_groups", (lambda g: F.lit(True)) if sitemaps_anywhere else lambda g: ~ours(g))
    delays = F.filter(
        F.transform(
            values(mine, "crawl-delay"),
            lambda v: F.when(v.rlike(_NUMBER), v.try_cast("double")),
        ),
        lambda v: v.isNotNull(),
    )
    return staged.select(
        *robots.columns,
        values(mine, "allow").alias("allowed"),
        values(mine, "disallow").alias("disallowed"),
        F.try_element_at(delays, F.lit(-1)).alias("crawl_delay"),
        values(others, "sitemap").alias("sitemap"),
    )


def rules_of_urls(
    urls: DataFrame, robots: DataFrame, url: str = "url", user_agent: str = "*", **options
) -> DataFrame:
    """``urls`` with the rules of their host from ``robots (host, body)``; null where there is no file.

    Files are parsed once for each host; of several for one the longest counts. The join's other
    side has each host once, so a host with very many urls can be dealt out.
    """
    one = robots.groupBy("host").agg(F.max_by("body", F.struct(F.length("body"), "body")).alias("body"))
    parsed = parse_robots(one, user_agent, **options).drop("body").withColumnRenamed("host", "_host")
    found = urls.withColumn("_netloc", url_domain(F.col(url)))
    return found.join(parsed, F.col("_netloc") == F.col("_host"), "left").drop("_netloc", "_host")


def robots_rules(robots: DataFrame, key: str = "host", user_agent: str = "*", **options) -> DataFrame:
    """Long form: ``(key, kind, position, value)``."""
    parsed = parse_robots(robots, user_agent, **options)
    delay = F.when(F.col("crawl_delay").isNotNull(), F.array(F.col("crawl_delay").cast("string")))
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), values.alias("values"))
            for kind, values in (
                ("allow", F.col("allowed")),
                ("disallow", F.col("disallowed")),
                ("crawl-delay", delay),
                ("sitemap", F.col("sitemap")),
            )
        ]
    )
    return (
        parsed.select(key, F.explode(kinds).alias("k"))
        .select(key, F.col("k.kind").alias("kind"), F.posexplode("k.values").alias("position", "value"))
    )
