"""URL filter with trust and distrust spread over the link graph of hosts.

Explicit rules judge the pages they fit. The others are judged by their host. Hosts with allowed
pages are seeds of trust, which flows along links by personalised PageRank; hosts with blocked
pages are seeds of distrust, which flows against links, to those who point at bad company. Both
are measured in pages, so a host is blocked where the distrust that reaches it outweighs the
trust, with a small weight for doubt.

Links become edges between hosts before they are shuffled, and rank tables hold only hosts that
some rank has reached. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import LOWER, UPPER, stored

#: Absolute references, with or without their scheme.
REFERENCE = (
    r"(?i)\s(?:href|src|action|data-href)\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'<>]+)"
)
DAMPING = 0.85
CHANGE = 1e-6
# A round changes ranks by at most twice the mass times the damping to the power of the rounds before,
# so the bound on the change holds after these, however long the chains of links are.
ROUNDS = math.ceil(math.log(CHANGE / 2) / math.log(DAMPING))
DOUBT = 1.0
THRESHOLD = 0.5


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules`` that fits, as a struct of ``rule`` and ``action``; null if none does.

    A rule is a host, with all its subdomains, and the start of a path. ``rules`` is a short list:
    it becomes part of the expression.
    """
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for name, action in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = name.partition("/")
        fits = (host_ == domain) | host_.endswith(f".{domain}")
        value = F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits & path_.startswith(slash + rest), value).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str, source: str) -> DataFrame:
    """``(src, dst, n)``: links from pages of one host to another host."""
    links = F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(REFERENCE), 1)
    absolute = F.transform(
        links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)
    )
    hosts = pages.select(
        host(F.col(url)).alias("src"), F.explode(F.transform(absolute, host)).alias("dst")
    )
    known = (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    return hosts.filter(known).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _shares(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``(at, to, share)``: what part of the rank of ``at`` goes on to ``to``."""
    total = edges.groupBy(start).agg(F.sum("n").alias("all"))
    return edges.join(total, start).select(
        F.col(start).alias("at"), F.col(end).alias("to"), (F.col("n") / F.col("all")).alias("share")
    )


def personalised_rank(
    seeds: DataFrame, shares: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING
) -> DataFrame:
    """``(host, rank)`` from ``seeds(host, mass)`` over ``shares(at, to, share)``.

    Ranks add up to the mass of the seeds: what does not go on over a link goes back to them. Stops
    when ranks change by less than a millionth in all, which ``ROUNDS`` rounds suffice for. A host with very many
    links meets a side that has it once, so its rows can be dealt out.
    """
    mass = seeds.agg(F.sum("mass")).first()[0] or 0.0
    rank = seeds.select("host", F.col("mass").alias("rank"))
    if not mass or not shares.take(1):
        return rank
    for _ in range(rounds):
        moved = stored(
            shares.join(rank, shares["at"] == rank["host"])
            .groupBy("to")
            .agg(F.sum(damping * F.col("share") * F.col("rank")).alias("got")),
            "moved",
        )
        back = (mass - (moved.agg(F.sum("got")).first()[0] or 0.0)) / mass
        new = moved.join(seeds, moved["to"] == seeds["host"], "full_outer").select(
            F.coalesce("to", "host").alias("host"),
            (F.coalesce("got", F.lit(0.0)) + back * F.coalesce("mass", F.lit(0.0))).alias("rank"),
        )
        new = stored(new, "ranks")
        change = (
            new.join(rank.withColumnRenamed("rank", "old"), "host", "full_outer")
            .agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))))
            .first()[0]
        )
        rank = new
        if (change or 0.0) <= CHANGE * mass:
            break
    return rank


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    key: str = "page_id",
    url: str = "url",
    source: str = "html",
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
    doubt: float = DOUBT,
) -> DataFrame:
    """``(key, host, path, rule, verdict, distrust)`` for each row of ``pages``.

    ``rules`` are pairs of a rule and ``allow`` or ``block``. ``distrust`` is the host's share of
    distrust in the rank that reaches it; from ``threshold`` on its pages are blocked unless a rule
    says otherwise. A null url, or one without a host, is fitted by no rule and reached by no rank,
    so it is allowed; a null page has no links. Repeated rows count and come out as often as they
    are put in, and an empty table gives an empty result.
    """
    address = F.col(url)
    named = (
        pages.select(F.col(key).alias("key"), host(address).alias("host"), path(address).alias("path"))
        .withColumn("found", rule(F.col("host"), F.col("path"), rules))
    )
    judged = named.select("host", F.col("found.action").alias("action"))
    seeds = stored(
        judged.filter((F.col("host") != "") & F.col("action").isNotNull())
        .groupBy("host", "action")
        .agg(F.count(F.lit(1)).cast("double").alias("mass")),
        "seeds",
    )
    edges = stored(host_edges(pages, url, source), "edges")

    def rank(action: str, start: str, end: str, name: str) -> DataFrame:
        of = seeds.filter(F.col("action") == action).select("host", "mass")
        found = personalised_rank(of, _shares(edges, start, end), rounds)
        return found.withColumnRenamed("rank", name)

    trust, distrust = rank("allow", "src", "dst", "good"), rank("block", "dst", "src", "bad")
    good, bad = (F.coalesce(c, F.lit(0.0)) for c in ("good", "bad"))
    hosts = trust.join(distrust, "host", "full_outer").select(
        "host", F.round(bad / (good + bad + doubt), 9).alias("distrust")
    )
    share = F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(share >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return named.join(hosts, "host", "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.action", by_host).alias("verdict"),
        share.alias("distrust"),
    )
