"""URL functions: Column in, Column out, all inside the JVM except :func:`resolve_url`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions import workers
from pageloom.functions.chars import SPACE_CHARS

# Fixed value: the accepted URL shape (http or https; dotted host, localhost or dotted quad;
# optional port; then nothing, a slash, or a path or query without white space).
VALID_URL = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?"
    r"|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    rf"(?:/?|[/?][^{SPACE_CHARS}]+)\n?\z"
)
NETLOC = r"^(?:[^:/?#]+:)?//([^/?#]*)"
PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def url_netloc(url: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(url, NETLOC, 1)


def url_domain(url: Column) -> Column:
    """Host and port, lower case."""
    return F.lower(url_netloc(url))


def url_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), r";[^/]*$", "")


def url_hash(url: Column) -> Column:
    return F.md5(url)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID_URL), F.lit(False))


def normalize_url(
    url: Column, tracking: Sequence[str] = config.TRACKING_PARAMETERS
) -> Column:
    """Drop the fragment, tracking parameters, parameters without ``=`` and trailing slashes."""
    # An empty parameter list after the last path segment (a lone ';') does not survive either.
    base = F.regexp_replace(
        F.regexp_extract(url, r"^[^?#]*", 0), r"^(.*//[^/]*/(?:.*/)?[^/;]*);$", "$1"
    )
    base = F.concat(
        F.lower(F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?", 0)),
        F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""),
    )
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(
            F.split(query, "&"),
            lambda p: p.contains("=")
            & ~F.lower(F.substring_index(p, "=", 1)).isin(list(tracking)),
        ),
        "&",
    )
    joined = F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.rtrim(joined, F.lit("/"))


def is_same_domain(first: Column, second: Column) -> Column:
    a, b = url_domain(first), url_domain(second)
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def _any_match(url: Column, patterns: Sequence[str]) -> Column:
    return url.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def should_crawl_url(
    url: Column,
    seed_domains: Sequence[str] | None = None,
    allowed_patterns: Sequence[str] | None = None,
    blocked_patterns: Sequence[str] | None = None,
) -> Column:
    """Rule check with the lists given as arguments. Blocked beats allowed.

    For a seed table of unknown size use :func:`crawlable`.
    """
    rule = is_valid_url(url)
    if seed_domains:
        rule &= url_domain(url).isin(list(seed_domains))
    if blocked_patterns:
        rule &= ~_any_match(url, blocked_patterns)
    if allowed_patterns:
        rule &= _any_match(url, allowed_patterns)
    return F.coalesce(rule, F.lit(False))


def crawlable(urls: DataFrame, seeds: DataFrame, url: str = "url", **patterns) -> DataFrame:
    """Rows whose domain is among those of the ``seeds`` table and whose URL passes the rules.

    No broadcast hint: the optimizer decides by the measured size of the seeds.
    """
    domains = seeds.select(url_domain(F.col("url")).alias("_domain")).distinct()
    return (
        urls.where(should_crawl_url(F.col(url), **patterns))
        .withColumn("_domain", url_domain(F.col(url)))
        .join(domains, "_domain", "left_semi")
        .drop("_domain")
    )


def is_crawl_candidate(
    url: Column,
    patterns: Sequence[str] | None = config.USEFUL_URL_PATTERNS,
    extensions: Sequence[str] = config.EXCLUDED_EXTENSIONS,
) -> Column:
    """The filter for found links: valid, no excluded extension, one useful pattern.

    ``patterns=None`` leaves the pattern test out.
    """
    path = F.lower(url_path(url))
    rule = is_valid_url(url)
    for extension in extensions:
        rule &= ~path.endswith(extension)
    if patterns is not None:
        rule &= _any_match(url, patterns)
    return F.coalesce(rule, F.lit(False))


def robots_txt_url(url: Column) -> Column:
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url), F.lit("/robots.txt"))


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a reference against the URL of its page.

    References from the root, without dots or parameters to work on, are put together here; only
    the others go to Python.
    """
    plain = base.rlike(r"^https?://[^/?#\[\]]+([/?#]|$)") & href.rlike(r"^/([^/?#;.][^?#;.]*)?$")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    rest = F.when(~F.coalesce(plain, F.lit(False)), href)
    return F.when(plain, F.concat(root, href)).otherwise(
        F.pandas_udf(workers.resolve, "string")(F.when(rest.isNotNull(), base), rest)
    )


def _candidates(labels: Column) -> Column:
    """For each tail of a host, the rules that could fit it: ``struct<rule, exception, size>``, where
    ``size`` labels are the suffix if it does."""
    n = F.size(labels)

    def of_tail(size: Column) -> Column:
        tail = F.array_join(F.slice(labels, n - size + 1, size), ".")
        rest = F.array_join(F.slice(labels, n - size + 2, F.greatest(size - 1, F.lit(0))), ".")

        def rule(text: Column, exception: bool, labels_of_it: Column) -> Column:
            return F.struct(text.alias("rule"), F.lit(exception).alias("exception"), labels_of_it.alias("size"))

        return F.array(
            rule(tail, False, size),
            rule(F.when(size > 1, F.concat(F.lit("*."), rest)), False, size),
            rule(F.when(size > 1, F.concat(F.lit("!"), tail)), True, size - 1),
        )

    return F.flatten(F.transform(F.sequence(F.lit(1), n), of_tail))


def _unicode(name: Column) -> Column:
    """``name`` with its labels that begin with ``xn--`` decoded; other names see no Python."""
    coded = F.when(name.contains("xn--"), name)
    return F.when(coded.isNotNull(), F.pandas_udf(workers.decode_labels, "string")(coded)).otherwise(name)


def domain_info(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``info struct<domain, subdomain, suffix, registered_domain>`` by the rules of ``suffixes``.

    A rule is a suffix; ``*.`` before it stands for any one more label, and ``!`` before a name says
    that the name is registered, although a rule with ``*.`` makes it a suffix. An exception goes before
    all else, then the longest fit. The work is done once per distinct host, and rules are found by an
    equi-join on the host's tails. Names may be written in Unicode or in ASCII (``xn--``) on either side;
    the parts come as the host has them. A dot at the end of a host counts for nothing.

    A host without a fitting rule has neither suffix nor registered domain: its last label is its
    domain, an address is one as a whole. A host that is a suffix itself has no domain.
    """
    located = urls.withColumn("_netloc", url_netloc(F.col(url)))
    plain = F.regexp_replace(F.regexp_replace("_netloc", r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[\x{3002}\x{ff0e}\x{ff61}]", "."), r"\.$", "")
    hosts = located.select("_netloc").distinct().withColumn("_host", host)
    hosts = hosts.withColumn("_known", _unicode(F.col("_host")))
    rules = suffixes.select(_unicode(F.lower("suffix")).alias("rule")).distinct()
    best = (
        hosts.select("_netloc", "_host", F.inline(_candidates(F.split("_known", r"\."))))
        .join(rules, "rule")
        .groupBy("_netloc", "_host")
        .agg(F.max(F.struct("exception", "size"))["size"].alias("size"))
    )
    labels = F.split("_host", r"\.")
    n = F.size(labels) - F.col("size")
    suffix = F.array_join(F.slice(labels, n + 1, F.col("size")), ".")
    domain = F.coalesce(F.get(labels, n - 1), F.lit(""))
    info = best.select(
        "_netloc",
        F.struct(
            domain.alias("domain"),
            F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), ".").alias("subdomain"),
            suffix.alias("suffix"),
            F.when(domain != "", F.concat(domain, F.lit("."), suffix)).otherwise("").alias("registered_domain"),
        ).alias("_found"),
    )
    address = host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$")
    fallback = F.struct(
        F.when(address, host).otherwise(F.substring_index(host, ".", -1)).alias("domain"),
        F.when(address, F.lit("")).otherwise(F.regexp_extract(host, r"^(.*)\.[^.]*$", 1)).alias("subdomain"),
        F.lit("").alias("suffix"),
        F.lit("").alias("registered_domain"),
    )
    return (
        located.join(info, "_netloc", "left")
        .withColumn("info", F.coalesce("_found", fallback))
        .drop("_netloc", "_found")
    )
