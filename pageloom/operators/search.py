"""Full-text search: BM25 over several fields, filters, paging, totals, highlights.

:func:`scan_search` answers one query from the documents; :func:`score` many from postings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom.functions import plain
from pageloom.functions import text as tx
from pageloom.functions.arrays import value_counts
from pageloom.session import broadcast_if_small, cut

BOOSTS = {"title": 3.0, "content": 2.0, "description": 1.0}
HIT_COLUMNS = ("url", "title", "description", "author", "tags", "publish_date")
K1, B = 1.2, 0.75
TASK_PARTS = 1_000_000  # parts of scores that a task adds up
DECIMALS = 4  # scores are compared at this precision, so that summing order cannot reorder hits


def weight(n_docs: Column, df: Column) -> Column:
    """The part of a term's score that is equal for all documents."""
    return F.lit(K1 + 1.0) * F.log1p((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avg_dl))


def filters(
    author: str | None = None,
    tags: Sequence[str] | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
) -> Column:
    """Condition on documents: exact author, any of the tags, date range with both ends."""
    rule = F.lit(True)
    if author:
        rule &= F.col("author") == author
    if tags:
        rule &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    if date_from is not None:
        rule &= F.col("publish_date") >= date_from
    if date_to is not None:
        rule &= F.col("publish_date") <= date_to
    return rule


def _order(key: str) -> list[Column]:
    return [F.desc("score"), F.desc_nulls_last("publish_date"), F.asc(key)]


def scan_scores(
    index: DataFrame, query: str, boosts: Mapping[str, float] = BOOSTS
) -> DataFrame:
    """``index`` with ``score``, documents that match only.

    Two passes over the text and no shuffle: one gathers the statistics into a single row, the
    other scores each document where it is read.
    """
    terms = tx.query_terms(query)
    distinct = sorted(set(terms))
    if not distinct:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    fields = list(boosts)

    def counted(rows: DataFrame, *keep: str) -> DataFrame:
        found = rows.select(*keep, *[plain.term_counts(F.col(f), distinct).alias(f"_{f}") for f in fields])
        counts = [F.get(f"_{f}", F.lit(0)).alias(f"_{f}_dl") for f in fields] + [
            F.get(f"_{f}", F.lit(i + 1)).alias(f"_{f}_{i}") for f in fields for i in range(len(distinct))
        ]
        # A generator of one row: a condition on a count cannot move below it, where it would
        # take the text apart once more for every count.
        return found.select(*keep, F.inline(F.array(F.struct(*counts))))

    totals = counted(index).agg(
        F.struct(
            *[
                c
                for f in fields
                for c in (
                    F.count_if(F.col(f"_{f}_dl") > 0).alias(f"{f}_n"),
                    F.sum(f"_{f}_dl").alias(f"{f}_dl"),
                    *[
                        F.count_if(F.col(f"_{f}_{i}") > 0).alias(f"{f}_{i}")
                        for i in range(len(distinct))
                    ],
                )
            ]
        ).alias("totals")
    )
    stats = F.col("_totals")

    def field_score(f: str) -> Column:
        average = stats[f"{f}_dl"] / F.nullif(stats[f"{f}_n"], F.lit(0))
        parts = [
            F.lit(float(terms.count(t)))
            * weight(stats[f"{f}_n"], stats[f"{f}_{i}"])
            * F.when(
                F.col(f"_{f}_{i}") > 0,
                saturation(F.col(f"_{f}_{i}"), F.col(f"_{f}_dl"), average),
            ).otherwise(F.lit(0.0))
            for i, t in enumerate(distinct)
        ]
        return F.lit(float(boosts[f])) * reduce(lambda a, b: a + b, parts)

    scores = [F.coalesce(field_score(f), F.lit(0.0)) for f in fields]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    columns = index.columns
    # The statistics enter as one column, so the subquery is planned once.
    hit = reduce(
        lambda a, b: a | b,
        [F.col(f"_{f}_{i}") > 0 for f in fields for i in range(len(distinct))],
    )
    return (
        counted(index, *columns)
        .where(hit)
        .withColumn("_totals", totals.scalar())
        .select(*columns, F.round(best, DECIMALS).alias("score"))
    )


def scan_search(
    index: DataFrame,
    query: str,
    where: Column | None = None,
    size: int = 20,
    offset: int = 0,
    boosts: Mapping[str, float] = BOOSTS,
    key: str = "content_hash",
    highlights: bool = False,
) -> DataFrame:
    """One page of hits for one query. Filters do not change scores."""
    found = scan_scores(index, query, boosts)
    if where is not None:
        found = found.where(where)
    page = found.orderBy(*_order(key))
    page = (page.offset(offset) if offset else page).limit(size)
    shown = [c for c in HIT_COLUMNS if c in index.columns] or [key]
    extra = []
    if highlights:
        pattern = tx.hit_pattern(F.array(*[F.lit(t) for t in tx.query_terms(query)]))
        extra = [highlight_fields(pattern).alias("highlights")]
    return page.select(*shown, "score", *extra)


def scan_total(
    index: DataFrame,
    query: str,
    where: Column | None = None,
    fields: Sequence[str] = tuple(BOOSTS),
    cap: int | None = None,
) -> DataFrame:
    """Number of documents that match; nothing needs scoring for that."""
    terms = [F.lit(t) for t in sorted(set(tx.query_terms(query)))]
    rule = F.lit(False)
    if terms:
        for f in fields:
            rule |= F.arrays_overlap(tx.tokens(F.col(f)), F.array(*terms))
    matched = F.coalesce(rule & (F.lit(True) if where is None else where), F.lit(False))
    total = F.count_if(matched)
    return index.agg((total if cap is None else F.least(total, F.lit(cap))).alias("total"))


def highlight_fields(pattern: Column) -> Column:
    return F.struct(
        tx.highlight(F.col("title"), pattern, 100, 5).alias("title"),
        tx.highlight(F.col("content"), pattern, 150, 3).alias("content"),
    )


def score(
    postings: DataFrame,
    field_stats: DataFrame,
    term_stats: DataFrame,
    queries: DataFrame,
    boosts: Mapping[str, float] = BOOSTS,
    key: str = "content_hash",
    scattered: bool = False,
) -> DataFrame:
    """``(query_id, key, score)`` for every query of ``queries (query_id, query)`` and document.

    Query terms are first weighted with the statistics; one join on (field, term) then reaches
    the postings. If the weights are small, by measure, they go to the postings: these stay where
    they are, and the terms of a document, which lie together, are summed before the shuffle.
    With ``scattered`` they do not lie together, as in postings stored by term: those of the terms are
    then dealt by document, each moved once however many queries ask for it, and all sums of a document
    are made in its task, where hits can be ranked without another shuffle.
    Otherwise both sides are shuffled, and a term that occurs everywhere is split by the adaptive
    skew join.
    """
    terms = (
        queries.select("query_id", F.explode(value_counts(tx.tokens(F.col("query")))).alias("t"))
        .select("query_id", F.col("t.value").alias("term"), F.col("t.n").alias("qtf"))
    )
    # One row a field: safe to send everywhere.
    weighted = (
        terms.join(term_stats, "term")
        .join(F.broadcast(field_stats.where(F.col("field").isin(*boosts))), "field")
        .select(
            "query_id",
            "field",
            "term",
            "df",
            "avg_dl",
            (F.col("qtf") * weight(F.col("n_docs"), F.col("df"))).alias("weight"),
        )
    )
    weighted = cut(weighted)
    weights = broadcast_if_small(weighted)
    if scattered and weights is not weighted:
        asked = postings.join(F.broadcast(weighted.select("field", "term").distinct()), ["field", "term"], "left_semi")
        asked = asked.select(key, "field", "term", "tf", "dl")
        # Each document with a term adds one part to the sums of each query that asks for it.
        parts = weighted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
        # Rows without a key are one document here, and may be many: they are summed before the shuffle.
        keyed = asked.where(F.col(key).isNotNull()).repartition(1 + parts // TASK_PARTS, key)
        return _summed(keyed, weights, boosts, key).unionByName(
            _summed(asked.where(F.col(key).isNull()), weights, boosts, key)
        )
    return _summed(postings, weights, boosts, key)


def _summed(postings: DataFrame, weights: DataFrame, boosts: Mapping[str, float], key: str) -> DataFrame:
    """The best field's sum over the terms, for each query and key."""
    matched = postings.join(weights, ["field", "term"]).select(
        "query_id",
        key,
        "field",
        (F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("part"),
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("field") == f, F.col("part"))), F.lit(0.0))
        * F.lit(float(b))
        for f, b in boosts.items()
    ]
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    return matched.groupBy("query_id", key).agg(F.round(best, DECIMALS).alias("score"))


def search(
    scores: DataFrame,
    index: DataFrame,
    where: Column | None = None,
    size: int = 10,
    offset: int = 0,
    key: str = "content_hash",
    show: Sequence[str] = (),
) -> DataFrame:
    """One page of hits for each query: ``query_id, rank, key, score`` and the ``show`` columns.

    Only the narrow filter and sort columns meet the scores; the texts of a document are fetched
    for the hits that remain.
    """
    dated = "publish_date" in index.columns
    narrow = index.where(where) if where is not None else index
    facts = narrow.select(
        key, F.col("publish_date") if dated else F.lit(None).cast("date").alias("publish_date")
    )
    ranked = W.partitionBy("query_id").orderBy(*_order(key))
    if where is None:
        # Nothing but ties with the last hit can come before it, so the others need no date.
        by_score = W.partitionBy("query_id").orderBy(F.desc("score"))
        near = scores.withColumn("_n", F.rank().over(by_score)).where(F.col("_n") <= offset + size)
        scores = broadcast_if_small(cut(near.drop("_n")))
    joined = (
        scores.join(facts, key)
        if dated or where is not None
        else scores.withColumn("publish_date", F.lit(None).cast("date"))
    )
    page = (
        joined.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= offset + size)
        .where(F.col("rank") > offset)
        .select("query_id", "rank", key, "score")
    )
    return page.join(index.select(key, *show), key) if show else page


def totals(scores: DataFrame, cap: int | None = None) -> DataFrame:
    """Hits of each query."""
    n = F.count(F.lit(1))
    return scores.groupBy("query_id").agg(
        (n if cap is None else F.least(n, F.lit(cap))).alias("total")
    )
