"""The search index as tables: documents, postings, field and term statistics; upsert, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom.functions import plain
from pageloom.functions import text as tx
from pageloom.functions.urls import url_netloc
from pageloom.session import broadcast_if_small, cut

FIELDS = ("title", "content", "description")


def _or_missing(content: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in content.columns else default


def prepare_documents(
    content: DataFrame, indexed_at: Column | None = None, raw: bool = False, keywords: int = 20
) -> DataFrame:
    """Index documents of content records, row by row.

    Title and text are cleaned, keywords come from both, missing numbers are 0 and missing tags
    empty. ``raw`` gives the slim form: fields as they are, no keywords.
    """
    blank, zero = F.lit(""), F.lit(0)
    no_tags = F.array().cast("array<string>")
    title = F.coalesce(F.col("title"), blank)
    text = F.coalesce(F.col("content"), blank)
    common = [
        F.coalesce("description", blank).alias("description"),
        (F.coalesce("author", blank) if raw else F.col("author")).alias("author"),
        F.coalesce("tags", no_tags).alias("tags"),
        "publish_date",
        _or_missing(content, "word_count", zero).alias("word_count"),
        (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"),
        "content_hash",
    ]
    if raw:
        return content.select("url", title.alias("title"), text.alias("content"), *common)
    return content.select(
        "url",
        plain.clean_text(title).alias("title"),
        plain.clean_text(text).alias("content"),
        *common,
        plain.keywords(F.concat_ws(" ", title, text), keywords).alias("keywords"),
        _or_missing(content, "reading_time", zero).alias("reading_time"),
        _or_missing(content, "readability_score", F.lit(None).cast("double")).alias(
            "readability_score"
        ),
        url_netloc(F.col("url")).alias("domain"),
    )


def _own_url() -> Column:
    """Documents without a hash are told apart by their url."""
    return F.when(F.col("content_hash").isNull(), F.col("url"))


def upsert(index: DataFrame | None, documents: DataFrame) -> DataFrame:
    """The index with ``documents`` written over those of the same hash; the last write wins.

    Within ``documents`` the latest ``indexed_at`` wins, ties by url. Each task keeps its own
    last row of a hash before the shuffle. A document without a hash takes the place of one without
    a hash of the same url.
    """
    last = W.partitionBy("content_hash", _own_url()).orderBy(F.desc("indexed_at"), F.desc("url"))
    new = (
        documents.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")
    )
    if index is None:
        return new
    hashed = new.where(F.col("content_hash").isNotNull()).select("content_hash")
    unhashed = new.where(F.col("content_hash").isNull()).select("url")
    nulls = index.where(F.col("content_hash").isNull()).join(unhashed, "url", "left_anti")
    kept = index.join(hashed, "content_hash", "left_anti").where(F.col("content_hash").isNotNull())
    return kept.unionByName(nulls).unionByName(new)


def delete(index: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index without the listed hashes."""
    return index.join(deletes.select("content_hash").distinct(), "content_hash", "left_anti")


def reindex(content: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """A new index from the whole content table."""
    return upsert(None, prepare_documents(content, indexed_at))


def postings(
    index: DataFrame, fields: Sequence[str] = FIELDS, key: str = "content_hash", mark: bool = False
) -> DataFrame:
    """Inverted index ``(key, field, term, tf, dl)``; ``dl`` is the length of the field.

    Terms are counted inside each row, so building it shuffles nothing. With ``mark``, ``first``
    tells one posting of each field of a document from the others, for ``stored_field_stats``.
    """
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), plain.word_counts(F.col(f)).alias("words")) for f in fields]
    )
    return (
        index.select(key, F.explode(per_field).alias("f"))
        .select(key, "f.field", F.col("f.words.dl").alias("dl"), F.posexplode("f.words.counts").alias("pos", "t"))
        .select(
            key,
            "field",
            F.col("t.value").alias("term"),
            F.col("t.n").alias("tf"),
            "dl",
            *([(F.col("pos") == 0).alias("first")] if mark else []),
        )
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_postings(table: DataFrame, path: str, buckets: int = 64) -> None:
    """Write postings by term, so a search reads only the buckets of its terms.

    Buckets are dealt out anew by their measured size: a large one, even of a single term that
    occurs everywhere, goes to several tasks, and small ones share a task.
    """
    (
        table.withColumn("bucket", _bucket(buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_postings(
    spark: SparkSession, path: str, terms: DataFrame | Sequence[str], buckets: int = 64, listed: int = 1_000
) -> DataFrame:
    """Postings of the given terms, a list or a table with a column ``term``.

    The buckets of the terms, at most ``buckets`` numbers, become a filter on folders, so no other
    folder is read. Up to ``listed`` terms are a filter of the scan as well, which skips row groups by
    it as they are sorted; more are joined, and sent to the postings if their measured size allows.
    """
    if not isinstance(terms, DataFrame):
        terms = spark.createDataFrame([(t,) for t in terms], "term string")
    asked = terms.select("term").distinct()
    few = [r["term"] for r in asked.limit(listed + 1).collect()]
    if len(few) > listed:
        asked = cut(asked)
    found = sorted(r["bucket"] for r in asked.select(_bucket(buckets).alias("bucket")).distinct().collect())
    stored = spark.read.parquet(path).where(F.col("bucket").isin(found))
    if len(few) <= listed:
        return stored.where(F.col("term").isin(few)).drop("bucket")
    kept = [c for c in stored.columns if c != "bucket"]
    return stored.join(broadcast_if_small(asked), "term", "left_semi").select(*kept)


def field_stats(index: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``(field, n_docs, avg_dl)`` over the documents that have the field; one row a field."""
    sizes = index.select(*[F.size(tx.tokens(F.col(f))).alias(f) for f in fields])
    totals = sizes.agg(
        *[F.count_if(F.col(f) > 0).alias(f"{f}_n") for f in fields],
        *[F.sum(f).alias(f"{f}_dl") for f in fields],
    )
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        F.col(f"{f}_n").alias("n_docs"),
                        (F.col(f"{f}_dl") / F.nullif(f"{f}_n", F.lit(0))).alias("avg_dl"),
                    )
                    for f in fields
                ]
            )
        ).alias("s")
    ).select("s.*")


def stored_field_stats(table: DataFrame) -> DataFrame:
    """``field_stats`` from marked postings, without reading a text again."""
    ones = table.where("first").groupBy("field")
    return ones.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def term_stats(table: DataFrame) -> DataFrame:
    """``(field, term, df)`` from postings."""
    return table.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
