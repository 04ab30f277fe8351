"""Spelling suggestions from a vocabulary, corrected queries, search with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pageloom.functions import text as tx
from pageloom.functions.arrays import let
from pageloom.operators import index as ix
from pageloom.operators import search as se
from pageloom.session import broadcast_if_small, cut, stored

# Characters of a word used for finding candidates. The longer, the fewer words share a stem
# without being alike; the number of stems grows with its square.
PREFIX = 14
TASK_POSTINGS = 100_000  # that one task of a corrected search scores


def _stems(term: Column) -> Column:
    """The first ``PREFIX`` characters with up to two of them left out, never the first.

    Two words within two edits that begin with the same letter share at least one of these, so
    an equi-join on them finds every candidate. A word has at most 92, whatever its length, and
    up to PREFIX letters only words within four edits meet at all.
    """
    head = F.substring(term, 1, PREFIX)

    def without(word: Column, at: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))

    def deletes(words: Column) -> Column:
        return F.flatten(
            F.transform(
                words,
                lambda w: F.when(
                    F.length(w) > 1,
                    F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: without(w, i)),
                ).otherwise(F.array().cast("array<string>")),
            )
        )

    one = F.array_distinct(deletes(F.array(head)))
    return F.array_distinct(F.concat(F.array(head), one, deletes(one)))


def edits(one: Column, other: Column) -> Column:
    """Restricted Damerau distance: letters put in, left out or changed, and neighbours swapped."""
    rows = T.StructType(
        [
            T.StructField("above", T.ArrayType(T.IntegerType())),
            T.StructField("last", T.ArrayType(T.IntegerType())),
            T.StructField("before", T.StringType()),
        ]
    )

    def counted(word: Column, letters: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(letters))

        def row(state: Column, x: Column, i: Column) -> Column:
            def cell(made: Column, j: Column) -> Column:
                y = F.get(letters, j - 1)
                changed = F.get(state["last"], j - 1) + F.when(x == y, 0).otherwise(1)
                swapped = F.when(
                    (j > 1) & (x == F.get(letters, j - 2)) & (state["before"] == y), F.get(state["above"], j - 2) + 1
                )
                least = F.least(F.get(state["last"], j) + 1, F.get(made, j - 1) + 1, changed, swapped)
                return F.array_append(made, least)

            return F.aggregate(places, F.array(i), cell)

        start = F.struct(
            F.array().cast("array<int>").alias("above"),
            F.sequence(F.lit(0), F.size(letters)).alias("last"),
            F.lit(None).cast("string").alias("before"),
        ).cast(rows)
        numbered = F.transform(F.split(word, ""), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))

        def step(state: Column, c: Column) -> Column:
            made = F.struct(
                state["last"].alias("above"), row(state, c["x"], c["i"]).alias("last"), c["x"].alias("before")
            )
            return made.cast(rows)

        return F.aggregate(numbered, start, step, lambda state: F.element_at(state["last"], -1))

    empty = (one == "") | (other == "")
    return F.when(empty, F.length(one) + F.length(other)).otherwise(
        let(F.split(other, ""), lambda letters: counted(one, letters))
    )


def deletions(vocabulary: DataFrame) -> DataFrame:
    """The deletion index ``(stem, suggestion, doc_freq)`` of ``vocabulary (term, doc_freq)``."""
    return vocabulary.select(
        F.explode(_stems(F.col("term"))).alias("stem"), F.col("term").alias("suggestion"), "doc_freq"
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int")


def write_deletions(vocabulary: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the deletion index by stem, once for all later lookups."""
    (
        deletions(vocabulary)
        .withColumn("bucket", _bucket(buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "stem")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def _offered(spark: SparkSession, path: str, wanted: DataFrame, buckets: int, listed: int) -> DataFrame:
    """Entries of the written index for the stems ``wanted``: a filter of the scan for a few, and a
    join in place, without a shuffle of the index, where their measured size allows."""
    stems = cut(wanted.select("stem").distinct())
    few = [r["stem"] for r in stems.limit(listed + 1).collect()]
    table = spark.read.parquet(path)
    if len(few) <= listed:
        found = [r["b"] for r in stems.select(_bucket(buckets).alias("b")).distinct().collect()]
        return table.where(F.col("bucket").isin(found) & F.col("stem").isin(few)).drop("bucket")
    return table.join(broadcast_if_small(stems), "stem", "left_semi").drop("bucket")


def suggestions(
    terms: DataFrame,
    vocabulary: DataFrame,
    size: int = 3,
    min_length: int = 4,
    min_similarity: float = 0.5,
    index: str | None = None,
    buckets: int = 64,
    listed: int = 1_000,
) -> DataFrame:
    """``(term, rank, suggestion, doc_freq, similarity)`` for terms the vocabulary lacks.

    Candidates begin with the same letter and are at most two edits away, a swap of neighbours being
    one; the most frequent first, then the most similar, then by spelling. ``index`` is the folder of a
    deletion index written for the vocabulary, of which the stems of the terms alone are read. Without
    it the stems of the terms go to the vocabulary where their measured size allows, so that its own
    never leave their row.
    """
    spark = terms.sparkSession
    unknown = (
        terms.select("term")
        .where(F.length("term") >= min_length)
        .distinct()
        .join(vocabulary.select("term"), "term", "left_anti")
    )
    wanted = cut(unknown.select("term", F.explode(_stems(F.col("term"))).alias("stem")))
    offered = deletions(vocabulary) if index is None else _offered(spark, index, wanted, buckets, listed)
    near = F.abs(F.length("term") - F.length("suggestion")) <= 2
    similarity = 1.0 - F.col("edits") / F.least(F.length("term"), F.length("suggestion"))
    # A swap is two edits to the built-in distance, which is quick and rules most candidates out.
    plain = F.levenshtein("term", "suggestion", 4)
    found = (
        offered.join(broadcast_if_small(wanted), "stem")
        .where(near)
        .where(plain >= 0)
        .select("term", "suggestion", "doc_freq")
        .distinct()
        .withColumn("edits", F.when(plain < 2, plain).otherwise(edits(F.col("term"), F.col("suggestion"))))
        .where(F.col("edits") <= 2)
        .withColumn("similarity", similarity)
        .where(F.col("similarity") >= min_similarity)
    )
    best = W.partitionBy("term").orderBy(
        F.desc("doc_freq"), F.desc("similarity"), F.asc("suggestion")
    )
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= size)
        .select("term", "rank", "suggestion", "doc_freq", "similarity")
    )


def corrected_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(query_id, query, corrected_query)``: each term replaced by its best suggestion."""
    # Equal queries are corrected once.
    texts = queries.select("query").distinct()
    terms = texts.select("query", F.posexplode(tx.tokens(F.col("query"))).alias("pos", "term"))
    best = (
        suggestions(terms, vocabulary, size=1).select("term", "suggestion")
    )
    fixed = (
        terms.join(best, "term", "left")
        .select("query", F.struct("pos", F.coalesce("suggestion", "term").alias("word")).alias("w"))
        .groupBy("query")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list("w")), lambda w: w["word"]), " "
            ).alias("corrected_query")
        )
    )
    return queries.join(fixed, "query", "left").select(
        "query_id", "query", F.coalesce("corrected_query", F.lit("")).alias("corrected_query")
    )


def corrected_search(
    queries: DataFrame,
    products: DataFrame,
    key: str,
    spelling: str = "spellcheck",
    boosts: Mapping[str, float] | None = None,
    size: int = 10,
) -> DataFrame:
    """Correct each query against the ``spelling`` field, then search with the result.

    ``(query_id, query, corrected_query, rank, key, score)``.
    """
    from pageloom.sources.tables import vocabulary

    weights = {"product_name": 2.0, "spellcheck": 1.0} if boosts is None else boosts
    corrected = cut(corrected_queries(queries, vocabulary(products, spelling)))
    table = stored(ix.postings(products, list(weights), key, mark=True), "postings")
    # A product meets many queries, so what a task sums up follows its postings, not the size of its input.
    spread = table.repartition(1 + table.count() // TASK_POSTINGS, key)
    scores = se.score(
        spread,
        ix.stored_field_stats(table),
        ix.term_stats(table),
        corrected.select("query_id", F.col("corrected_query").alias("query")),
        weights,
        key,
    )
    hits = se.search(scores, products, size=size, key=key)
    return hits.join(corrected, "query_id").select(
        "query_id", "query", "corrected_query", "rank", key, "score"
    )
