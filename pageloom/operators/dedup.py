"""Exact and near duplicates over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pageloom.functions import workers
from pageloom.functions.text import word_set, word_set_similarity
from pageloom.session import broadcast_if_small, cut, stored

# Tokens ordered by their exact frequency: at most this many, so the table sent to every executor
# stays under about 20 MB whatever the data (an 8-byte hash and an 8-byte count each). They are the
# most frequent ones.
COMMON_TOKENS = 1_000_000
SMALL_GROUP = 64
FIRST_STEP = 4
TILE_BYTES = 64_000_000  # of the signatures of one block of sets; a task holds two
TILE_PAIRS = 200_000  # pairs for which one more tile is worth its signatures, up to MOST_BLOCKS squared
MOST_BLOCKS = 8
PAIRED_CHARS = 50_000_000  # of the ids of sets in pairs, to be sent to every executor: some millions
_EPSILON = 1e-9


def exact_dedup(
    df: DataFrame, key: str = "content_hash", order: tuple[str, ...] = ("extracted_at", "url")
) -> DataFrame:
    """The first row of each key; rows with a null key are all kept.

    Every task keeps only its own first rows before the shuffle, so copies of one text, however
    many, reach the final task as one row from each task.
    """
    first = W.partitionBy(key).orderBy(*order)
    kept = (
        df.where(F.col(key).isNotNull())
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    return kept.unionByName(df.where(F.col(key).isNull()))


def _prefix_entries(sets: DataFrame, threshold: float) -> DataFrame:
    """``(token, id, size, place)`` for the rarest words of each set, ``place`` being 1 for the rarest.

    Two sets reach the threshold only if they share a word among the first
    ``size - ceil(threshold * size) + 1`` of each, in any order of words common to both. Rare words
    first keeps the groups small. The COMMON_TOKENS most frequent words are ordered by their count; all
    others come before them, in hash order. Every task has their table, so that a set is put in order
    where it is.
    """
    counts = stored(
        sets.select(F.explode("hashes").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") > 1),
        "counts",
    )
    least, held = 2, 0
    # There are as many different counts as the square root of all words at most.
    for row in sorted(counts.groupBy("df").count().collect(), reverse=True):
        held += row["count"]
        if held > COMMON_TOKENS:
            least = row["df"] + 1
            break
    common = counts.where(F.col("df") >= least).toArrow()
    table = sets.sparkSession.sparkContext.broadcast(workers.sorted_counts(common))
    kind = T.StructType(
        [
            T.StructField("token", T.LongType()),
            T.StructField("id", sets.schema["id"].dataType),
            T.StructField("size", T.IntegerType()),
            T.StructField("place", T.IntegerType()),
        ]
    )
    return sets.select("id", "size", "hashes").mapInArrow(workers.prefixes(table, threshold, _EPSILON), kind)


def near_duplicates(
    docs: DataFrame, key: str, text: str, threshold: float = 0.8
) -> DataFrame:
    """For every row with an earlier near duplicate, the first of them: ``(key, duplicate_of,
    similarity)``. Earlier means a smaller ``key``, near that the Jaccard similarity of the word
    sets reaches ``threshold``.

    The answer is exact and has at most one row for each input row, so it stays linear even where
    most rows are copies of each other. Rows with equal word sets are first folded into one.
    Then members of each group of sets that share a rare word are compared. A group of up to
    SMALL_GROUP is searched whole. In a larger one all members are first compared with its first
    few only: a set that finds a partner needs no later one, so a large group of copies is done
    at once. Sets without a partner go on, in growing steps, until every group is exhausted.
    """
    # A generator drops empty sets, since a filter on the set would compute it once more.
    filled = F.filter(F.array(word_set(F.col(text))), lambda w: F.size(w) > 0)
    words = docs.select(F.col(key).alias("id"), F.explode(filled).alias("words"))
    # The words of a row are made and written once, and stay where they are.
    keyed = stored(
        words.withColumn("set_key", F.md5(F.array_join("words", " "))).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "keyed",
    )
    firsts = stored(
        keyed.groupBy("set_key")
        .agg(F.min(F.struct("id", "row")).alias("first"))
        .select("set_key", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")),
        "firsts",
    )
    copies = cut(
        keyed.select("set_key", "row")
        .join(firsts, "set_key")
        .where(F.col("row") != F.col("first_row"))
        .select("row")
    )
    sets = keyed.join(broadcast_if_small(copies, PAIRED_CHARS), "row", "left_anti").select(
        "id",
        "words",
        F.size("words").alias("size"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    best = _first_partners(sets, threshold)
    resolved = firsts.select("set_key", "first_id").join(
        best.select(F.col("id").alias("first_id"), "partner", "similarity"), "first_id", "left"
    )
    # A copy of a set is also a duplicate of the set's own first row.
    copy = F.col("id") != F.col("first_id")
    return (
        keyed.select("id", "set_key")
        .join(resolved, "set_key")
        .select(
            F.col("id").alias(key),
            F.coalesce("partner", F.when(copy, F.col("first_id"))).alias("duplicate_of"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
        )
        .where(F.col("duplicate_of").isNotNull())
    )


def _first_partners(sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, partner, similarity)``: the smallest similar id before each set that has one."""
    signed = stored(
        sets.select("id", "size", F.arrow_udf(workers.signatures, "binary")("hashes").alias("signature")),
        "signatures",
    )
    entries = stored(_prefix_entries(sets, threshold), "entries")
    large = cut(
        entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_GROUP).select("token")
    )
    large = broadcast_if_small(large, PAIRED_CHARS)

    def improved(pairs: DataFrame, best: DataFrame | None) -> DataFrame:
        found = _verified(pairs, sets, signed, threshold)
        if best is not None:
            found = found.unionByName(best)
        return cut(
            found.groupBy("id").agg(
                F.min("partner").alias("partner"),
                F.min_by("similarity", "partner").alias("similarity"),
            )
        )

    small = entries.join(large, "token", "left_anti")
    best = improved(_candidates(small, small, threshold).distinct(), None)
    # Members of the groups still to be searched, with the last member already compared with.
    ahead = stored(
        entries.join(large, "token").select(
            "*",
            F.lit(None).cast(sets.schema["id"].dataType).alias("until"),
            F.lit(FIRST_STEP).alias("step"),
        ),
        "ahead",
    )
    window = FIRST_STEP
    while True:
        # A partner found before a group's mark cannot be improved there. Groups in which
        # every member is settled so are done.
        known = best.select("id", F.col("partner").alias("known"))
        pending = stored(
            ahead.join(broadcast_if_small(known, PAIRED_CHARS), "id", "left").where(
                F.col("known").isNull() | F.col("until").isNull() | (F.col("known") > F.col("until"))
            ),
            "pending",
        )
        if pending.isEmpty():
            return best
        unsettled = broadcast_if_small(cut(pending.select("token").distinct()), PAIRED_CHARS)
        ahead = ahead.join(unsettled, "token", "left_semi")
        order = W.partitionBy("token").orderBy("id")
        leaders = cut(
            ahead.select("token", "id", "size", "place", "step")
            .withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= window)  # also cuts each task's rows before the shuffle
            .where(F.col("_n") <= F.col("step"))
        )
        useful = F.col("p.known").isNull() | (F.col("l.id") < F.col("p.known"))
        best = improved(_candidates(pending, leaders, threshold, useful).distinct(), best)
        groups = cut(
            leaders.groupBy("token")
            .agg(
                F.max("id").alias("until"),
                F.count(F.lit(1)).alias("n"),
                F.first("step").alias("step"),
            )
            .where(F.col("n") == F.col("step"))  # else the group is exhausted
            .select("token", "until", (F.col("step") * 8).alias("step"))
        )
        if groups.isEmpty():
            return best
        ahead = stored(
            ahead.drop("until", "step")
            .join(broadcast_if_small(groups, PAIRED_CHARS), "token")
            .where(F.col("id") > F.col("until")),
            "ahead",
        )
        # Steps grow with each round, so their number is the logarithm of the largest group.
        window *= 8


def _candidates(
    members: DataFrame, leaders: DataFrame, threshold: float, rule: Column | bool = True
) -> DataFrame:
    """``(id, partner)`` of the members and earlier leaders of a group that can reach the threshold."""
    small, large = F.least("l.size", "p.size"), F.greatest("l.size", "p.size")
    # Of the words two sets share, none but the first counts: what is shared then is at most what
    # follows it in either set, and itself.
    shared = F.least(F.col("l.size") - F.col("l.place"), F.col("p.size") - F.col("p.place")) + 1
    enough = shared >= (small + large) * (threshold / (1 + threshold)) - _EPSILON
    near = (small >= large * threshold - _EPSILON) & enough
    return (
        members.alias("p")
        .join(leaders.alias("l"), "token")
        .where((F.col("l.id") < F.col("p.id")) & near & rule)
        .select(F.col("p.id").alias("id"), F.col("l.id").alias("partner"))
    )


def _verified(candidates: DataFrame, sets: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Candidates that reach the threshold; of those of a set, all up to its smallest partner at least.

    Signatures first rule out most others; only for the rest are the words fetched and compared. As
    most of these are right, the first of each set goes first, and the others only where it fails.
    """
    likely = stored(_likely(candidates, signed, threshold), "likely")
    first = likely.groupBy("id").agg(F.min("partner").alias("partner"))
    found = stored(_similar(first, sets, threshold), "found")
    rest = likely.join(found.select("id"), "id", "left_anti").join(first, ["id", "partner"], "left_anti")
    return found.unionByName(_similar(rest, sets, threshold))


def _likely(candidates: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """``(id, partner)`` of the candidates that their signatures do not rule out.

    Sets are dealt to blocks, and pairs to tiles of two blocks. A signature is sent once to each
    tile in which its set has a pair, however many pairs these are.
    """
    pairs = stored(candidates, "pairs")
    size = signed.agg(F.coalesce(F.sum(F.length("signature")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(math.ceil(size / TILE_BYTES), min(MOST_BLOCKS, 1 + math.isqrt(pairs.count() // TILE_PAIRS)))

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks))

    tiled = pairs.withColumn("tile", (block("id") * blocks + block("partner")).cast("int"))
    sides = F.array(F.struct("id", "tile"), F.struct(F.col("partner").alias("id"), "tile"))
    sent = tiled.select(F.inline(sides)).distinct().join(signed, "id")
    dealt = (
        sent.withColumn("partner", F.lit(None).cast(pairs.schema["partner"].dataType))
        .unionByName(tiled, allowMissingColumns=True)
        .repartition(blocks * blocks, "tile")
        .sortWithinPartitions("tile", F.col("partner").isNotNull())
    )
    return dealt.mapInArrow(workers.likely_pairs(threshold, _EPSILON), pairs.schema)


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, partner, similarity)`` of the pairs that reach the threshold, by their words."""
    # Only the words of sets in a pair are moved.
    paired_ids = cut(pairs.select(F.explode(F.array("id", "partner")).alias("id")).distinct())
    worded = sets.select("id", "words").join(broadcast_if_small(paired_ids, PAIRED_CHARS), "id", "left_semi")
    for side, name in (("id", "a"), ("partner", "b")):
        pairs = pairs.join(worded.select(F.col("id").alias(side), F.col("words").alias(name)), side)
    similarity = word_set_similarity(F.col("a"), F.col("b"))
    return (
        pairs.select("id", "partner", F.explode(F.array(similarity)).alias("similarity"))
        .where(F.col("similarity") >= F.lit(threshold))
    )
