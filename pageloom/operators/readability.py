"""Readability by real syllables: Liang's hyphenation patterns, given as a table.

A pattern is a piece of a word with numbers between its letters, such as ``hy3ph`` or ``.un1``; a dot is
the start or the end of a word. All patterns that occur in a word put their numbers between its letters,
the largest at each place counts, and odd numbers are places to break. Each distinct word is broken once,
by an equi-join of its pieces with the patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import plain
from pageloom.session import broadcast_if_small, cut, stored

LETTERS = r"[\p{L}\p{M}]+"
LEFT, RIGHT = 2, 2  # letters before the first break and after the last


def levels(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``(piece, size, marks)``: the letters of each pattern, and its numbers as an array of structs
    ``(at, level)``, ``at`` letters after the start of the piece. Of patterns with the same letters the
    larger numbers count."""
    text = F.lower(F.trim(pattern))
    digits = F.concat(
        F.regexp_extract_all(text, F.lit(r"(\d?)(\D)"), F.lit(1)), F.array(F.regexp_extract(text, r"(\d?)$", 1))
    )
    marks = F.filter(
        F.transform(digits, lambda d, i: F.struct(i.alias("at"), F.try_to_number(F.nullif(d, F.lit("")), F.lit("9")).cast("int").alias("level"))),
        lambda m: m["level"] > 0,
    )
    each = patterns.select(F.regexp_replace(text, r"\d", "").alias("piece"), F.explode(marks).alias("m"))
    largest = each.groupBy("piece", F.col("m.at").alias("at")).agg(F.max("m.level").alias("level"))
    return (
        largest.where(F.length("piece") > 0)
        .groupBy("piece")
        .agg(F.collect_list(F.struct("at", "level")).alias("marks"))
        .withColumn("size", F.length("piece"))
    )


def breaks(words: DataFrame, patterns: DataFrame, word: str = "word") -> DataFrame:
    """``(word, breaks)`` for each distinct lower-cased word: the numbers of letters before which it may
    be broken, in order. Words without a pattern, and nulls, have no breaks."""
    table = cut(levels(patterns))
    longest = table.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    distinct = words.select(F.lower(word).alias("word")).where(F.col("word").isNotNull()).distinct()

    # Generators of numbers are compiled, which functions of arrays are not.
    dotted, at = F.concat(F.lit("."), "word", F.lit(".")), F.col("start")
    places = F.explode(F.sequence(F.lit(0), F.length("word") + 1)).alias("start")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") + 2 - at))).alias("size")
    n = F.length("word")
    found = (
        distinct.select("word", places)
        .select("word", "start", sizes)
        .select("word", "start", F.substring(dotted, at + 1, F.col("size")).alias("piece"))
        .join(broadcast_if_small(table.select("piece", "marks")), "piece")
        .select("word", "start", F.explode("marks").alias("m"))
        # Before the first letter stands the dot.
        .select("word", (F.col("start") + F.col("m.at") - 1).alias("at"), F.col("m.level").alias("level"))
        .where((F.col("at") >= LEFT) & (n - F.col("at") >= RIGHT))
        .groupBy("word", "at")
        .agg(F.max("level").alias("level"))
        .where(F.col("level") % 2 == 1)
        .groupBy("word")
        .agg(F.sort_array(F.collect_list("at")).alias("breaks"))
    )
    none = F.array().cast("array<int>")
    return distinct.join(found, "word", "left").select("word", F.coalesce("breaks", none).alias("breaks"))


def flesch_reading_ease(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` for each row: Flesch reading ease with syllables by patterns.

    Words and sentences count as in ``functions.text``. The syllables of a run of letters are its breaks
    and one. A text without words scores as there; repeated rows and null keys come out as they went in.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = plain.reading_counts(value, LETTERS).alias("c")
    counted = stored(
        docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), found).select(
            "_row",
            "key",
            F.col("c.words").alias("words"),
            F.greatest(F.lit(1), "c.sentences").alias("sentences"),
            F.col("c.runs").alias("counts"),
        ),
        "counts",
    )
    each = counted.select("_row", F.explode("counts").alias("c")).select("_row", F.col("c.value").alias("word"), F.col("c.n").alias("n"))
    known = stored(
        breaks(each.select("word"), patterns).select("word", (F.size("breaks") + 1).alias("syllables")), "syllables"
    )
    sums = (
        each.join(broadcast_if_small(known), "word")
        .groupBy("_row")
        .agg(F.sum(F.col("n") * F.col("syllables")).alias("syllables"))
    )
    exact = (
        F.lit(206.835)
        - F.lit(1.015) * (F.col("words") / F.col("sentences"))
        - F.lit(84.6) * (F.coalesce("syllables", F.lit(0)) / F.nullif("words", F.lit(0)))
    )
    score = F.when(F.col("words") == 0, F.lit(206.84)).otherwise(F.signum(exact) * (F.floor(F.abs(exact) * 100 + 0.5) / F.lit(100.0)))
    return counted.drop("counts").join(sums, "_row", "left").select(F.col("key").alias(key), score.alias("score"))
