"""Words, cleaning and keywords of whole columns, by Arrow batches where the text is plain.

Plain are texts of Latin-1 characters and a few marks of print, in which letters, digits and spaces are
known without looking up properties. For them a short pattern in a Python worker finds what the Column
functions of ``text`` and ``words`` find; all other texts take these functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions import text as tx
from pageloom.functions import workers
from pageloom.functions.arrays import let, value_counts

COUNTS = "array<struct<value: string, n: int>>"


def word_counts(text: Column) -> Column:
    """struct<dl, counts>: the number of words of :func:`text.tokens`, and how often each occurs, by word."""
    made = F.arrow_udf(workers.word_counts, f"struct<dl: int, counts: {COUNTS}>")(text)

    def counted(ws: Column) -> Column:
        return F.struct(F.size(ws).alias("dl"), value_counts(ws).alias("counts"))

    return F.coalesce(made, let(tx.tokens(text), counted))


def other_counts(text: Column) -> Column:
    """:func:`word_counts` of a text that is not plain; null for one that is, whose words are left to a worker."""

    def counted(ws: Column) -> Column:
        return F.struct(F.size(ws).alias("dl"), value_counts(ws).alias("counts"))

    # A pattern for the same takes a hundred times as long in the JVM.
    return F.when(~F.arrow_udf(workers.is_plain, "boolean")(text), let(tx.tokens(text), counted))


def word_number(text: Column) -> Column:
    """The size of :func:`text.tokens`."""
    return F.coalesce(F.arrow_udf(workers.word_number, "int")(text), F.size(tx.tokens(text)))


def term_counts(text: Column, terms: Sequence[str]) -> Column:
    """array<int>: the number of words, then that of each of ``terms`` among them."""

    def counted(ws: Column) -> Column:
        return F.array(F.size(ws), *[F.size(F.filter(ws, lambda w: w == t)) for t in terms])

    made = F.arrow_udf(workers.term_counts(list(terms)), "array<int>")(text)
    return F.coalesce(made, let(tx.tokens(text), counted))


def reading_counts(text: Column, letters: str) -> Column:
    """struct<words, sentences, runs>: the numbers of words and of runs of ``.!?``, and the lower-cased runs of
    letters, which ``letters`` finds in any text, with their counts."""
    made = F.arrow_udf(workers.reading_counts, f"struct<words: int, sentences: int, runs: {COUNTS}>")(text)
    runs = F.regexp_extract_all(F.lower(text), F.lit(letters), F.lit(0))
    counted = F.struct(
        tx.word_count(text).alias("words"),
        F.regexp_count(text, F.lit("[.!?]+")).alias("sentences"),
        value_counts(runs).alias("runs"),
    )
    return F.coalesce(made, counted)


def clean_text(text: Column) -> Column:
    """:func:`text.clean_text`."""
    return F.coalesce(F.arrow_udf(workers.clean_text, "string")(text), tx.clean_text(text))


def keywords(text: Column, n: int = 10, stop_words: Sequence[str] = config.STOP_WORDS) -> Column:
    """:func:`text.keywords`."""
    made = F.arrow_udf(workers.keywords(n, list(stop_words)), "array<string>")(text)
    return F.coalesce(made, tx.keywords(text, n, stop_words))
