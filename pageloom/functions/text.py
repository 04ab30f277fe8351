"""Text, tag, hash and date functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions.arrays import let, top_values
from pageloom.functions.chars import WORD_CHARS, plain_spaces
from pageloom.functions.dates import parse_date as parse_date
from pageloom.functions.words import UNSPACED, words


NO_TEXT = rf'[^{WORD_CHARS} .,!?;:()\-"]'


def clean_text(text: Column) -> Column:
    """White space to single spaces, then drop all but words, spaces and basic punctuation."""
    spaced = F.regexp_replace(plain_spaces(text), "  +", " ")
    kept = F.regexp_replace(spaced, NO_TEXT, "")
    return F.coalesce(F.trim(kept), F.lit(""))


def tokens(text: Column) -> Column:
    """The index analyzer: lower-cased words, no stop words."""
    return words(text)


def word_set(text: Column) -> Column:
    """Sorted distinct white-space tokens of the cleaned, lower-cased text."""
    return F.sort_array(_distinct_words(text))


def _distinct_words(text: Column) -> Column:
    # Splitting drops what ``clean_text`` does to runs of spaces and at the ends.
    kept = F.regexp_replace(plain_spaces(text), NO_TEXT, "")
    words = F.split(F.lower(F.coalesce(kept, F.lit(""))), " ")
    return F.filter(F.array_distinct(words), lambda w: w != "")


def keywords(
    text: Column, n: int = 10, stop_words: Sequence[str] = config.STOP_WORDS
) -> Column:
    """The ``n`` most frequent ASCII words longer than three letters, ties by first occurrence."""
    words = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))),
        F.lit(f"(?<![{WORD_CHARS}])[a-z]{{4,}}(?![{WORD_CHARS}])"),
        F.lit(0),
    )
    return top_values(F.filter(words, lambda w: ~w.isin(list(stop_words))), n)


def word_count(text: Column) -> Column:
    return F.regexp_count(plain_spaces(text), F.lit("[^ ]+"))


def reading_time(words: Column) -> Column:
    """Whole minutes at 200 words a minute, rounded down, at least one."""
    return F.greatest(F.lit(1), F.floor(words / 200).cast("int"))


def estimate_reading_time(text: Column, words_per_minute: int = 200) -> Column:
    """Minutes rounded half to even; none for empty text, else at least one."""
    minutes = F.bround(word_count(text) / words_per_minute).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        F.greatest(F.lit(1), minutes)
    )


def truncate_text(text: Column, max_length: int = 200, suffix: str = "...") -> Column:
    """Cut long text at the last space before the limit and add ``suffix``."""
    head = F.substring(text, 1, max_length)
    until = F.lit(max_length) - F.instr(F.reverse(head), " ")
    cut = F.when(
        (F.instr(head, " ") > 0) & (until > 0), F.substring(head, F.lit(1), until)
    ).otherwise(head)
    return F.when(F.length(text) > max_length, F.concat(cut, F.lit(suffix))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.md5(text)


def normalized_content_hash(text: Column) -> Column:
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.lit("")).otherwise(F.md5(F.lower(clean_text(text))))


def flesch_reading_ease(text: Column) -> Column:
    """Flesch reading ease with rules of our own for what it counts.

    Words are white-space tokens, sentences are runs of ``.!?`` (at least one), syllables are
    runs of Latin vowels (at least one for each word on average).
    """
    counts = F.struct(
        word_count(text).alias("words"),
        F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+"))).alias("sentences"),
        F.regexp_count(F.lower(text), F.lit("[aeiouy]+")).alias("vowels"),
    )

    def score(c: Column) -> Column:
        syllables = F.greatest(c["words"], c["vowels"])
        exact = (
            F.lit(206.835)
            - F.lit(1.015) * (c["words"] / c["sentences"])
            - F.lit(84.6) * (syllables / F.nullif(c["words"], F.lit(0)))
        )
        rounded = let(exact, lambda x: F.signum(x) * (F.floor(F.abs(x) * 100 + 0.5) / F.lit(100.0)))
        return F.when(c["words"] == 0, F.lit(206.84)).otherwise(rounded)

    return let(counts, score)


def is_content_duplicate(first: Column, second: Column, threshold: float = 0.8) -> Column:
    """Jaccard similarity of the word sets reaches ``threshold``; false if either is empty."""
    # Each set is made once; named in the similarity, it would be made again for every mention.
    similarity = let(
        _distinct_words(first),
        lambda a: let(_distinct_words(second), lambda b: word_set_similarity(a, b)),
    )
    return F.coalesce(similarity >= F.lit(threshold), F.lit(False))


def word_set_similarity(first: Column, second: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; null if either is empty."""
    shared = F.size(F.array_intersect(first, second))
    total = F.size(first) + F.size(second) - shared
    both = (F.size(first) > 0) & (F.size(second) > 0)
    return F.when(both, shared / total)


def encode_tags(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def decode_tags(text: Column) -> Column:
    """Tags from their JSON text; anything that is not a JSON array gives no tags."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def rss_date(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def iso_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def query_terms(query: str) -> list[str]:
    """The words of :func:`tokens` for a query given as an argument."""
    return SparkSession.active().range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def hit_pattern(terms: Column) -> Column:
    """Regular expression finding any of an array of analyzed terms as a whole word; a term of a
    script without spaces wherever it stands."""
    inside = F.transform(
        F.array_distinct(terms),
        lambda t: F.when(F.rlike(t, F.lit("^" + UNSPACED)), t).otherwise(
            F.concat(F.lit(f"(?<![{WORD_CHARS}])"), F.regexp_replace(t, "[.]", r"\\."), F.lit(f"(?![{WORD_CHARS}])"))
        ),
    )
    return F.concat(F.lit("(?iu)(?:"), F.array_join(inside, "|"), F.lit(")"))


def highlight(text: Column, pattern: Column, fragment_size: int, fragments: int) -> Column:
    """Up to ``fragments`` pieces of ``text`` where ``pattern`` hits, hits wrapped in ``<em>``.

    Pieces end at white space after at most ``fragment_size`` characters (longer only for a
    longer word); pieces with more hits come first, then earlier ones.
    """
    piece = rf"\S(?:.{{0,{max(fragment_size - 2, 0)}}}\S)?(?!\S)|\S+"
    pieces = F.regexp_extract_all(
        F.regexp_replace(plain_spaces(F.coalesce(text, F.lit(""))), " +", " "),
        F.lit(piece),
        F.lit(0),
    )
    scored = F.transform(
        pieces,
        lambda p, i: F.struct(
            (-F.regexp_count(p, pattern)).alias("k"), i.alias("i"), p.alias("p")
        ),
    )
    best = F.slice(F.sort_array(F.filter(scored, lambda s: s["k"] < 0)), 1, fragments)
    return F.transform(best, lambda s: F.regexp_replace(s["p"], pattern, F.lit("<em>$0</em>")))
