"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0). How far each rule is to be
trusted is estimated from the votes alone by expectation-maximisation, and a document is kept if
the posterior probability of good quality, given its votes, is at least ``keep_at``.

The votes of a document depend on a handful of counts, and the model on the number of documents
with each combination of votes: at most ``2 ** len(RULES)`` rows, whatever the size of the table.
Those counts cover all documents. Everything else is built-in column functions within the row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import SPACE, apart, stored, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
FACE = 0.3

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lettered", "n_ended",
)


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more, first finding included.

    Windows are compared by 64-bit hash. Where all differ nothing is sorted; else sorting
    brings equal windows together, so a text of one repeated line costs no more than any other.
    """
    last = F.size(tokens) - WINDOW

    def hashed(all_words: Column) -> Column:
        each = F.transform(all_words, lambda w: F.xxhash64(w))
        return F.transform(
            F.array(each),
            lambda h: F.transform(
                F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])
            ),
        )[0]

    def covered(starts: Column) -> Column:
        reach = F.transform(
            starts,
            lambda p, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), p + F.lit(WINDOW)) - p
            ),
        )
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def equal_to_neighbour(placed: Column) -> Column:
        return F.filter(
            placed,
            lambda x, i: x["h"].eqNullSafe(F.get(placed, i - 1)["h"])
            | x["h"].eqNullSafe(F.get(placed, i + 1)["h"]),
        )

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = F.transform(
            F.array(placed),
            lambda p: F.sort_array(F.transform(equal_to_neighbour(p), lambda x: x["i"])),
        )
        counts = F.transform(starts, covered)[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counts)

    return F.when(last < 1, F.lit(0)).otherwise(
        F.transform(F.array(hashed(tokens)), counted)[0]
    ).cast("long")


def with_counts(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """``docs`` and a struct column ``<prefix>counts`` of the figures the rules look at."""
    value = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(value, f"{SPACE}+", "")
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    w, ls, c = f"{prefix}tokens", f"{prefix}lines", f"{prefix}bare"
    counted = docs.withColumns({w: words(F.col(text)), ls: lines, c: bare})
    figures = {
        "n_words": F.size(w),
        "word_chars": F.length(c),
        "n_symbols": F.length(c) - F.length(F.regexp_replace(c, SYMBOLS, "")),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": repeated_words(F.col(w)),
        "n_lines": F.size(ls),
        "n_upper": F.length(c) - F.length(F.regexp_replace(c, "[A-Z]", "")),
        "n_lettered": F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))),
        "n_ended": F.size(F.filter(ls, lambda x: x.rlike("[.!?:;\"'»”’…。]\\s*$"))),
    }
    struct = F.struct(*[figures[n].cast("long").alias(n) for n in COUNTS])
    # A generator, since a filter on the figures is not moved below it and so repeats no work.
    return counted.withColumn(f"{prefix}counts", F.explode(F.array(struct))).drop(w, ls, c)


def rules(n: Mapping[str, Column]) -> dict[str, Column]:
    """The votes, from the figures of a document.

    A fault shows in one or two figures while the others stay ordinary, so a rule that sees no
    fault abstains. Only a text that is well formed in every respect gets a vote of good.
    """
    size, lines, chars = n["n_words"], n["n_lines"], n["word_chars"]
    faults = {
        "length": size < MIN_WORDS,
        "symbols": 10 * n["n_symbols"] > size,
        "line_copies": (lines >= 5) & (10 * n["n_dup_lines"] > 3 * lines),
        "repeats": 10 * n["n_repeat_words"] > 2 * size,
        "word_length": (chars < 3 * size) | (chars > 12 * size),
        "capitals": 10 * n["n_upper"] > 3 * chars,
        "lettered": (size >= 2 * MIN_WORDS) & (10 * n["n_lettered"] < 7 * size),
        "line_ends": (lines >= 3) & (10 * n["n_ended"] < 3 * lines),
    }
    well_formed = (
        (size >= 2 * MIN_WORDS)
        & (100 * n["n_symbols"] <= size)
        & (10 * n["n_dup_lines"] <= lines)
        & (10 * n["n_repeat_words"] <= size)
        & (2 * chars >= 7 * size)
        & (chars <= 9 * size)
        & (10 * n["n_upper"] < chars)
        & (10 * n["n_lettered"] >= 9 * size)
        & (10 * n["n_ended"] >= 8 * lines)
    )
    votes = {name: F.when(fault, F.lit(-1)).otherwise(F.lit(0)) for name, fault in faults.items()}
    return votes | {"well_formed": F.when(well_formed, F.lit(1)).otherwise(F.lit(0))}


RULES = (
    "length", "symbols", "line_copies", "repeats", "word_length", "capitals", "lettered", "line_ends",
    "well_formed",
)


@dataclass(frozen=True)
class Model:
    """Log odds of good quality: of any document, and what a vote of each rule adds."""

    prior: float = math.log(9.0)
    vote: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(RULES, 0.0))

    def log_odds(self, votes: Mapping[str, Column]) -> Column:
        return sum(
            (F.when(v != 0, F.lit(self.vote[name])).otherwise(F.lit(0.0)) for name, v in votes.items()),
            F.lit(self.prior),
        )


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Model:
    """Expectation-maximisation over vote combinations and the number of documents with each.

    The unknowns are the share of good documents and how often each rule votes on documents of
    either class, which gives its accuracy. Given the class, votes are independent; abstaining
    says nothing. The start is what the votes say at face value: good with 0.9, bad with 0.1, even
    where they differ or nobody votes. Every estimate mixes that in with the weight ``FACE``, so
    that the classes keep their meaning at any size of the table. At least half of the documents
    are taken as good, a rule may be found useless but never the reverse of what it says, and no
    vote counts for more than odds of 1000 to 1; so a document no rule finds fault with is kept.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return Model()
    face = [
        0.5 if min(v) < 0 < max(v) else 0.1 if min(v) < 0 else 0.9 if max(v) > 0 else 0.5
        for v, _ in patterns
    ]
    post, most, model = face, math.log(1000.0), Model()
    for _ in range(rounds):
        mixed = [FACE * f + (1 - FACE) * p for f, p in zip(face, post)]
        good = sum(n * p for p, (_, n) in zip(mixed, patterns))
        share = min(max(good / total, 0.5), 0.98)
        weights = {}
        for r, name in enumerate(RULES):
            on_good = sum(n * p for p, (v, n) in zip(mixed, patterns) if v[r])
            on_bad = sum(n * (1 - p) for p, (v, n) in zip(mixed, patterns) if v[r])
            # With one vote more, dealt by the shares, so that a silent rule has no weight.
            ratio = math.log((on_good + share) / share) - math.log((on_bad + 1 - share) / (1 - share))
            says = 1 if name == "well_formed" else -1
            weights[name] = says * min(max(says * ratio, 0.0), most)
        model = Model(math.log(share / (1 - share)), weights)
        odds = [model.prior + sum(w for w, x in zip(weights.values(), v) if x) for v, _ in patterns]
        post = [1 / (1 + math.exp(-z)) for z in odds]
    return model


def _votes(prefix: str) -> dict[str, Column]:
    return rules({n: F.col(f"{prefix}counts")[n] for n in COUNTS})


def estimate(counted: DataFrame, prefix: str) -> Model:
    """The model for the votes of all rows of ``counted``, the output of ``with_counts``."""
    votes = counted.select(*[v.alias(name) for name, v in _votes(prefix).items()])
    found = votes.groupBy(*RULES).count().collect()  # at most 2 ** len(RULES) rows
    return fit(sorted((tuple(r[name] for name in RULES), r["count"]) for r in found))


def _judged(counted: DataFrame, prefix: str, model: Model, keep_at: float) -> dict[str, Column]:
    n = {name: F.col(f"{prefix}counts")[name] for name in COUNTS}
    failed = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
    odds = model.log_odds(rules(n))
    return {
        "base_failed": failed,
        "quality": 1 / (1 + F.exp(-odds)),
        "kept": ~failed & (odds >= math.log(keep_at / (1 - keep_at))),
    }


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep_at: float = 0.5
) -> DataFrame:
    """One row for each row of ``docs``: ``key``, the figures, ``base_failed``, the posterior
    probability ``quality``, and ``kept``.

    A null text is an empty one, has no words and fails. Repeated rows and null keys are judged
    like any others; an empty table gives an empty result. Other columns are left out. The
    narrow table of figures is written once and serves both the estimate and the verdicts.
    """
    p = "_w"
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = stored(
        with_counts(narrow, "text", p).select("key", f"{p}counts"), "quality"
    )
    judged = _judged(counted, p, estimate(counted, p), keep_at)
    return counted.select(
        F.col("key").alias(key),
        *[F.col(f"{p}counts")[n].alias(n) for n in COUNTS],
        *[c.alias(n) for n, c in judged.items()],
    )


def keep_good(docs: DataFrame, text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` would keep, with their own columns only.

    The figures are computed twice, for the estimate and for the filter, as rows with whole texts
    are dearer to write than to count again.
    """
    p = apart(docs, ())
    only_text = docs.select(F.col(text).alias("text"))
    model = estimate(with_counts(only_text, "text", p), p)
    counted = with_counts(docs, text, p)
    return counted.filter(_judged(counted, p, model, keep_at)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
