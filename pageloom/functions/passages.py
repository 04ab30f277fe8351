"""Passages of a text for a search: its sentences, ranked by BM25 among themselves.

A sentence ends at a full stop, question or exclamation mark before white space, with the quotes and
brackets that close behind it, or at the marks of scripts without spaces; a number such as 3.5 ends none.
Passages that hold more of the terms come first, then those with the higher score, in which a term counts
more the fewer passages of the text have it, then earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions.arrays import let
from pageloom.functions.chars import plain_spaces, strip
from pageloom.functions.words import words

SENTENCE = r"""\S.*?(?:[.!?…]+["'”’»)\]]*(?:\s|$)|[。！？]|$)"""
K1, B = 1.2, 0.75
DECIMALS = 6


def sentences(text: Column, size: int | None = None) -> Column:
    """The sentences of ``text`` with single spaces; those of more than ``size`` characters are cut at
    white space."""
    spaced = F.regexp_replace(plain_spaces(F.coalesce(text, F.lit(""))), " +", " ")
    found = F.transform(F.regexp_extract_all(spaced, F.lit(SENTENCE), F.lit(0)), strip)
    if size is None:
        return found
    piece = rf"\S(?:.{{0,{max(size - 2, 0)}}}\S)?(?!\S)|\S+"
    return F.flatten(F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(piece), F.lit(0))))


def passages(text: Column, terms: Sequence[str], most: int = 3, size: int | None = None) -> Column:
    """Up to ``most`` passages that hold any of the analyzed ``terms``, the best first: structs of
    ``coverage``, the number of different terms in it, ``score``, ``position`` among the passages,
    ``passage`` and ``marked``, the same with hits wrapped in ``<em>``."""
    asked = sorted(set(terms))
    kind = "array<struct<coverage: int, score: double, position: int, passage: string, marked: string>>"
    if not asked:
        return F.array().cast(kind)
    pattern = tx.hit_pattern(F.array(*[F.lit(t) for t in asked]))

    def occurrences(ws: Column, term: str) -> Column:
        return F.size(F.filter(ws, lambda w: w == term))

    def having(found: Column, i: int) -> Column:
        return F.size(F.filter(found, lambda p: F.get(p["tf"], F.lit(i)) > 0))

    def counted(p: Column) -> Column:
        return let(
            words(p),
            lambda ws: F.struct(
                F.size(ws).alias("dl"),
                F.array(*[occurrences(ws, t) for t in asked]).alias("tf"),
                p.alias("passage"),
            ),
        )

    def ranked(found: Column) -> Column:
        n = F.size(found)
        total = F.aggregate(found, F.lit(0), lambda s, p: s + p["dl"])
        average = total / F.nullif(n, F.lit(0))
        df = F.array(*[having(found, i) for i in range(len(asked))])
        return let(F.struct(n.alias("n"), average.alias("average"), df.alias("df")), lambda s: scored(found, s))

    def scored(found: Column, s: Column) -> Column:
        def one(p: Column, position: Column) -> Column:
            tf = [F.get(p["tf"], F.lit(i)) for i in range(len(asked))]
            df = [F.get(s["df"], F.lit(i)) for i in range(len(asked))]
            norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * p["dl"] / F.nullif(s["average"], F.lit(0.0)))
            parts = [
                F.when(x > 0, F.log1p((s["n"] - d + 0.5) / (d + 0.5)) * x * F.lit(K1 + 1) / (x + norm)).otherwise(0.0)
                for x, d in zip(tf, df)
            ]
            coverage = reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in tf])
            score = F.round(reduce(lambda a, b: a + b, parts), DECIMALS)
            return F.struct(
                (-coverage).alias("less"), (-score).alias("lower"), position.alias("position"), p["passage"].alias("passage")
            )

        hits = F.filter(F.transform(found, one), lambda x: x["less"] < 0)
        return F.transform(
            F.slice(F.array_sort(hits), 1, most),
            lambda x: F.struct(
                (-x["less"]).alias("coverage"),
                (-x["lower"]).alias("score"),
                x["position"],
                x["passage"],
                F.regexp_replace(x["passage"], pattern, F.lit("<em>$0</em>")).alias("marked"),
            ),
        )

    return let(F.transform(sentences(text, size), counted), ranked).cast(kind)
