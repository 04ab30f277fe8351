"""Array helpers evaluated inside each row, so that counting words of a text needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_counts(values: Column) -> Column:
    """array<struct<value, n>>: distinct values with their counts, by value.

    Sorting makes equal values adjacent; a count is the distance between group starts. The cost
    is that of the sort, however long the array.
    """

    def sized(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: F.struct(
                F.get(ordered, at).alias("value"),
                (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at).alias("n"),
            ),
        )

    def counted(ordered: Column) -> Column:
        starts = F.transform(
            ordered, lambda v, i: F.when((i == 0) | (F.get(ordered, i - 1) != v), i)
        )
        return let(F.array_compact(starts), lambda found: sized(ordered, found))

    return let(F.sort_array(values), counted)


def top_values(values: Column, n: int) -> Column:
    """The ``n`` most frequent values, ties by first position."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("pos")))

    def ranked(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: F.struct(
                (at - F.coalesce(F.get(starts, i + 1), F.size(ordered))).alias("k"),
                F.get(ordered, at)["pos"].alias("pos"),
                F.get(ordered, at)["v"].alias("v"),
            ),
        )

    def counted(ordered: Column) -> Column:
        starts = F.transform(
            ordered,
            lambda p, i: F.when((i == 0) | (F.get(ordered, i - 1)["v"] != p["v"]), i),
        )
        return let(F.array_compact(starts), lambda found: ranked(ordered, found))

    best = F.slice(F.sort_array(let(F.sort_array(pairs), counted)), 1, n)
    return F.transform(best, lambda r: r["v"])
