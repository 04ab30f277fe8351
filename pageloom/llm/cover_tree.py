"""Exact near duplicates of vectors by dual traversal of cover trees.

Unit vectors have a cosine of ``least`` or more exactly if they lie within a certain distance, so
the search is one in a metric space. Pivots from a bounded sample cut it into cells, and cells of
more than ``TILE`` vectors are dealt into tiles. Each tile gets a cover tree: nested sets of
centres, one for each of a row of halving radii, in which every vector is covered by a centre.
Pairs of cells, and then pairs of nodes of two trees, are dropped where their centres are further
apart than their covering radii and the distance sought allow. What is left at the leaves is
compared exactly, so the sample decides how much is dropped and never what is found.

Equal vectors are one node with a weight. A pair of tiles gives the number of links of each
node and a forest that ties linked nodes together, never all pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value, stored
from pageloom.llm.components import components
from pageloom.llm.forest import Forest

by_value(__name__)

LEAST = 0.95
TILE = 4096
SAMPLE, PIVOTS = 2_000, 512
LEVELS = 7
SLACK = 1e-6  # distances of nearly equal vectors are known to half the digits of their cosine
_ROWS = 1024
_FEW = 1 << 20  # pairs of rows

_TREE_SCHEMA = (
    "cell int, chunk int, node long, weight long, vector array<double>, above array<int>, place int"
)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lists(m: np.ndarray) -> pa.Array:
    whole = pa.array(np.ascontiguousarray(m).ravel())
    return pa.FixedSizeListArray.from_arrays(whole, m.shape[1]).cast(pa.list_(whole.type))


# Trees


def _cosine(distance: float) -> float:
    return 1.0 - distance * distance / 2.0


class Tree:
    """A cover tree of a tile. The centres of level k lie over ``2 ** (1 - k)`` apart and cover those
    of the next level within that distance, so all rows below them within twice as much;
    ``above[k]`` is the centre over each row. Centres of one level are centres of the next. At level
    ``LEVELS`` every row stands for itself."""

    def __init__(self, x: np.ndarray, above: np.ndarray) -> None:
        self.x = x
        self.above = np.vstack([above, np.arange(len(x))])
        self.radius, self.below = [], []
        for level in self.above:
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, x[level])))
            d[level == np.arange(len(x))] = 0.0
            radius = np.zeros(len(x))
            np.maximum.at(radius, level, d)
            self.radius.append(radius)
            self.below.append(np.bincount(level, minlength=len(x)))

    def rows(self, centres: np.ndarray, level: int) -> np.ndarray:
        """All rows below some centres."""
        asked = np.zeros(len(self.x), bool)
        asked[centres] = True
        return np.flatnonzero(asked[self.above[level]])

    def centres(self, level: int) -> np.ndarray:
        return np.unique(self.above[level])

    def alone(self, centres: np.ndarray, level: int) -> np.ndarray:
        return self.below[level][centres] == 1


def build(x: np.ndarray) -> np.ndarray:
    """``above`` for the levels before ``LEVELS``."""
    n = len(x)
    centre = np.zeros(n, bool)
    centre[0] = True
    nearest, best = np.zeros(n, np.int64), x @ x[0]
    nearest[0], best[0] = 0, 1.0
    levels = [nearest.copy()]
    for level in range(1, LEVELS):
        covered = _cosine(2.0 ** (1 - level))
        while len(block := np.flatnonzero(~centre & (best < covered))[:256]):
            far = x[block] @ x[block].T < covered
            free, picked = np.ones(len(block), bool), []
            for i in range(len(block)):
                if free[i]:
                    picked.append(i)
                    free &= far[i]
            chosen = block[picked]
            centre[chosen], nearest[chosen], best[chosen] = True, chosen, 1.0
            rest = np.flatnonzero(~centre)
            for at in range(0, len(rest), _ROWS):
                rows = rest[at : at + _ROWS]
                cosine = x[rows] @ x[chosen].T
                place = cosine.argmax(axis=1)
                cosine = cosine[np.arange(len(rows)), place]
                closer = cosine > best[rows]
                best[rows[closer]], nearest[rows[closer]] = cosine[closer], chosen[place[closer]]
        levels.append(nearest.copy())
    for level in range(LEVELS - 2, -1, -1):  # one parent for all that a centre covers
        levels[level] = levels[level][levels[level + 1]]
    return np.array(levels)


def dual(a: Tree, b: Tree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks ``(rows of a, rows of b, linked)`` that together hold every linked pair once.

    Centres without other rows below are compared right away. Each of the others meets all centres
    of the other tree that do not lie too far apart: with few rows below them these are compared
    at once, else their centres of the level below.
    """
    reach = math.sqrt(2.0 - 2.0 * least) + SLACK
    waiting = [(a.centres(0), b.centres(0), 0)]

    def compared(left: np.ndarray, right: np.ndarray):
        for at in range(0, len(left), _ROWS):
            rows = left[at : at + _ROWS]
            linked = a.x[rows] @ b.x[right].T >= least
            if linked.any():
                yield rows, right, linked

    def meeting(one: Tree, two: Tree, tops: np.ndarray, others: np.ndarray, level: int):
        """The rows below each of ``tops``, and those below the ``others`` that it has to meet."""
        for at in range(0, len(tops), _ROWS):
            part = tops[at : at + _ROWS]
            bound = one.radius[level][part, None] + two.radius[level][None, others] + reach
            near = _distance(one.x[part], two.x[others]) <= bound
            for top, met in zip(part, near):
                if met.any():
                    yield one.rows(top[None], level), two.rows(others[met], level)

    while waiting:
        left, right, level = waiting.pop()
        alone_a, alone_b = a.alone(left, level), b.alone(right, level)
        yield from compared(left[alone_a], right[alone_b])
        more_a, more_b = left[~alone_a], right[~alone_b]
        blocks = chain(
            meeting(a, b, more_a, right, level),
            (pair[::-1] for pair in meeting(b, a, more_b, left[alone_a], level)),
        )
        for rows_a, rows_b in blocks:
            if len(rows_a) * len(rows_b) <= _FEW or level + 1 >= LEVELS:
                yield from compared(rows_a, rows_b)
            else:
                below = np.unique(a.above[level + 1][rows_a]), np.unique(b.above[level + 1][rows_b])
                waiting.append((*below, level + 1))


# Spark



def _usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, not all zero."""
    bad = F.exists(
        vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")).cast("double"))
    )
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each next pivot is the row of the sample furthest from those before."""
    chosen = [0]
    gap = _distance(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)):
        row = int(gap.argmax())
        if gap[row] <= SLACK:
            break
        chosen.append(row)
        gap = np.minimum(gap, _distance(x, x[row : row + 1])[:, 0])
    return x[chosen]


def _assigner(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _normal(_matrix(batch.column(0)).astype(np.float64))
            d = _distance(x, centres)
            cell = d.argmin(axis=1)
            columns = [
                *batch.columns,
                pa.array(cell.astype(np.int32)),
                pa.array(d[np.arange(len(d)), cell]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "gap"])

    return run


def _builder():
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending")])
        x = _normal(_matrix(table.column("vector")).astype(np.float64))
        above, n = build(x), len(x)
        cell, chunk = table.column("cell")[0].as_py(), table.column("chunk")[0].as_py()
        return pa.table(
            {
                "cell": pa.array(np.full(n, cell, np.int32)),
                "chunk": pa.array(np.full(n, chunk, np.int32)),
                "node": table.column("order"),
                "weight": table.column("weight"),
                "vector": _lists(x),
                "above": _lists(above.T.astype(np.int32)),
                "place": pa.array(np.arange(n, dtype=np.int32)),
            }
        )

    return run


def _side(table: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray]:
    table = table.sort_by([("place", "ascending")])
    column = lambda c: table.column(c).to_numpy()
    above = _matrix(table.column("above")).T.astype(np.int64)
    tree = Tree(_matrix(table.column("vector")), above)
    return tree, column("node"), column("weight")


def _pair(least: float):
    def run(table: pa.Table) -> pa.Table:
        sides = [table.filter(pa.compute.equal(table.column("side"), k)) for k in (0, 1)]
        one = _side(sides[0])
        same = not sides[1].num_rows
        two = one if same else _side(sides[1])
        (a, nodes_a, weight_a), (b, nodes_b, weight_b) = one, two
        count_a, count_b = np.zeros(len(nodes_a), np.int64), np.zeros(len(nodes_b), np.int64)
        forest = Forest()
        rows_a = forest.more(len(nodes_a))
        rows_b = rows_a if same else forest.more(len(nodes_b))
        edges: list[tuple[int, int]] = []
        for left, right, linked in dual(a, b, least):
            if same:
                linked = linked & (left[:, None] != right[None, :])
            np.add.at(count_a, left, linked @ weight_b[right])
            if not same:
                np.add.at(count_b, right, weight_a[left] @ linked)
            edges += [
                (int(nodes_a[left[i]]), int(nodes_b[right[j]]))
                for i, j in forest.tie(rows_a[left], rows_b[right], linked)
            ]
        counts = [(nodes_a, count_a)] + ([] if same else [(nodes_b, count_b)])
        found = [(n[c > 0], c[c > 0]) for n, c in counts]
        nodes, links = (np.concatenate(x) for x in zip(*found))
        none, k = [None], len(nodes)
        return pa.table(
            {
                "a": pa.array([*nodes.tolist(), *[e[0] for e in edges]], pa.int64()),
                "b": pa.array([*none * k, *[e[1] for e in edges]], pa.int64()),
                "links": pa.array([*links.tolist(), *none * len(edges)], pa.int64()),
            }
        )

    return run


def _tiles(nodes: DataFrame, size: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """The tiles with their trees, and the pairs of tiles that may hold linked vectors."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("vector"), "order").limit(SAMPLE).select("vector").collect()
    x = _normal(np.array([r["vector"] for r in sample], np.float64))
    centres = pivots(x, min(PIVOTS, max(1, -(-n // size))))
    columns = ["vector", "weight", "order"]
    schema = "vector array<double>, weight long, order long, cell int, gap double"
    placed = stored(nodes.select(*columns).mapInArrow(_assigner(centres), schema), "cells")
    cells = {
        r["cell"]: (-(-r["n"] // size), r["far"])
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect()
    }  # one row for each pivot at most
    gaps = _distance(centres, centres)
    pairs = [
        (i, j, cells[i][0], cells[j][0])
        for i in cells
        for j in cells
        if i <= j and gaps[i, j] <= cells[i][1] + cells[j][1] + reach + SLACK
    ]
    sizes = spark.createDataFrame([(k, v[0]) for k, v in cells.items()], "cell int, chunks long")
    chunked = placed.join(F.broadcast(sizes), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("order"), "chunks").cast("int")
    )
    trees = stored(
        chunked.select("cell", "chunk", *columns).groupBy("cell", "chunk").applyInArrow(_builder(), _TREE_SCHEMA),
        "trees",
    )

    def chunks(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int")))

    both = (
        spark.createDataFrame(pairs, "i int, j int, in_i long, in_j long")
        .select("i", "j", chunks("in_i").alias("p"), "in_j")
        .select("i", "j", "p", chunks("in_j").alias("q"))
        .filter((F.col("i") < F.col("j")) | (F.col("p") <= F.col("q")))
    )
    return trees, both


def _route(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each tile's rows once for each pair it is in; the pair of a tile with itself has one side."""
    first = F.struct(F.col("i").alias("cell"), F.col("p").alias("chunk"), F.lit(0).alias("side"))
    second = F.struct(F.col("j").alias("cell"), F.col("q").alias("chunk"), F.lit(1).alias("side"))
    alone = (F.col("i") == F.col("j")) & (F.col("p") == F.col("q"))
    ways = pairs.select(
        "i", "j", "p", "q", F.inline(F.when(alone, F.array(first)).otherwise(F.array(first, second)))
    )
    return trees.join(ways, ["cell", "chunk"])


def duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    least: float = LEAST,
    tile: int = TILE,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row of ``vectors``.

    Two rows are linked if the cosine of their vectors is ``least`` (above 0) or more, in double
    precision. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    key that links lead to, the row's own included, and the row with that key is ``kept``. A
    vector that is null, empty or zero, or has a null, NaN or infinite component, links with
    nothing, and no vector with one of another length; the lengths in use should be few, as each is
    compared by itself. Repeated rows are rows of their own. Null keys
    are never the smallest; where all keys of a component are null, so is its id, and all are kept.
    """
    value = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), value.alias("vector")).withColumn(
        "vector", F.when(_usable(F.col("vector")), F.transform("vector", lambda v: v + F.lit(0.0)))
    )
    rows = stored(rows, "vectors")
    distinct = (
        rows.filter(F.col("vector").isNotNull())
        .groupBy("vector")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
    )
    nodes = stored(distinct.withColumn("order", F.monotonically_increasing_id()), "nodes")
    if not nodes.take(1):
        alone = [F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")]
        return rows.select(F.col("key").alias(key), *alone, F.lit(True).alias("kept"))

    def compared(length: int) -> DataFrame:
        own = nodes.filter(F.size("vector") == length)
        trees, pairs = _tiles(own, tile, math.sqrt(2.0 - 2.0 * least))
        grouped = _route(trees, pairs).groupBy("i", "p", "j", "q")
        return grouped.applyInArrow(_pair(least), "a long, b long, links long")

    lengths = sorted(r["n"] for r in nodes.select(F.size("vector").alias("n")).distinct().collect())
    found = stored(reduce(DataFrame.unionByName, map(compared, lengths)), "links")
    links = found.filter("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    group = components(found.filter("b is not null").select("a", "b"))
    facts = (
        nodes.join(links, nodes["order"] == links["a"], "left")
        .join(group, F.col("order") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "order"))
    )
    ids = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(ids, "component").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "component_id",
    )
    linked = F.col("n_links").isNotNull()
    own = F.when(linked, F.col("component_id")).otherwise(F.col("key"))
    return (
        rows.join(facts, "vector", "left")
        .withColumn("component_id", own)
        .select(
            F.col("key").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "component_id",
            F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
