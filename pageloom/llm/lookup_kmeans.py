"""K-means over integer vectors, with distances from lookup tables.

Vectors are turned into integers once and written in blocks: for each dimension the values that occur
in the block, and for each vector their numbers. A round tabulates, for each dimension and occurring
value, the squared difference to every centroid. The distances of a block are then sums of rows
gathered from that table, and no difference is taken twice. All arithmetic is on integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value, stored

by_value(__name__)

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 8, 10, 3, 1024, 64
BLOCK = 4096  # vectors; codes of two bytes allow 65,536
LARGEST = 2**63 - 1

# Components up to WIDE have squared distances that a machine integer holds; beyond HUGE they are moved
# to that bound.
_WIDE, _HUGE = 2**27, 2**62

_BLOCKS = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.BinaryType()),
    ]
)
_PARTS = T.StructType(
    [
        T.StructField("cluster", T.IntegerType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("total", T.DecimalType(38, 0)),
    ]
)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as long integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    return np.clip(scaled, -float(_HUGE), float(_HUGE)).astype(np.int64)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as ``(values, sizes, codes)``: the sorted values of each dimension one after another,
    how many each has, and for each dimension the places of the vectors' values among its own."""
    values, codes = [], np.empty(v.shape[::-1], np.uint16)
    for d, column in enumerate(v.T):
        found, codes[d] = np.unique(column, return_inverse=True)
        values.append(found)
    return np.concatenate(values), np.array([len(f) for f in values], np.int32), codes


def table(values: np.ndarray, sizes: np.ndarray, centroids: Sequence[Sequence[int]]) -> np.ndarray:
    """The squared difference of each occurring value to each centroid in that dimension."""
    bound = max(abs(int(values.min())), abs(int(values.max())), *(abs(x) for c in centroids for x in c))
    kind = np.int64 if bound <= _WIDE else object  # as Python's own integers, which have no bound
    points = np.array(centroids, kind).T
    return (values.astype(kind)[:, None] - np.repeat(points, sizes, axis=0)) ** 2


def distances(tabled: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of a block's vectors to all centroids."""
    found = np.zeros((codes.shape[1], tabled.shape[1]), tabled.dtype)
    for part, places in zip(np.split(tabled, np.cumsum(sizes)[:-1]), codes):
        found += part[places]
    return found


def nearest(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, centroids: Sequence[Sequence[int]]):
    """For each vector of a block its centroid, the first of several, and its squared distance."""
    found = distances(table(values, sizes, centroids), sizes, codes)
    chosen = found.argmin(axis=1)
    return chosen, found[np.arange(len(chosen)), chosen]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            values, sizes = (row.column(n).flatten().to_numpy() for n in ("values", "sizes"))
            codes = np.frombuffer(row.column("codes")[0].as_buffer(), np.uint16)
            yield row, values, sizes, codes.reshape(len(sizes), -1)


def _block_writer(dimensions: int, scale: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def written(rows: pa.Table) -> pa.RecordBatch:
            x = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            values, sizes, codes = coded(integers(x.reshape(-1, dimensions), scale))
            keys = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(0).combine_chunks())
            columns = [keys, pa.array([values]), pa.array([sizes]), pa.array([codes.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["keys", *_BLOCKS.names])

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= block:
                rows = pa.Table.from_batches(waiting)
                yield written(rows.slice(0, block))
                waiting, n = rows.slice(block).to_batches(), n - block
        if n:
            yield written(pa.Table.from_batches(waiting))

    return run


def _summer(centroids: Sequence[Sequence[int]], dimensions: int):
    """For each cluster the sums of its vectors' components, then their number, then of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (dimensions + 2) for _ in centroids]
        for _, values, sizes, codes in _blocks(batches):
            chosen, distance = nearest(values, sizes, codes, centroids)
            wide = int(np.abs(values).max()) > _WIDE
            ends = np.cumsum(sizes)[:-1]
            for c in np.unique(chosen).tolist():
                mine = np.flatnonzero(chosen == c)
                total = totals[c]
                for d, (own, places) in enumerate(zip(np.split(values, ends), codes)):
                    part = own[places[mine]]
                    total[d] += sum(part.tolist()) if wide else int(part.sum())
                total[-2] += len(mine)
                total[-1] += sum(distance[mine].tolist())
        rows = [(c, d, x) for c, total in enumerate(totals) if total[-2] for d, x in enumerate(total)]
        most = 10**38 - 1  # of squares beyond any long; sums of components stay below it
        columns = list(zip(*rows)) or [[], [], []]
        exact = pa.array([str(min(x, most)) for x in columns[2]], pa.string()).cast(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), exact], _PARTS.names
        )

    return run


def _labeller(centroids: Sequence[Sequence[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, *block in _blocks(batches):
            chosen, distance = nearest(*block, centroids)
            if distance.dtype == object:
                distance = np.minimum(distance, LARGEST).astype(np.int64)
            columns = [row.column("keys").flatten(), pa.array(chosen, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cluster", "distance"])

    return run


def _kept(vector: Column, dimensions: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def clusters(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    dimensions: int = DIMENSIONS,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid)`` for each row of ``vectors``
    with exactly ``dimensions`` components, none null or not finite; other rows have no result.

    A component ``x`` counts as ``floor(scale * x)``. The ``k`` rows whose ``seed:key`` has the least
    sha256 are the first centroids; rows with the same key come by their components, and there are
    fewer centroids than ``k`` only if there are fewer rows. Each round assigns all rows to the nearest
    centroid, the first of several, and replaces each one that has rows by their exact mean, rounded
    down; at the end rows are assigned once more. A null key counts as an empty one. Squared distances
    and their sums beyond a long are given as the largest long; components beyond ``2**62`` count as
    that. Rows are read once and written in blocks of ``block`` vectors; per round, each task sends
    ``k`` rows a dimension at most, and the driver gets that many in all. Other columns are left out.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    narrow = vectors.select(F.col(key).alias("key"), x.alias("x")).where(_kept(F.col("x"), dimensions))
    keys = T.StructField("keys", T.ArrayType(narrow.schema["key"].dataType))
    blocks = stored(
        narrow.mapInArrow(_block_writer(dimensions, scale, block), T.StructType([keys, *_BLOCKS])), "blocks"
    )
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = narrow.select("x", named.alias("name")).orderBy("name", "x").limit(k).collect()
    centroids = [integers(np.array(r["x"], float), scale).tolist() for r in first]
    if not centroids:
        centroids = [[0] * dimensions]  # of no rows
    names = _BLOCKS.names

    def totals(now: list[list[int]]) -> dict[tuple[int, int], int]:
        parts = blocks.select(*names).mapInArrow(_summer(now, dimensions), _PARTS)
        total = F.coalesce(F.try_sum("total"), F.lit(str(10**38 - 1)).cast("decimal(38,0)"))
        sums = parts.groupBy("cluster", "dimension").agg(total.alias("total")).collect()
        return {(r["cluster"], r["dimension"]): int(r["total"]) for r in sums}

    for _ in range(rounds):
        found = totals(centroids)
        centroids = [
            [found[c, d] // found[c, dimensions] for d in range(dimensions)] if (c, 0) in found else old
            for c, old in enumerate(centroids)
        ]
    found = totals(centroids)
    sums = [found.get((c, dimensions + 1), 0) for c in range(len(centroids))]
    inertia = F.lit(min(sum(sums), LARGEST)).cast("long")
    of_cluster = F.array(*[F.lit(min(s, LARGEST)).cast("long") for s in sums])
    points = F.array(*[F.lit(",".join(map(str, c))) for c in centroids])
    labels = T.StructType(
        [
            T.StructField("key", narrow.schema["key"].dataType),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )
    return blocks.mapInArrow(_labeller(centroids), labels).select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        inertia.alias("inertia"),
        F.split(F.get(points, F.col("cluster")), ",").cast("array<long>").alias("centroid"),
    )
