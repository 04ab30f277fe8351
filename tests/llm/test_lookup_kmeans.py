import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import lookup_kmeans as lk

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, x int"


def by_hand(rows, k, rounds, size, seed=3, scale=1024):
    """One vector at a time, in Python's integers."""
    kept = []
    for key, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            v = [max(-(2**62), min(2**62, math.floor(scale * Fraction(c)))) for c in x]
            name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
            kept.append((name, x, v, key))
    kept.sort(key=lambda r: r[:2])
    points = [r[2] for r in kept[:k]]

    def nearest(v):
        found = [sum((a - b) ** 2 for a, b in zip(v, p)) for p in points]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        groups = {}
        for *_, v, _ in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        points = [
            [sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else p for i, p in enumerate(points)
        ]
    labels = [(key, *nearest(v)) for *_, v, key in kept]
    sums = [sum(d for _, c, d in labels if c == i) for i in range(len(points))]
    most = lk.LARGEST
    return [
        (key, c, min(d, most), min(sums[c], most), min(sum(sums), most),
         tuple(max(-(2**63), min(2**63 - 1, x)) for x in points[c]))
        for key, c, d in labels
    ]


def compared(shared, rows, k=8, rounds=10, size=64, **more):
    table = shared.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], VECTORS)
    found = lk.clusters(table, k=k, rounds=rounds, dimensions=size, **more)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    got = [(*r[:5], tuple(r.centroid)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows, k, rounds, size), key=repr)
    return got


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.lists(st.integers(-9, 9) | st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=20),
    st.lists(st.lists(st.integers(-9, 9) | st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=4),
)
def test_sums_of_gathered_rows_are_distances(rows, centroids):
    values, sizes, codes = lk.coded(np.array(rows, np.int64))
    got = lk.distances(lk.table(values, sizes, centroids), sizes, codes)
    assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]


def test_rows_of_every_kind(shared):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) + i % 5 for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [0.5] * 4), (None, [0.1] * 4), (None, None), (900, None), (901, [])]
    rows += [(902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [float("nan")] * 4),
             (906, [float("inf"), 0.0, 0.0, 0.0]), (907, [-0.0004, 0.0, -1e-300, 0.0])]
    got = compared(shared, rows, size=4, block=32)
    assert len(got) == 304


def test_copies_ties_and_empty_clusters(shared):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(i, [3.0, 2.0]) for i in range(50, 53)]
    compared(shared, rows, k=8, size=2, rounds=3)


def test_fewer_rows_than_centroids(shared):
    compared(shared, [(1, [0.5, -0.5]), (2, [0.25, 7.0])], size=2, rounds=2)


@pytest.mark.parametrize("far", [2.0e5, 1.0e9, 4.0e15, 1.0e308])
def test_large_components(shared, far):
    rows = [(i, [far if i % 3 else -far, i / 7, far + i]) for i in range(20)]
    compared(shared, rows, k=3, size=3, rounds=3)


def test_no_rows(shared):
    assert compared(shared, [], size=3, rounds=2) == []
    assert compared(shared, [(1, None)], size=3, rounds=2) == []


def test_whole_table(shared, small):
    table = shared.read.parquet(f"{small}/embeddings.parquet")
    found = lk.clusters(table.repartition(3), rounds=2, block=100)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = [(*r[:5], tuple(r.centroid)) for r in found.collect()]
    assert sorted(got) == sorted(by_hand(rows, 8, 2, 64))
