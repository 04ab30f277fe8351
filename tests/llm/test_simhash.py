import random
from functools import reduce

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import simhash as s
from pageloom.llm.components import components


def brute_mark(text, size=3):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, distance):
    group = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB \t \x1cé\n", max_size=60), st.integers(1, 5))
def test_fingerprint(text, size):
    assert s.fingerprint(text, size) == brute_mark(text, size)


def test_whole_table_against_brute_force(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    marks = [brute_mark(r.text) for r in rows]
    groups = brute_groups(marks, 3)
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    want = {(r.doc_id, f"{m:016x}", least[g]) for r, m, g in zip(rows, marks, groups)}
    assert {tuple(r) for r in s.duplicates(docs).collect()} == want
    assert sorted(r.doc_id for r in s.keep_one(docs).collect()) == sorted(least.values())


@pytest.mark.parametrize("distance,cell_rows", [(3, 50_000), (3, 7), (1, 3), (5, 20)])
def test_links_lose_nothing(shared, distance, cell_rows):
    """Dense groups, also in cells that are dealt out in pieces."""
    rng = random.Random(distance * cell_rows)
    marks = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        marks.update(reduce(lambda m, b: m ^ (1 << b), rng.sample(range(64), rng.randint(0, 4)), base) for _ in range(40))
    marks = sorted(marks)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    found = components(s.links(shared.createDataFrame([(m,) for m in signed], "fp long"), distance, cell_rows))
    got = {r.node: r.component for r in found.collect()}
    groups = brute_groups(marks, distance)
    assert len({got.get(m, m) for m in signed}) == len(set(groups))
    for m, g in zip(signed, groups):
        assert got.get(m, m) == min(x for x, h in zip(signed, groups) if h == g)


def test_awkward_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, "a b"), (9, "a b"), (9, "q r s t"), (None, "x y z"), (None, "x y z"),
            (1, long), (2, long + " end"), (7, "A  B")]
    got = sorted(map(repr, s.duplicates(docs_of(rows)).select("doc_id", "component_id").collect()))
    want = [(5, 3), (3, 3), (9, 7), (9, 7), (7, 7), (9, 9), (None, None), (None, None), (1, 1), (2, 1)]
    assert [x.split("(")[1] for x in got] == sorted(f"doc_id={a}, component_id={b})" for a, b in want)
    kept = s.keep_one(docs_of(rows))
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("3", ""), ("7", "A  B"), ("9", "q r s t"), ("None", "x y z"), ("1", long)]
    )
    assert kept.columns == docs_of(rows).columns


def test_empty_table(docs_of):
    assert s.duplicates(docs_of([])).collect() == []
    assert s.keep_one(docs_of([])).collect() == []


def test_components_of_long_chains_and_stars(shared):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    rng = random.Random(1)
    rng.shuffle(edges)
    found = components(shared.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got)
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
