import numpy as np
import pytest

from pageloom.llm import cover_tree as c


def groups(linked):
    own = np.arange(len(linked))
    while True:
        new = np.minimum(own, np.where(linked, own[None, :], len(own)).min(axis=1, initial=len(own)))
        if (new == own).all():
            return own
        own = new


def sample(n, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    for k in range(0, n, 10):
        x[k : k + 6] = x[k] + rng.normal(size=(len(x[k : k + 6]), 8)) * spread
    x[n // 2 : n // 2 + n // 5] = x[0] + rng.normal(size=(n // 5, 8)) * spread
    return x


@pytest.mark.parametrize("spread", [0.02, 0.2, 0.6])
def test_trees_cover_and_traversal_is_exact(spread, monkeypatch):
    x, y = c._normal(sample(400, 1, spread)), c._normal(sample(300, 2, spread))
    y[:50] = x[:50]
    above = c.build(x)
    for k in range(1, c.LEVELS):
        centres = np.unique(above[k])
        apart = c._distance(x[centres], x[centres]) + 10 * np.eye(len(centres))
        assert apart.min() > 2.0 ** (1 - k) - 1e-6
        assert (np.linalg.norm(x - x[above[k]], axis=1) <= 2.0 ** (2 - k) + 1e-6).all()
        parents = above[k - 1][centres]
        assert (np.linalg.norm(x[centres] - x[parents], axis=1) <= 2.0 ** (2 - k) + 1e-6).all()
        assert (above[k - 1] == above[k - 1][above[k]]).all()
        assert set(above[k - 1]) <= set(centres)
    for few in (0, 1 << 20):
        monkeypatch.setattr(c, "_FEW", few)
        seen = np.zeros((400, 300), int)
        for rows, others, linked in c.dual(c.Tree(x, above), c.Tree(y, c.build(y)), 0.95):
            seen[np.ix_(rows, others)] += linked
        assert (seen == (x @ y.T >= 0.95)).all()


@pytest.mark.parametrize("tile", [10_000, 40])
def test_against_brute_force(shared, tile):
    x = sample(300, 3, 0.1).astype(np.float32)
    x[200:230] = x[7]  # copies
    rows = [(int(k) + 10, [float(v) for v in row], "extra", 1) for k, row in enumerate(x)]
    table = shared.createDataFrame(rows, "vec_id long, embedding array<float>, node string, weight int").repartition(3)
    unit = c._normal(x.astype(np.float64))
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    component = groups(linked) + 10
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in c.duplicates(table, tile=tile).collect()}
    assert got == {
        k + 10: (int(linked[k].sum()), int(component[k]), bool(component[k] == k + 10)) for k in range(len(x))
    }


def test_awkward_vectors(shared):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e-30, 0.0]),
        (8, [5.0, 0.1]), (8, [5.0, 0.1]), (None, [1.0, 0.0]), (9, [-1.0, 0.0]), (None, [0.0, -0.0]), (10, [-2.0, -0.0]),
        (None, [0.0, 1.0]),
    ]
    table = shared.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(repr(tuple(r)) for r in c.duplicates(table).collect())
    want = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6)] + [
        (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (None, 3, 7, False), (9, 1, 9, True), (10, 1, 9, False),
        (None, 0, None, True), (None, 0, None, True),
    ]
    assert got == sorted(map(repr, want))


def test_tables_without_usable_vectors(shared):
    empty = shared.createDataFrame([], "vec_id long, embedding array<float>")
    assert c.duplicates(empty).collect() == []
    null = shared.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in c.duplicates(null).collect()] == [(1, 0, 1, True)]


def test_vectors_of_several_lengths(shared):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.1]), (5, [1.0]), (6, [3.0]), (7, [0.0, 1.0])]
    table = shared.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in c.duplicates(table).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
