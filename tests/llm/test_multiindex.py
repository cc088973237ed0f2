"""Near-duplicate embeddings against all pairs, in easy, crowded and diffuse tables."""

import math

import numpy as np
import pytest

from faultfold.llm import multiindex

NAMES = "vec_id long, embedding array<double>, cell long, ball long, n long"


def brute(rows, least=0.9):
    """Rows of the result by all pairs: distinct (id, vector), cosines in doubles."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            good.setdefault((i, tuple(c + 0.0 for c in v)), None)
    keys = sorted(good)
    group, links = list(range(len(keys))), [0] * len(keys)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for d in {len(v) for _, v in keys}:
        at = [k for k, (_, v) in enumerate(keys) if len(v) == d]
        m = np.array([keys[k][1] for k in at])
        m = m / np.abs(m).max(axis=1)[:, None]
        m = m / np.linalg.norm(m, axis=1)[:, None]
        for x, y in zip(*np.nonzero(m @ m.T >= least), strict=True):
            if x != y:
                links[at[x]] += 1
                a, b = sorted((root(at[x]), root(at[y])))
                group[b] = a
    out = [(i, links[k], keys[root(k)][0], keys[root(k)][0] == i) for k, (i, _) in enumerate(keys)]
    known = {i for i, _ in keys}
    return sorted(out + [(i, 0, i, None if i is None else True) for i in {i for i, _ in rows} - known], key=repr)


def run(spark, rows, **options):
    given = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], NAMES).repartition(4)
    return sorted((tuple(r) for r in multiindex.near_duplicates(given, **options).collect()), key=repr)


def table(rng, alone, groups, dim=16):
    """Unrelated vectors and groups (size, spread) around a point each."""
    made = list(rng.standard_normal((alone, dim)))
    for size, spread in groups:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        made += list((base + spread * rng.standard_normal((size, dim)) / math.sqrt(dim)) * rng.uniform(0.5, 3, (size, 1)))
    order = rng.permutation(len(made))
    return [(int(i) * 3 + 1, made[k].tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("groups", [[(2, 0.2)] * 20, [(300, 0.05)], [(200, 0.3), (150, 0.45)], [(120, 0.15), (120, 0.2), (40, 0.01)]])
def test_links_and_components(spark, monkeypatch, groups):
    """One cell for all is exact, crowds and balls included; several blocks, too."""
    monkeypatch.setattr(multiindex, "CROWD", 20)
    monkeypatch.setattr(multiindex, "BLOCK_ROWS", 64)
    rows = table(np.random.default_rng(5), 200, groups)
    monkeypatch.setattr(multiindex, "CELL_ROWS", 10**6)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("groups", [[(2, 0.2)] * 60 + [(2, 0.4)] * 60, [(500, 0.1)] + [(3, 0.3)] * 40])
def test_recall_over_cells(spark, monkeypatch, groups):
    monkeypatch.setattr(multiindex, "CROWD", 30)
    monkeypatch.setattr(multiindex, "CELL_ROWS", 20)
    rows = table(np.random.default_rng(6), 1500, groups)
    want, got = ({r[0]: r for r in x} for x in (brute(rows), run(spark, rows)))
    assert want.keys() == got.keys()
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.98 * sum(r[1] for r in want.values())
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (5, v), (4, v), (9, [2.0, 4.0, 6.0]), (7, [1.0, -2.0, 0.0]), (7, [1.0, 2.0, 3.1]), (None, v), (1, None), (2, [0.0, -0.0, 0.0])]
    rows += [(3, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (10, []), (11, [5.0]), (12, [-5.0]), (13, [0.1]), (14, [1e300, 2e300, 3e300]), (15, [1e-300, 2e-300, 3e-300]), (16, [0.0, 0.0, 1.0]), (17, [-0.0, 0.0, 1.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0])], least=0.2)


def test_multi_sequence_goes_from_near_to_far():
    rng = np.random.default_rng(1)
    first, second = np.sort(rng.random(9)), np.sort(rng.random(7))
    order = multiindex.multi_sequence(first, second, 40)
    sums = [first[i] + second[j] for i, j in order]
    assert len(set(order)) == 40 and sums == sorted(np.add.outer(first, second).ravel())[:40]
    grid = multiindex.Grid(rng.random((9, 2)), rng.random((7, 2)), 63)
    one = rng.random((1, 4))
    visits = grid.visits(one)[0]
    assert grid.ranks(one[0], visits).tolist() == list(range(63)) and grid.homes(one)[0] == visits[0]
