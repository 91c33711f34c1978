import math
import random

import numpy as np
import pytest

from netsight.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, key int, c1 string, cell int, n_links int, least int, kept string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3, 4, "k") for r in rows], SCHEMA).repartition(5)


def plain(rows, cosine=0.98):
    def sound(r):
        return r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    units = [np.array(r[1], np.float32).astype(float) if sound(r) else None for r in rows]
    units = [None if u is None else u / np.abs(u).max() for u in units]
    units = [None if u is None else u / np.sqrt((u * u).sum()) for u in units]
    near = [[k for k in range(len(rows)) if k != n and linked(rows, units, n, k, cosine)] for n in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for n in range(len(rows)):
        if n in seen:
            continue
        part, todo = {n}, [n]
        while todo:
            new = set(near[todo.pop()]) - part
            part |= new
            todo += new
        seen |= part
        least = min((rows[k][0] for k in part if rows[k][0] is not None), default=None)
        for k in part:
            out[k] = (rows[k][0], len(near[k]), least, rows[k][0] == least)
    return out


def linked(rows, units, n, k, cosine):
    return units[n] is not None and units[k] is not None and len(units[n]) == len(units[k]) and rows[n][2] == rows[k][2] and units[n] @ units[k] >= cosine


def around(r, centre, cosine):
    """A vector at that cosine from the unit vector."""
    side = r.normal(size=len(centre))
    side -= (side @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def draw(r, size):
    v = r.normal(size=size)
    return v / np.linalg.norm(v)


def make(seed, size=32):
    """Lone vectors, pairs, chains, a dense ball, equal vectors in equal and other labels."""
    r, rows = np.random.default_rng(seed), []
    add = lambda v, label: rows.append((len(rows), [float(x) for x in v], label))
    for _ in range(40):
        add(draw(r, size), int(r.integers(0, 3)))
    for _ in range(25):
        v = draw(r, size)
        add(v, 1)
        add(around(r, v, 0.985 + 0.014 * r.random()), int(r.integers(1, 3)))
    v = draw(r, size)
    for _ in range(30):
        add(v, 0)
        v = around(r, v, 0.99)
    v = draw(r, size)
    for _ in range(60):
        add(around(r, v, 0.993), 2)
    for k in range(20):
        add(v * (1 + (k == 3)), k % 2 + 1)
    random.Random(seed).shuffle(rows)
    return rows


def compare(spark, rows, **more):
    found = lattice.near_vectors(table_of(spark, rows), **more).collect()
    return sorted(map(repr, map(tuple, found))), sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Null and odd rows, repeated rows, other sizes, null keys, extra columns with clashing names."""
    rows = make(seed)
    v = rows[5][1]
    rows += [(900, None, 1), (901, v, None), (902, [None, *v[1:]], 1), (903, [math.nan, *v[1:]], 1), (904, [0.0] * 32, 1), (905, [], 1)]
    rows += [(906, [math.inf, *v[1:]], 1), (907, [1e-38, 1e-38], 1), (908, [2.0, 2.0], 1), (909, [1e38, 1e38], 1), (910, [-0.0, 1.0], 1), (911, [0.0, 1.0], 1)]
    rows += [rows[5], rows[5], (None, v, rows[5][2]), (None, [1.0, 2.0, 3.0], 1), (None, None, None)]
    found, expected = compare(spark, rows)
    assert found == expected


def test_blocks_of_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 7)
    found, expected = compare(spark, make(3))
    assert found == expected


def test_empty(spark):
    assert lattice.near_vectors(table_of(spark, []).limit(0)).count() == 0
    assert lattice.near_vectors(table_of(spark, [(1, None, 1), (2, [], 2)])).count() == 2


def test_nearest_is_the_nearest_lattice_point():
    r = np.random.default_rng(4)
    points = r.normal(size=(500, 8)) * 3
    near = lattice.nearest(points)
    assert ((near * 2) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    assert (((near % 1) == 0).all(axis=1) | ((near % 1) == 0.5).all(axis=1)).all()
    assert len(lattice._roots()) == 240 and (np.square(lattice._roots()).sum(axis=1) == 2).all()
    # E8's relevant vectors are its two shortest shells; no first-shell neighbour may be nearer, nor a doubled axis step.
    others = near[:, None, :] + np.concatenate([lattice._roots(), 2 * np.eye(8), -2 * np.eye(8)])
    assert (np.square(points - near).sum(axis=1)[:, None] <= np.square(points[:, None] - others).sum(axis=2) + 1e-9).all()
    assert np.square(points - near).sum(axis=1).max() <= 1 + 1e-9


def test_recall_at_the_threshold():
    """Pairs exactly at 0.98 meet in some table: more than 99 in a hundred do, whatever the size."""
    r = np.random.default_rng(6)
    for size in (8, 64, 768):
        a = np.stack([draw(r, size) for _ in range(1000)])
        b = np.stack([around(r, v, 0.98) for v in a])
        (ha, va), (hb, vb) = (lattice.cells(x, 4, 4, 1.0, 8) for x in (a, b))
        met = (ha == hb) | (va == hb[:, :, None]).any(axis=2) | (vb == ha[:, :, None]).any(axis=2)
        assert met.any(axis=1).mean() > 0.99, size


def test_cells_do_not_depend_on_the_batch():
    r = np.random.default_rng(7)
    a = lattice.unit(r.normal(size=(300, 64)))
    homes, visits = lattice.cells(a, 4, 4, 1.0, 8)
    for n in (0, 7, 299):
        h, v = lattice.cells(a[n : n + 1], 4, 4, 1.0, 8)
        assert (h[0] == homes[n]).all() and (v[0] == visits[n]).all()
