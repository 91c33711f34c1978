import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsight.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, mark string, code int, vector string, scores int, slot int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", 2, "v", 3, 4) for r in rows], SCHEMA).repartition(4)


def plain(rows, asks):
    def sound(r):
        return r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    rows = list(dict.fromkeys((i, None if v is None else tuple(None if x is None else float(np.float32(x)) for x in v), l) for i, v, l in rows))
    rows = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in filter(sound, rows)]
    out = []
    for n, (i, v, l) in enumerate(rows):
        if not asks(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j, m) for k, (j, w, m) in enumerate(rows) if k != n and len(w) == len(v)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for ps, _, p, _ in [s for s in scored if s[3] == l][:5]:
            fits = [s for s in scored if s[3] != l and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(i, p, k + 1, s[2], -ps, -s[0]) for k, s in enumerate(fits)]
    return out


def make(seed, n, size, shared):
    r = random.Random(seed)
    pool = [[r.choice([-1.0, -0.3, 0.0, 0.1, 0.25, 0.5, 1.0]) for _ in range(size)] for _ in range(shared)]
    return [(i, r.choice(pool) if r.random() < 0.7 else [r.uniform(-1, 1) for _ in range(size)], r.randint(0, 2)) for i in range(n)]


@pytest.mark.parametrize("seed,size,shared", [(1, 6, 5), (2, 1, 3), (3, 40, 2)])
def test_against_brute_force(spark, seed, size, shared):
    """Many ties; null and odd rows; repeated rows; other sizes; extra columns with clashing names."""
    rows = make(seed, 120, size, shared)
    rows += [(200, None, 1), (201, [0.5] * size, None), (300, [None, *[0.5] * (size - 1)], 1), (301, [math.nan] * size, 1)]
    rows += [(302, [math.inf] * size, 1), (400, [0.5] * (size + 1), 1), (401, [0.25] * (size + 1), 1), (402, [0.2] * (size + 1), 0)]
    rows += [(None, [1.0] * size, 0), (500, [], 0), (501, [], 0), (502, [], 1), rows[7], rows[0], rows[0]]
    expected = plain(rows, lambda i: i is not None and i % 10 == 0)
    found = negatives.hard_negatives(table_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_small_tiles_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ROWS", 10)
    rows = [(i, v, 0 if i % 3 else l) for i, v, l in make(9, 200, 5, 6)]
    found = negatives.hard_negatives(table_of(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(plain(rows, lambda i: i % 10 == 0))
    empty = table_of(spark, rows).limit(0)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(table_of(spark, rows), F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("big", [1, 3, 256, 10**6, 2**26, 2**28])
@pytest.mark.parametrize("size", [1, 64, 1500])
def test_product_is_exact(big, size):
    if big**2 * size >= 2**63:
        size = 100
    r = np.random.default_rng(big + size)
    a, b = (r.integers(-big, big, (n, size), endpoint=True) for n in (4, 7))
    expected = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert negatives.product(a, b).tolist() == expected


def test_extreme_products():
    a = np.array([[2**31 - 1, 2**31 - 1], [-(2**31), 2**31 - 1]])
    expected = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in a[:1]] for p in a]
    assert negatives.product(a, a[:1]).tolist() == expected
    with pytest.raises(ValueError):
        negatives.product(np.array([[2**40]]), np.array([[2**40]]))
    assert negatives.product(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_primes_tell_all_scores_apart():
    for bound in (0, 1, 125, 10**7, 2**62):
        found = negatives.primes(bound)
        assert math.prod(found) > 2 * bound
        assert all(p <= negatives.LARGEST and (p // 2) ** 2 < negatives.EXACT for p in found)
