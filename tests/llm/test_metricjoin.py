"""The metric join against all pairs, with many small cells and groups, hot vectors and odd rows."""

import math
import random
import time
import tracemalloc

import numpy as np
import pytest

from cardmill.llm import metricjoin

NAN, INF = float("nan"), float("inf")


def vectors(seed=3, n=260, size=6):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(size).tolist() for _ in range(n)]
    rows += [(np.array(rows[k]) + rng.standard_normal(size) * s).tolist() for k, s in zip(rng.integers(0, n, 160), rng.uniform(0.01, 0.5, 160))]
    rows += [rows[5]] * 60 + [(np.array(rows[5]) * 2).tolist()] * 3
    rows += [None, [], [0.0] * size, [NAN] + [1.0] * (size - 1), [INF] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), rows[7][:3], rows[7][:3], [1e300] * size]
    order = list(range(len(rows)))
    random.Random(seed).shuffle(order)
    return [(i * 3 - 40, rows[k]) for i, k in enumerate(order)]


def brute(rows, cosine):
    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v) / max(abs(c) for c in v)
        return v / np.sqrt(v @ v)

    units = [unit(v) for _, v in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    n = [0] * len(rows)
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            linked = units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
            n[i] += linked
            n[j] += linked
            if linked:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((i, k, find(i), find(i) == i) for (i, _), k in zip(rows, n))


@pytest.mark.parametrize(("per_pivot", "homes"), [(4096, 4096), (20, 7)])
def test_equals_all_pairs(spark, monkeypatch, per_pivot, homes):
    monkeypatch.setattr(metricjoin, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(metricjoin, "HOMES", homes)
    monkeypatch.setattr(metricjoin, "VISITORS", 64)
    rows = vectors()
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, code int").repartition(3)
    assert sorted(map(tuple, metricjoin.near_vectors(df).collect())) == brute(rows, metricjoin.COSINE)


def test_visits_lose_no_partner():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.1])
    x /= np.linalg.norm(x, axis=1)[:, None]
    radius = math.sqrt(2 - 2 * 0.95)
    cells = metricjoin.Cells(x[:25], 5, radius)
    home = cells.home(x)
    visits = cells.visits(x, home)
    near = np.argwhere(x @ x.T >= 0.95)
    assert all(visits[j, home[i]] for i, j in near)
    assert visits.mean() < 0.5


def test_ids_missing_and_shared(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, metricjoin.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 1, False)], key=str)
    assert metricjoin.near_vectors(df.limit(0)).count() == 0


def test_visited_group_without_homes(spark):
    a, b = (np.array(v, "<f8").tobytes() for v in ([1.0, 0.0], [0.99, 0.01]))
    rows = [
        (7, 0, 0, 1, 1, 1, a), (7, 0, 1, 1, 1, 1, a), (7, 0, 1, 2, 2, 1, b),  # one at home, two visitors
        (7, 1, 1, 1, 1, 1, a), (7, 1, 1, 2, 2, 1, b),  # visitors alone
        (8, 0, 1, 2, 2, 1, b),
    ]
    meetings = spark.createDataFrame(rows, metricjoin.MEETING)
    got = sorted(map(tuple, metricjoin._join_cells(meetings, 0.95).collect()))
    assert got == [(False, 1, 1, 1), (True, 2, 1, 0)]


def test_many_pivots_take_little_memory_and_time():
    rng = np.random.default_rng(2)
    pivots = rng.standard_normal((1024, 256))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    x = pivots[rng.integers(0, 1024, 1024)] + rng.standard_normal((1024, 256)) * 0.02
    tracemalloc.start()
    cells = metricjoin.Cells(pivots, 256, 0.3)
    cells.visits(x, cells.home(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    start = time.time()
    cells.visits(x, cells.home(x))
    assert time.time() - start < 1
