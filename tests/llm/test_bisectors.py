"""Clustering by bisectors against exact distances written down."""

import hashlib
import math
import random

import numpy as np
import pytest

from cardmill.llm import bisectors, catalog
from tests.oracle_check import compare, connect


def by_distance(rows, k, rounds, scale, dimensions):
    """(vec_id, cluster, distance) of every kept vector, and the centroids; Python integers throughout."""
    kept = [
        (i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for c in set(found):
            own = [v for (_, v), f in zip(kept, found) if f == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def as_found(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance string")
    found, centroids = bisectors.clusters(df, **settings)
    return found.collect(), centroids


def case(seed, huge=False):
    rng = random.Random(seed)
    base = [[rng.choice([-0.5, 0.0, 0.25, 1.0, 3.0]) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rng.choice([0.0, 0.0, 0.015625, -0.01]) for x in rng.choice(base)]) for i in range(120)]
    rows += rows[:3] + [(None, base[0]), (500, None), (501, base[0][:3]), (502, base[0] + [0.0])]
    rows += [(503, [None, 0.0, 0.0, 0.0]), (504, [float("nan"), 0.0, 0.0, 0.0]), (505, [float("-inf"), 0.0, 0.0, 0.0])]
    if huge:
        rows += [(600, [2.0**33, -(2.0**33), 0.0, 1.0]), (601, [2.0**33, 0.5, 0.0, 1.0]), (602, [2.0**29, 0.0, 0.0, -3.0])]
    return rows


@pytest.mark.parametrize("seed,k,huge", [(1, 5, False), (2, 16, False), (3, 300, False), (4, 7, True)])
def test_equals_exact_distances(spark, seed, k, huge):
    rows = case(seed, huge)
    want, final = by_distance(rows, k, 3, 64, 4)
    found, centroids = as_found(spark, [(i, v, "x", "y") for i, v in rows], k=k, dimensions=4)
    assert centroids == final
    got = [(r["vec_id"], r["cluster"], r["distance"]) for r in found]
    assert sorted(got, key=str) == sorted(((i, c, d if d < 10**24 else None) for i, c, d in want), key=str)
    for r in found:
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_beyond_every_number_type(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]
    want, final = by_distance(rows, 2, 3, 64, 2)
    found, centroids = as_found(spark, [(i, v, "", "") for i, v in rows], k=2, dimensions=2)
    assert centroids == final
    assert {r["vec_id"]: r["cluster"] for r in found} == {i: c for i, c, _ in want}
    assert {r["distance"] for r in found} == {d if d < 10**24 else None for _, _, d in want}
    assert {r["inertia"] for r in found} == {None}


def test_tournament_takes_the_smaller_number_of_equals():
    b = bisectors.Bisectors.between([[0, 0], [2, 0], [0, 0], [1, 1]])
    cluster, distance = b.nearest(np.array([[1, 0], [2, 0], [0, 0], [1, -1]]))
    assert cluster.tolist() == [0, 1, 0, 0]
    assert distance.tolist() == [1, 0, 0, 2]


def test_fewer_vectors_than_centroids_and_none(spark):
    found, centroids = as_found(spark, [(1, [0.5, 1.0], "", ""), (2, [0.5, 1.0], "", "")], k=16, dimensions=2)
    assert len(centroids) == 2
    assert [(r["cluster"], int(r["distance"])) for r in found] == [(0, 0), (0, 0)]
    found, centroids = as_found(spark, [], k=16, dimensions=2)
    assert found == [] and centroids == []
    found, centroids = as_found(spark, [(1, None, "", "")], k=16, dimensions=2)
    assert found == [] and centroids == []


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    _, n, same, note = compare(
        spark, connect(folder), "op11_clusters", catalog.QUERIES["op11_clusters"], catalog.ORACLES["op11_clusters"], folder
    )
    assert same and n > 0, note
