"""Cards and owners that share keys, against counting every pair."""

import random
from collections import Counter, defaultdict

import pytest

from cardmill.operators import overlap


@pytest.mark.parametrize("seed,owned_rows,pairs", [(1, 500_000, 1 << 19), (2, 40, 64), (3, 7, 1), (4, 25, 5)])
def test_shared_counts_equal_every_pair(spark, monkeypatch, seed, owned_rows, pairs):
    monkeypatch.setattr(overlap, "OWNED_ROWS", owned_rows)
    monkeypatch.setattr(overlap, "PAIRS", pairs)
    rng = random.Random(seed)
    keys = ["hot", None, "é@x", *(f"k{i}" for i in range(30))]
    held = [(rng.choice([None, *range(40)]), "hot" if rng.random() < 0.3 else rng.choice(keys)) for _ in range(200)]
    owned = {(rng.choice(keys), rng.choice([None, *range(25)])): rng.randint(1, 3) for _ in range(150)}
    owned |= {("hot", o): 2**31 + o for o in range(25)}
    by_key = defaultdict(list)
    for (k, o), n in owned.items():
        by_key[k].append((o, n))
    want = Counter()
    for c, k in set(held):
        for o, n in by_key[k] if k is not None else []:
            want[c, o] += n
    found = overlap.shared_counts(
        spark.createDataFrame(held, "card_id long, key string"),
        spark.createDataFrame([(k, o, n) for (k, o), n in owned.items()], "key string, owner_id long, n long"),
    )
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(r[:2] for r in rows))
    assert {r[:2]: r[2] for r in rows} == dict(want)


def test_no_pair_is_shuffled(spark):
    from cardmill.operators.graph import endpoint_overlap

    facts = spark.createDataFrame([(i, "k") for i in range(50)], "card_id long, key string")
    points = spark.createDataFrame([("person", i, "k") for i in range(50)], "owner_type string, owner_id long, normalized_value string")
    found = endpoint_overlap(facts, points)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2500
    assert endpoint_overlap(facts, points.limit(0)).count() == 0
