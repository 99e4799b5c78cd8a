"""Tables by key against a dictionary: replays, tombstones, compaction, slots, half-done commits."""

import random

import pytest
from pyspark.sql import functions as F

from cardmill.sources import segments
from cardmill.sources.segments import Segments

ROWS = "k long, part string, n long"


def opened(spark, tmp_path):
    return Segments(spark, str(tmp_path / "store"), {"t": ["k"], "pairs": ["k", "part"]})


def frame(spark, rows, columns=ROWS):
    return spark.createDataFrame(rows, columns)


def shown(df):
    return sorted(map(tuple, df.collect()))


def test_equals_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "ROWS_PER_SLOT", 10)
    store, rng, held = opened(spark, tmp_path), random.Random(10), {}
    for batch in range(6):
        touched = [rng.randrange(30) for _ in range(rng.choice([2, 9]))]
        rows = [(k, f"p{i}", batch) for k in set(touched) for i in range(rng.randrange(4))]  # none: deleted
        for k in touched:
            held[k] = [r for r in rows if r[0] == k]
        keys = frame(spark, [(k,) for k in touched], "k long")
        assert store.commit("s", batch, {"t": (frame(spark, rows), keys)})
        assert not store.commit("s", batch, {"t": (frame(spark, [(99, "again", 0)]), None)})  # a replay
        assert shown(store.read("t")) == sorted(r for own in held.values() for r in own)
        store.compact()
        assert shown(store.read("t")) == sorted(r for own in held.values() for r in own)
        some = rng.sample(range(40), 5)
        asked = frame(spark, [(k,) for k in some], "k long")
        assert shown(store.read("t", asked)) == sorted(r for k in some for r in held.get(k, []))
    assert len(store.sizes("t")) <= 4 and store.applied("s") == 5
    assert len(store._versions()) <= 12


def test_one_manifest_for_all_tables_and_streams(spark, tmp_path):
    store = opened(spark, tmp_path)
    one = frame(spark, [(1, "a", 1), (None, "a", 2)])
    store.commit("s", 0, {"t": (one, None), "pairs": (one, None)})
    store.commit("other", 0, {"pairs": (frame(spark, [(1, "a", 7), (1, "b", 8)]), None)})
    assert shown(store.read("t")) == [(1, "a", 1)]  # a row without a key is left out
    assert shown(store.read("pairs")) == [(1, "a", 7), (1, "b", 8)]
    assert store.applied("s") == store.applied("other") == 0 and store.applied("new") == -1
    with pytest.raises(KeyError):
        Segments(spark, store.path, {"u": ["k"]}).read("u")


def test_commit_that_died_before_the_swap(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path)
    store.commit("s", 0, {"t": (frame(spark, [(1, "a", 1)]), None)})
    with monkeypatch.context() as broken:
        broken.setattr(Segments, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit("s", 1, {"t": (frame(spark, [(1, "half", 2)]), None)})
    assert shown(store.read("t")) == [(1, "a", 1)] and store.applied("s") == 0
    assert store.commit("s", 1, {"t": (frame(spark, [(1, "b", 3)]), None)})
    assert shown(store.read("t")) == [(1, "b", 3)]


def test_reading_some_keys_reads_their_slots_alone(spark, tmp_path):
    store = opened(spark, tmp_path)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.lit(1).cast("long").alias("n"))
    store.commit("s", 0, {"t": (rows, None)})
    found = store.read("t", frame(spark, [(5,)], "k long"))
    assert shown(found) == [(5, "p", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters")[1][:60]


def test_empty_commits(spark, tmp_path):
    store = opened(spark, tmp_path)
    assert store.commit("s", 0, {"t": (frame(spark, []), None)})
    assert shown(store.read("t")) == [] and store.sizes("t") == []
    store.commit("s", 1, {"t": (frame(spark, []), frame(spark, [(4,)], "k long"))})
    assert shown(store.read("t")) == []
