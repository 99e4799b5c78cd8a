"""Ranked search over the treap against scoring every document."""

import glob
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from cardmill.llm import catalog, k2treap
from tests.oracle_check import compare, connect

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def by_scoring(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    out = []
    for item, text in items:
        scored = []
        weights = {}
        for term in set(terms_of(text)):
            df = sum(term in c for _, c, _ in counts)
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(scored)[:k])]
    return out


def texts(rng, n, longest=40):
    words = ["Año", "été", "漢字", "x1", "Zz"] + [f"w{i}" for i in range(60)]
    heavy = [1 / (i + 1) for i in range(len(words))]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choices(words, heavy, k=rng.randint(1, longest))) for _ in range(n)]


def searched(spark, docs, items, k=k2treap.TOP, **more):
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, terms string, score int")
    q = spark.createDataFrame([(i, t, "a", 1) for i, t in items], "item_id string, text string, q string, rank int")
    return [tuple(r) for r in k2treap.search(k2treap.build(d.repartition(3)), q, k, **more).collect()]


@pytest.mark.parametrize("seed", range(20))
def test_quadtree_holds_the_maxima(seed):
    rng = np.random.default_rng(seed)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, 37, 80), rng.integers(0, 9, 80), rng.integers(1, 99, 80))}
    rows, columns = np.array(list(cells)).T
    masks, best = k2treap.quadtree(rows, columns, np.array(list(cells.values())), 6)
    treap = k2treap.Treap([], 6, masks.tobytes(), best.astype("<i4").tobytes())
    for r in range(64):
        for c in range(64):
            cell, at = np.array([1]), 0
            for level in range(6):
                inside = [v for (a, b), v in cells.items() if a >> (6 - level) == r >> (6 - level) and b >> (6 - level) == c >> (6 - level)]
                assert treap.best[cell[0]] == max(inside, default=0)
                cell = treap._open(cell, np.array([r >> (5 - level) & 1]), c >> (5 - level) & 1)
            assert treap.best[cell[0]] == cells.get((r, c), 0)


@pytest.mark.parametrize("seed,block,k", [(1, 6_000_000, 50), (2, 300, 5), (3, 1, 3)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, block, k):
    monkeypatch.setattr(k2treap, "BLOCK_BYTES", block)
    rng = random.Random(seed)
    docs = list(enumerate(texts(rng, 300 if block > 1 else 30)))
    docs += [(i + 1000, t) for i, t in docs[:40]] + docs[:5]  # ties, and repeated rows
    docs += [(None, docs[0][1]), (7000, None), (7001, ""), (7002, "...!"), (7003, "w1 " * 5000), (7004, docs[9][1] * 50)]
    items = [(f"i{j}", t) for j, t in enumerate(texts(rng, 12))]
    items += [items[0], ("none", None), ("empty", " . "), ("new", "unheard"), (None, "w1 w2"), ("all", " ".join(t for _, t in items))]
    want = by_scoring(docs, items, k)
    assert sorted(searched(spark, docs, items, k, query_bytes=100), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    assert searched(spark, [], [("a", "w1")]) == []
    assert searched(spark, [(1, "w1")], []) == []
    assert searched(spark, [(1, None)], [("a", "w1")]) == []
    assert searched(spark, [(1, "w1")], [("a", "w1")]) == by_scoring([(1, "w1")], [("a", "w1")], 50)


def test_nodes_below_the_kth_score_stay_closed():
    rng = random.Random(3)
    docs = [f"a{rng.randint(0, 400)} b{rng.randint(0, 400)} c{rng.randint(0, 9)}" for _ in range(4000)] + ["rare a1 b1"] * 3
    raw = [d.encode() for d in docs]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    block = k2treap._block(list(range(len(docs))), np.frombuffer(b"".join(raw), np.uint8), bounds, len(docs), 3 * len(docs))
    treap = k2treap.Treap(block["doc_ids"], block["height"], block["masks"], block["best"])
    row_of = {t: r for r, t in enumerate(block["terms"].split(b" "))}
    best = k2treap.Best(3)
    rows = np.array([row_of[t] for t in (b"rare", b"a1", b"b1", b"c3")])
    opened = treap.search(rows, np.array([7000, 5000, 5000, 1500]), best)
    assert [r[2] for r in best.rows] == [4000, 4001, 4002]
    assert opened < len(docs) / 4


def test_impacts_beyond_64_bits():
    n = np.array([1, 10**12])
    want = [10**9 * 3 // (3000 + 20 * (50 + 50 * int(x) * 10**9 // 10**14)) for x in n]
    assert k2treap.impacts(np.array([3, 3]), n, 10**9, 10**14).tolist() == want


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op12_ranked_search"
    _, n, same, note = compare(spark, connect(folder), name, catalog.QUERIES[name], catalog.ORACLES[name], folder)
    assert same and n > 0, note


def test_large_blocks_of_one_task_are_row_groups_of_their_own(spark, monkeypatch):
    """A writer or reader holds a row group: with all blocks of a task in one, memory grows with the task's share of the table."""
    monkeypatch.setattr(k2treap, "BLOCK_BYTES", 1_000_000)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(map(str, rng.integers(0, 10**6, 1500).tolist()))) for i in range(1500)]
    index = k2treap.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index.blocks.path.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    stored = [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups]
    assert sum(stored) > 12 << 20
    assert max(stored) <= 8 << 20
