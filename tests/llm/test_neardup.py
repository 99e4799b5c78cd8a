"""Near-duplicates against all pairs on small corpora, the sampling against its theory, components against a loop."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cardmill.llm import neardup
from cardmill.llm.components import components
from cardmill.llm.wordhash import word_chunks

WORDS = [f"w{i}" for i in range(3000)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus():
    rng = random.Random(11)
    rows = [text_of(rng, rng.randrange(6, 300)) for _ in range(60)]
    for base in rows[:20]:
        rows += [edited(rng, base, rng.randrange(0, 6)) for _ in range(3)]
    hot = text_of(rng, 150)
    rows += [hot] * 40 + [edited(rng, hot, rng.randrange(0, 9)) for _ in range(90)]
    passage = text_of(rng, 60)
    rows += [passage + " " + text_of(rng, 40) for _ in range(30)]
    rows += [rows[3] + " " + rows[3], "a b", "a b", "A, b!", "c", ""]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def weights(texts, idf):
    out = []
    for words in word_chunks(pa.array(texts)):
        docs, hashes, w = neardup.document_weights(words, idf)
        out += [dict(zip(hashes[docs == k].tolist(), w[docs == k].astype(float).tolist())) for k in range(words.n_docs)]
    return out


def brute(rows, threshold):
    texts = [t for _, t in rows]
    counts = np.zeros(neardup.BUCKETS, np.int64)
    for d in weights(texts, None):
        counts += np.bincount(neardup.bucket_of(np.array(list(d), np.uint64)), minlength=neardup.BUCKETS)
    known = weights(texts, neardup.inverse_frequencies(len(texts), counts))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            common = sum(min(w, known[j][h]) for h, w in known[i].items() if h in known[j])
            total = sum(known[i].values()) + sum(known[j].values()) - common
            similarity = common / total if total else 0
            near += abs(similarity - threshold) < 1e-6
            if similarity >= threshold or texts[i] == texts[j]:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert near == 0
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("listed", [neardup.LISTED, 4])
def test_classes_equal_all_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(neardup, "LISTED", listed)
    monkeypatch.setattr(neardup, "BLOCK", 512 if listed > 4 else 30)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, unit int").repartition(3)
    got = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows, neardup.SIMILARITY)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got) and len(got) == len(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    long = text_of(rng, 60_000)
    rows = [(1, long), (2, long + " end"), (None, long), (3, None), (4, None), (5, ""), (6, ""), (7, "***"), (7, "***"), (9, "x y"), (8, "X y.")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=lambda r: (r[0] is None, r))
    assert got == [
        (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (8, 8, True),
        (9, 8, False), (None, None, True),
    ]
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 7, 8, None]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    agreed, similar = [], []
    for k in range(40):
        own = np.sort(hashes[k * 100 : k * 100 + 100])
        x, y = rng.uniform(1, 5, 100).astype(np.float32), rng.uniform(1, 5, 100).astype(np.float32)
        similar.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
        draws = [neardup.draw(np.zeros(100, np.int64), own, w, 1) for w in (x, y)]
        agreed.append((draws[0] == draws[1]).mean())
    assert abs(np.mean(agreed) - np.mean(similar)) < 0.03


def test_draws_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    docs = np.sort(rng.integers(0, 7, 500))
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    w = rng.uniform(1, 3, 500).astype(np.float32)
    whole = neardup.draw(docs, hashes, w, 8)
    monkeypatch.setattr(neardup, "CHUNK", 33)
    assert (neardup.draw(docs, hashes, w, 8) == whole).all() and not whole[7].any()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 5), (None, 3), (3, None)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None not in (a, b) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    linked = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
