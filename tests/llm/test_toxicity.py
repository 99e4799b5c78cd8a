"""Toxicity: gradients against differences, scores against a step-by-step network, windows, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cardmill.llm import toxicity

SYLLABLES = "the of ti on er an in re st ha".split()
BAD = ["vilewort", "grimsnark"]


def corpus(n=700, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 90))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "er"])
        rows.append((i, " ".join(words).capitalize() + ".", toxic))
    return rows


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    monkeypatch.setattr(toxicity, "TRAIN_STRIDE", 4)
    rows = corpus(12)
    sample = toxicity.read_sample([t for _, t, _ in rows])
    trainer = toxicity.Trainer(sample, np.array([y for _, _, y in rows]))
    trainer.p = {k: v.astype(np.float64) for k, v in trainer.p.items()}
    windows = np.arange(len(sample.doc))[:20]
    target = trainer.labels[sample.doc[windows]]

    def loss():
        p = trainer.p
        table = toxicity.project(p, toxicity.inputs_of(p, sample.place, sample.grams, sample.bounds))
        logit = toxicity.logits_of(p, table, sample.index[windows]).astype(np.float64)
        return np.mean(np.logaddexp(0, logit) - target * logit)

    gradients = trainer.gradients(windows)
    for name, g in gradients.items():
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            where = np.unravel_index(at, g.shape)
            kept, step = trainer.p[name][where], 3e-3
            trainer.p[name][where] = kept + step
            up = loss()
            trainer.p[name][where] = kept - step
            down = loss()
            trainer.p[name][where] = kept
            assert (up - down) / (2 * step) == pytest.approx(g[where], rel=0.08, abs=3e-5), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 56, 57, 1000])
    docs, first = toxicity.windows_of(counts)
    for d, n in enumerate(counts):
        own = first[docs == d]
        seen = {w for f in own for w in range(f, min(f + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and all(np.diff(own) <= toxicity.STRIDE)


def test_score_is_that_of_the_highest_window():
    model = toxicity.fit_rows([(t, y) for _, t, y in corpus(80)])
    text = corpus(1, seed=9)[0][1] + " " + " ".join(corpus(6, seed=10)[k][1] for k in range(6)) + " vilewort end"
    scores, counts = toxicity.score_column(pa.array([text, None, "", "..."]), model)
    words = text.replace(".", " ").split()
    _, first = toxicity.windows_of(np.array([len(words)]))
    each = [toxicity.score_column(pa.array([" ".join(words[f : f + toxicity.WINDOW])]), model)[0][0] for f in first]
    assert counts.tolist() == [len(first), 0, 0, 0] and scores[1:].tolist() == [0, 0, 0]
    assert scores[0] == pytest.approx(max(each), abs=1e-5)


def test_every_window_is_scored():
    rows = corpus(160)
    learnt, others = rows[:80], rows[80:]
    model = toxicity.fit_rows([(t, y) for _, t, y in learnt])
    words = " ".join(t for _, t, _ in others).replace(".", "").split()
    size = toxicity.WINDOW
    texts = [" ".join(words[:k]) for k in (1, size - 1, size, size + 1)] + [" ".join(words[k : k + 90]) for k in range(0, 1800, 90)]
    scores, counts = toxicity.score_column(pa.array(texts), model)
    for text, score, count in zip(texts, scores, counts):
        own = text.split()
        each = [" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))]
        assert count == len(each)
        assert score == pytest.approx(toxicity.score_column(pa.array(each), model)[0].max(), abs=1e-5)


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, "vilewort", 0.0), (9000, None, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 0), (9000, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    sample = toxicity.training_rows(docs, labels)
    assert all(t in {x for i, x, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2} for t, _ in sample)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows) + 2 and got[9000] == 0
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in out)
    assert right >= 0.9 * len(out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [tuple(r) for r in toxicity.toxicity(docs, None).collect()] == [(1, 0.0, 1)]
    assert toxicity.toxicity(docs.limit(0), None).count() == 0
