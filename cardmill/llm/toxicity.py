"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is its own embedding (words of the training sample, else zero) next to the mean embedding of its
character n-grams with word bounds, hashed. All windows of WINDOW words, one from every word on, are scored; the document's
score is that of its highest window. Training knows labels of documents only and takes windows at every TRAIN_STRIDE words:
first every window has its document's label, then the highest windows of each document learn; at last the logits are
shifted so that the threshold lies between the labels of the training documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.wordhash import Words, mix64, word_chunks

#: Scored is a window from every word on (STRIDE 1); training samples are cut at every TRAIN_STRIDE words.
WINDOW, STRIDE, TRAIN_STRIDE = 16, 1, 8
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 12, 6
INPUT = WORD_SIZE + CHAR_SIZE
GRAMS, GRAM_BUCKETS = (3, 4, 5), 1 << 15
#: Bounds of the training sample, the only rows a model is fitted on: documents of each label, characters of a document.
TRAIN_DOCS, TRAIN_CHARS = 900, 8_000
LEAST_USES = 6
#: Steps on all windows, then on each document's highest (of clean documents TOP); small samples take smaller batches.
STEPS_ALL, STEPS_TOP, TOP = 80, 110, 3
RATE, DECAY, BATCH, LEAST_BATCH = 0.01, 1e-5, 256, 48
THRESHOLD = 0.3
#: THRESHOLD is laid halfway between these quantiles of the clean and the toxic training documents, if they are apart.
CLEAN_QUANTILE, TOXIC_QUANTILE = 0.995, 0.05
SCORE_WINDOWS, SCORE_RUN = 1024, 2048
CHUNK_BYTES = 1_000_000

SCHEMA = "doc_id long, score double, n_windows long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_windows", pa.int64())])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


# --- inputs -----------------------------------------------------------------------------------------------------------


def gram_lists(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of the words at these places, and where each word's begin (n + 1)."""
    sizes = words.ends[first] - words.starts[first]
    bounds = np.concatenate(([0], np.cumsum(sizes + 2)))
    text = np.full(int(bounds[-1]), 1, np.uint64)  # bound, word, bound
    inside = np.ones(len(text), bool)
    inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
    offsets = np.arange(int(sizes.sum())) + np.repeat(words.starts[first] - (np.cumsum(sizes) - sizes), sizes)
    text[inside] = words.data[offsets]
    owner = np.repeat(np.arange(len(first)), sizes + 2)
    buckets, owners = [], []
    for order in GRAMS:
        if len(text) < order:
            continue
        code = np.zeros(len(text) - order + 1, np.uint64)
        for k in range(order):
            code = code * np.uint64(257) + text[k : len(code) + k]
        same = owner[: len(code)] == owner[order - 1 :]
        buckets.append((mix64(code[same] + np.uint64(order)) >> np.uint64(49)).astype(np.int64))
        owners.append(owner[: len(code)][same])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(first) + 1))


def windows_of(counts: np.ndarray, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word counted from the document's) of all windows; the last one ends with the document."""
    stride = stride or STRIDE
    more = np.maximum(0, -(-(counts - WINDOW) // stride))
    number = np.where(counts > 0, 1 + more, 0)
    docs = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(number) - number, number)
    return docs, np.minimum(nth * stride, np.maximum(counts[docs] - WINDOW, 0))


# --- network ----------------------------------------------------------------------------------------------------------


def initial(n_words: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"words": draw(n_words + 1, WORD_SIZE, scale=0.1), "grams": draw(GRAM_BUCKETS, CHAR_SIZE, scale=0.3)}
    p["words"][0] = 0  # any word outside the sample
    for way in "fb":
        p[f"W{way}"] = draw(INPUT, 3 * HIDDEN, scale=INPUT**-0.5)
        p[f"U{way}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        p[f"c{way}"] = np.zeros(3 * HIDDEN, np.float32)
        p[f"d{way}"] = np.zeros(HIDDEN, np.float32)
    p["attend"] = draw(2 * HIDDEN, scale=0.1)
    p["out"] = draw(2 * HIDDEN, scale=HIDDEN**-0.5)
    p["bias"] = np.full(1, -1.0, np.float32)
    return p


def recur(projected: np.ndarray, u: np.ndarray, d: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, window, HIDDEN) of one direction from projected inputs (time, window, 3 HIDDEN)."""
    time, n, _ = projected.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((time, n, HIDDEN), np.float32)
    steps = []
    for t in range(time):
        g = h @ u
        gates = sigmoid(projected[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = g[:, 2 * HIDDEN :] + d
        new = np.tanh(projected[t, :, 2 * HIDDEN :] + r * inner)
        if keep:
            steps.append((h, r, z, inner, new))
        h = new + z * (h - new)
        out[t] = h
    return out, steps


def back_recur(grad: np.ndarray, u: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of projected inputs, u and d from those of the hidden states."""
    du, dd = np.zeros_like(u), np.zeros(HIDDEN, np.float32)
    dp = np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32)
    carry = np.zeros_like(grad[0])
    for t in range(len(steps) - 1, -1, -1):
        h, r, z, inner, new = steps[t]
        dh = grad[t] + carry
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        di = dn * r
        dr = dn * inner * r * (1 - r)
        dp[t] = np.concatenate([dr, dz, dn], axis=1)
        dg = np.concatenate([dr, dz, di], axis=1)
        du += h.T @ dg
        dd += di.sum(axis=0)
        carry = dh * z + dg @ u.T
    return dp, du, dd


def pool(p: dict[str, np.ndarray], states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit of each window, attention (time, window) and the pooled states."""
    e = np.where(real, states @ p["attend"], -np.inf)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ p["out"] + p["bias"], a, pooled


def logits_of(p: dict[str, np.ndarray], table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logits of windows of word places (window, time; -1 for none); the table has both directions' projections."""
    table = np.concatenate([table, np.concatenate([p["cf"], p["cb"]])[None]])  # the last row is "no word"
    out = np.empty(len(index), np.float32)
    for low in range(0, len(index), SCORE_WINDOWS):
        some = index[low : low + SCORE_WINDOWS].T
        both = table[some]
        ahead, _ = recur(both[:, :, : 3 * HIDDEN], p["Uf"], p["df"], keep=False)
        back, _ = recur(both[::-1, :, 3 * HIDDEN :], p["Ub"], p["db"], keep=False)
        out[low : low + SCORE_WINDOWS] = pool(p, np.concatenate([ahead, back[::-1]], axis=2), some >= 0)[0]
    return out


def _logistic(minus: np.ndarray) -> None:
    """1 / (1 + exp(minus)) in place."""
    with np.errstate(over="ignore"):
        np.exp(minus, out=minus)
    minus += 1
    np.divide(1, minus, out=minus)


def run_logits(p: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of the windows from each word on of one run of words, as logits_of has them for whole windows.

    Features come first and windows last, so that the words of step t of neighbouring windows are one slice. Of the states
    only their products with attention and output are kept. Every gate is a logistic function of inputs scaled beforehand
    (tanh(x) is 2 sigmoid(2x) - 1), because numpy's exp is the cheaper one.
    """
    total = max(0, len(ids) - WINDOW + 1)
    out = np.empty(total, np.float32)
    scale = np.repeat(np.array([-1, -2], np.float32), [2 * HIDDEN, HIDDEN])
    scaled = table * np.tile(scale, 2)
    ways = []
    for k, way in enumerate("fb"):
        part = slice(k * HIDDEN, (k + 1) * HIDDEN)
        u = np.concatenate([p[f"U{way}"] * scale, p["attend"][part, None], p["out"][part, None]], axis=1)
        ways.append((np.ascontiguousarray(u.T), -2 * p[f"d{way}"][:, None]))
    for low in range(0, total, SCORE_RUN):
        n = min(SCORE_RUN, total - low)
        words = np.ascontiguousarray(scaled[ids[low : low + n + WINDOW - 1]].T)
        marks = np.zeros((WINDOW, 2, n), np.float32)  # attention and output products of each step
        for k, (u, d) in enumerate(ways):
            own = words[3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
            g, h = np.zeros((3 * HIDDEN + 2, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            gates, new = np.empty((2 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                x = own[:, t : t + n]
                np.add(x[: 2 * HIDDEN], g[: 2 * HIDDEN], out=gates)
                _logistic(gates)
                np.add(g[2 * HIDDEN : 3 * HIDDEN], d, out=new)
                new *= gates[:HIDDEN]
                new += x[2 * HIDDEN :]
                _logistic(new)
                new *= 2
                new -= 1
                h -= new
                h *= gates[HIDDEN:]
                h += new
                np.matmul(u, h, out=g)
                marks[t] += g[3 * HIDDEN :]
        e = np.exp(marks[:, 0] - marks[:, 0].max(axis=0))
        out[low : low + n] = np.einsum("tn,tn->n", e, marks[:, 1]) / e.sum(axis=0) + p["bias"]
    return out


@dataclass
class Corpus:
    """Distinct words of the training sample and all windows as places in them."""

    hashes: np.ndarray  # sorted, of the distinct words
    grams: np.ndarray
    bounds: np.ndarray
    place: np.ndarray  # row of p["words"] of each distinct word
    index: np.ndarray  # windows x WINDOW, -1 for none
    doc: np.ndarray  # of each window


def inputs_of(p: dict[str, np.ndarray], place: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    counts = np.diff(bounds).astype(np.float32)
    mean = np.add.reduceat(p["grams"][grams], bounds[:-1], axis=0) / counts[:, None]
    return np.concatenate([p["words"][place], mean], axis=1)


def window_index(starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the windows and their words' ids, -1 past the end; ``starts`` is each document's first word."""
    docs, first = windows_of(counts, stride)
    at = first[:, None] + np.arange(WINDOW)
    real = at < counts[docs][:, None]
    index = np.where(real, ids[np.minimum(starts[docs][:, None] + at, max(len(ids) - 1, 0))], -1) if len(docs) else np.empty((0, WINDOW), np.int64)
    return docs, index


def read_sample(texts: list[str]) -> Corpus:
    (words,) = word_chunks(pa.array(texts, pa.large_string()), limit=sum(len(t.encode()) for t in texts))
    hashes, first, ids, uses = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    grams, bounds = gram_lists(words, first)
    common = uses >= LEAST_USES
    counts = words.per_doc()
    docs, index = window_index(np.cumsum(counts) - counts, counts, ids, TRAIN_STRIDE)
    return Corpus(hashes, grams, bounds, np.where(common, np.cumsum(common), 0), index, docs)


@dataclass
class ToxicityModel:
    p: dict[str, np.ndarray]
    known: np.ndarray  # sorted hashes of the words with an embedding
    rows: np.ndarray  # their rows in p["words"]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Trainer:
    def __init__(self, corpus: Corpus, labels: np.ndarray, seed: int = 7):
        self.c, self.labels = corpus, labels.astype(np.float32)
        self.p = initial(int(corpus.place.max(initial=0)), seed)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0
        self.rng = np.random.default_rng(seed)

    def gradients(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of these windows with their documents' labels."""
        p, c = self.p, self.c
        ids, index = np.unique(c.index[windows].T, return_inverse=True)
        none = bool(ids[0] < 0)
        ids = ids[1:] if none else ids
        index = index.reshape(WINDOW, len(windows)) - none
        lengths = np.diff(c.bounds)[ids]
        flat = np.arange(int(lengths.sum())) + np.repeat(c.bounds[:-1][ids] - (np.cumsum(lengths) - lengths), lengths)
        grams, bounds = c.grams[flat], np.concatenate(([0], np.cumsum(lengths)))
        x = inputs_of(p, c.place[ids], grams, bounds)
        table = np.concatenate([x, np.zeros((1, INPUT), np.float32)])  # -1 is the last row
        states, kept = [], {}
        for way in "fb":
            inputs = (table @ p[f"W{way}"] + p[f"c{way}"])[index]
            h, steps = recur(inputs[:: 1 if way == "f" else -1], p[f"U{way}"], p[f"d{way}"], keep=True)
            states.append(h[:: 1 if way == "f" else -1])
            kept[way] = steps
        states = np.concatenate(states, axis=2)
        logit, a, pooled = pool(p, states, index >= 0)
        delta = (sigmoid(logit) - self.labels[c.doc[windows]]) / np.float32(len(windows))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = pooled.T @ delta
        g["bias"][0] = delta.sum()
        dpool = delta[:, None] * p["out"]
        da = np.einsum("tnh,nh->tn", states, dpool)
        de = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", de, states)
        dstates = a[:, :, None] * dpool + de[:, :, None] * p["attend"]
        dtable = np.zeros_like(table)
        flat_index = index.ravel()
        for way, part in (("f", dstates[:, :, :HIDDEN]), ("b", dstates[:, :, HIDDEN:])):
            turn = slice(None, None, 1 if way == "f" else -1)
            dp, g[f"U{way}"], g[f"d{way}"] = back_recur(part[turn], p[f"U{way}"], kept[way])
            dp = dp[turn].reshape(-1, 3 * HIDDEN)
            sums = np.zeros((len(table), 3 * HIDDEN), np.float32)
            np.add.at(sums, flat_index, dp)
            g[f"W{way}"] = table.T @ sums
            g[f"c{way}"] = dp.sum(axis=0)
            dtable += sums @ p[f"W{way}"].T
        dx = dtable[:-1]
        np.add.at(g["words"], c.place[ids], dx[:, :WORD_SIZE])
        g["words"][0] = 0
        np.add.at(g["grams"], grams, np.repeat(dx[:, WORD_SIZE:] / lengths[:, None].astype(np.float32), lengths, axis=0))
        return g

    def step(self, windows: np.ndarray) -> None:
        self.steps += 1
        for k, g in self.gradients(windows).items():
            g += DECAY * self.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)

    def logits(self) -> np.ndarray:
        p, c = self.p, self.c
        return logits_of(p, project(p, inputs_of(p, c.place, c.grams, c.bounds)), c.index)

    def train(self) -> None:
        while self.steps < STEPS_ALL + STEPS_TOP:
            chosen = np.arange(len(self.c.doc))
            if self.steps >= STEPS_ALL:
                order = np.lexsort((-self.logits(), self.c.doc))
                nth = np.arange(len(order)) - np.searchsorted(self.c.doc[order], self.c.doc[order])
                top = np.where(self.labels[self.c.doc[order]] > 0, 1, TOP)
                chosen = order[nth < top]
            else:  # as many of either label
                yes = chosen[self.labels[self.c.doc] > 0]
                no = chosen[self.labels[self.c.doc] == 0]
                n = min(len(yes), len(no), 12 * BATCH)
                chosen = np.concatenate([self.rng.permutation(yes)[:n], self.rng.permutation(no)[:n]])
            chosen = self.rng.permutation(chosen)
            size = max(LEAST_BATCH, min(BATCH, len(chosen) // 8))
            for low in range(0, len(chosen), size):
                self.step(chosen[low : low + size])


def project(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Both directions' projected inputs of each word."""
    return x @ np.concatenate([p["Wf"], p["Wb"]], axis=1) + np.concatenate([p["cf"], p["cb"]])


def fit_rows(rows: list[tuple[str, int]], seed: int = 7) -> ToxicityModel | None:
    """Fits on (text, label) rows in the order given; None without a text of either label."""
    rows = [(t, y) for t, y in rows if t and t.strip()]
    if len({y for _, y in rows}) < 2:
        return None
    corpus = read_sample([t for t, _ in rows])
    if len(corpus.doc) == 0:
        return None
    trainer = Trainer(corpus, np.array([y for _, y in rows]), seed)
    trainer.train()
    has = corpus.place > 0
    model = ToxicityModel(trainer.p, corpus.hashes[has], corpus.place[has])
    set_operating_point(model, rows)
    return model


def set_operating_point(model: ToxicityModel, rows: list[tuple[str, int]]) -> None:
    """Shifts all logits alike, so that THRESHOLD lies between the labels of the training documents; order stays."""
    scores, _ = score_column(pa.array([t for t, _ in rows], pa.large_string()), model)
    logits = np.log(np.maximum(scores, 1e-9)) - np.log(np.maximum(1 - scores, 1e-9))
    toxic = np.array([y for _, y in rows]) > 0
    low, high = np.quantile(logits[~toxic], CLEAN_QUANTILE), np.quantile(logits[toxic], TOXIC_QUANTILE)
    if low < high:
        model.p["bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - (low + high) / 2)


# --- Spark ------------------------------------------------------------------------------------------------------------


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """True for the documents whose labels no model may learn: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The sample: TRAIN_DOCS documents of each label, by hash of the id, of at most TRAIN_CHARS characters."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    spare = 2 * TRAIN_DOCS  # some are too long or have no text
    few = [usable.where(F.col("toxic") == y).distinct().orderBy(key, "doc_id").limit(spare) for y in (0, 1)]
    few = few[0].union(few[1])  # a bounded number of ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.where(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(few), "doc_id")
    rows = found.select(key.alias("h"), "doc_id", "toxic", "text").distinct().collect()
    out: list[tuple[str, int]] = []
    taken = {0: 0, 1: 0}
    for _, _, label, text in sorted(map(tuple, rows)):
        if taken[label] < TRAIN_DOCS:
            taken[label] += 1
            out.append((text, label))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    return fit_rows(training_rows(docs, labels))


def score_column(column: pa.Array, model: ToxicityModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text; 0 and 0 for a text without words, 0 without a model."""
    scores, counts = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for words in word_chunks(column, CHUNK_BYTES):
        if len(words.hashes) == 0:
            continue
        code = pa.array(words.hashes).dictionary_encode().indices.to_numpy()
        first = np.zeros(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        per_doc = words.per_doc()
        counts[words.first : words.first + words.n_docs] = np.where(per_doc > 0, np.maximum(1, per_doc - WINDOW + 1), 0)
        if model is None:
            continue
        at = np.minimum(np.searchsorted(model.known, words.hashes[first]), max(len(model.known) - 1, 0))
        place = np.where(model.known[at] == words.hashes[first], model.rows[at], 0) if len(model.known) else np.zeros(len(first), np.int64)
        table = project(model.p, inputs_of(model.p, place, *gram_lists(words, first)))
        best = np.full(words.n_docs, -np.inf)
        short = np.where(per_doc < WINDOW, per_doc, 0)
        docs, index = window_index(np.cumsum(per_doc) - per_doc, short, code, STRIDE)
        best[docs] = logits_of(model.p, table, index)
        logits = run_logits(model.p, table, code)
        whole = words.docs[: len(logits)] == words.docs[WINDOW - 1 :]  # others would run over a document's end
        np.maximum.at(best, words.docs[: len(logits)][whole], logits[whole])
        scores[words.first : words.first + words.n_docs] = np.where(np.isfinite(best), sigmoid(best), 0)
    return scores, counts


def toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per document row: doc_id, score (0 to 1), n_windows. Texts are read whole, in all windows.

    Reads doc_id and text alone, whatever other columns are called. Null texts and texts without words score 0, as does
    everything where there was nothing to learn from. Repeated rows give repeated rows, an empty table none.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = score_column(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores), pa.array(counts)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
