"""Language ID with string kernels: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

Texts are lower-cased and each letter of the training texts is a symbol of its own (16 bits, so that four fit 64; letters
beyond the 65,534 commonest would share one), a letter they do not have is "any other letter" and a run of anything else
one separator. The feature set of a text is the set of its n-grams of one
to four symbols that occur in some landmark; the kernel of two texts is the size of the common part over the geometric
mean of both sizes. Because a prediction is linear in the kernel row, presence vectors are multiplied, some hundred texts
at a time, with one precomputed matrix of n-grams by languages.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.held import held

#: Bounds of the training sample, the only rows a model is fitted on: rows of each language, letters of a row.
TRAIN_PER_LANGUAGE = 400
TRAIN_CHARS = 20_000
LANDMARKS_PER_LANGUAGE = 60
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-3
SYMBOLS = 1 << 16
OTHER, GAP = 0, 1
BATCH_TEXTS, BATCH_CHARS = 128, 500_000
UNDETERMINED = "und"

LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class LanguageModel:
    languages: list[str]  # the commonest first
    alphabet: str
    grams: list[np.ndarray]  # per order, the sorted codes of the n-grams in use
    weights: np.ndarray  # n-grams x languages, float32
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class _Places:
    """Columns of n-gram codes: buckets of a hash, sorted, with the first code of each bucket."""

    def __init__(self, codes: np.ndarray, first: int):
        codes = codes.astype(np.uint64)
        bits = len(codes).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        bucket = self.bucket(codes)
        order = np.argsort(bucket, kind="stable")
        self.codes, self.columns, bucket = codes[order], order + first, bucket[order]
        self.start = np.full(1 << bits, -1, np.int32)
        self.start[bucket[::-1]] = np.arange(len(codes), dtype=np.int32)[::-1]
        sizes = np.bincount(bucket, minlength=1 << bits)
        self.size, self.most = sizes.astype(np.uint8 if sizes.max() < 256 else np.int32), int(sizes.max())

    def bucket(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Columns of the known codes and where those are, in one part per place in a bucket."""
        bucket = self.bucket(codes)
        start = self.start[bucket]
        where = np.flatnonzero(start >= 0)
        start, bucket = start[where], bucket[where]
        for k in range(self.most):
            same = self.codes[start + k] == codes[where]
            yield self.columns[start[same] + k], where[same]
            left = ~same & (self.size[bucket] > k + 1)
            start, bucket, where = start[left], bucket[left], where[left]


class Featurizer:
    """Presence vectors of texts over a fixed alphabet and n-gram set; n-grams are found by hash and compared whole."""

    def __init__(self, alphabet: str, grams: list[np.ndarray] | None = None):
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[:] = GAP
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.symbol[letters] = OTHER
        for k, letter in enumerate(alphabet):
            self.symbol[ord(letter)] = k + 2
        self.grams = grams
        if grams is not None:
            self.place, n = [], 0
            for codes in grams:
                self.place.append(_Places(codes, n))
                n += len(codes)
            self.size = n

    def codes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per order, the codes of all n-grams of the texts and the text of each."""
        points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points])
        docs = np.repeat(np.arange(len(texts)), sizes)
        symbols = self.symbol[np.concatenate(points)] if len(points) else np.empty(0, np.uint16)
        if len(symbols) == 0:
            return
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP) | (docs[1:] != docs[:-1])
        symbols, docs = symbols[keep].astype(np.uint64), docs[keep]
        code = symbols
        for order in ORDERS:
            if order > 1:
                if len(symbols) < order:
                    return
                code = code[:-1] * np.uint64(SYMBOLS) + symbols[order - 1 :]
            same = docs[: len(code)] == docs[order - 1 :]
            yield (code, docs[: len(code)]) if order == 1 else (code[same], docs[: len(code)][same])

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts x n-grams, 0 or 1."""
        out = np.zeros((len(texts), self.size), np.uint8)
        for (code, docs), place in zip(self.codes(texts), self.place):
            for at, known in place.find(code):
                out[docs[known], at] = 1
        return out.astype(np.float32)


def text_batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    low = 0
    while low < len(texts):
        high, chars = low, 0
        while high < len(texts) and high - low < BATCH_TEXTS and (high == low or chars + len(texts[high]) <= BATCH_CHARS):
            chars += len(texts[high])
            high += 1
        yield low, texts[low:high]
        low = high


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.outer(left.sum(axis=1), right.sum(axis=1)))
    return (left @ right.T) / np.maximum(norms, 1)


def fit_rows(rows: list[tuple[str, str]]) -> LanguageModel | None:
    """Fits on (text, language) rows in the order given; None where there is no row to learn from."""
    rows = [(t, lang) for t, lang in rows if LETTER.search(t)]
    if not rows:
        return None
    counts = Counter(lang for _, lang in rows)
    languages = sorted(counts, key=lambda lang: (-counts[lang], lang))
    letters = Counter(c for t, _ in rows for c in set(t.lower()) if c.isalpha())
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2])
    taken: Counter = Counter()
    landmarks = []
    for text, lang in rows:
        if taken[lang] < LANDMARKS_PER_LANGUAGE:
            taken[lang] += 1
            landmarks.append(text)
    seen: list[list[np.ndarray]] = [[] for _ in ORDERS]
    plain = Featurizer(alphabet)
    for _, some in text_batches(landmarks):
        for k, (code, _) in enumerate(plain.codes(some)):
            seen[k].append(np.unique(code))
    grams = [np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in seen]
    features = Featurizer(alphabet, grams)
    marks = np.concatenate([features.presence(some) for _, some in text_batches(landmarks)])
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # landmarks x rank
    texts = [t for t, _ in rows]
    mapped = np.concatenate([_kernel(features.presence(s), marks).astype(np.float64) @ root for _, s in text_batches(texts)])
    target = np.array([[lang == known for known in languages] for _, lang in rows], np.float64)
    balance = np.array([len(rows) / (len(languages) * counts[lang]) for _, lang in rows])[:, None]
    normal = mapped.T @ (mapped * balance) + RIDGE * len(rows) * np.eye(mapped.shape[1])
    solved = root @ np.linalg.solve(normal, mapped.T @ (target * balance))  # landmarks x languages
    weights = marks.T @ (solved / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None])
    return LanguageModel(languages, alphabet, grams, weights.astype(np.float32))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The sample: TRAIN_PER_LANGUAGE rows of each language by hash; needs doc_id, text, lang.

    Languages are counted first, so that the rows are found by a filter on their hash and no language meets in one task.
    """
    lang = F.col("lang").cast("string")
    usable = docs.select(F.col("text").cast("string"), lang, F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    usable = usable.where(F.col("lang").isNotNull() & F.length("text").between(1, TRAIN_CHARS))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for name, n in counts.items():  # a few standard deviations more than needed; the rest goes below
        share = min(1.0, (TRAIN_PER_LANGUAGE + 5 * TRAIN_PER_LANGUAGE**0.5) / n)
        limit = F.when(F.col("lang") == name, int(share * (1 << 40))).otherwise(limit)
    rows = usable.where(F.col("h") < limit).select("h", "lang", "text").collect()
    taken: Counter = Counter()
    out = []
    for _, name, text in sorted(set(map(tuple, rows))):
        taken[name] += 1
        if taken[name] <= TRAIN_PER_LANGUAGE:
            out.append((text, name))
    return out


def predict_texts(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    """Language and score of each text. No letter: und, 0. No known n-gram: the commonest language, 0."""
    if model is None:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    features = held(("features", model.key), lambda: Featurizer(model.alphabet, model.grams))
    langs, scores = [], []
    for _, some in text_batches([t or "" for t in texts]):
        present = features.presence(some)
        values = (present @ model.weights) / np.sqrt(np.maximum(present.sum(axis=1), 1))[:, None]
        best = values.argmax(axis=1)
        for text, k, row in zip(some, best.tolist(), values):
            lettered = LETTER.search(text) is not None
            langs.append(model.languages[k] if lettered else UNDETERMINED)
            scores.append(float(min(1.0, max(0.0, row[k]))) if lettered else 0.0)
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score (0 to 1); texts are read whole.

    Reads doc_id and text alone. Null texts and texts without a letter are "und"; without any training row every text
    is. Repeated rows give repeated rows, an empty table none.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_texts(batch.column(1).to_pylist(), shared.value)
            cells = [batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents, with their columns, whose language is not undetermined; decided where the row is."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def determined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _ = predict_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value)
            yield batch.filter(pa.array([lang != UNDETERMINED for lang in langs], pa.bool_()))

    return docs.mapInArrow(determined, docs.schema)


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1):
    """True for the documents that no model may learn from: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel | None:
    """A model of the documents that are not held out; rows without an id or a language are not learnt from."""
    return fit_rows(training_rows(docs.where(docs["doc_id"].isNotNull() & ~held_out(docs))))
