"""Ranked lexical search over a K2-treap: a compressed quadtree of the term-document grid whose cells store impact maxima.

Documents are indexed where they are read, in blocks of bounded text. In a block every term is a row and every document a
column of a grid; the rows go from common to rare terms, the columns from short to long documents. The grid is a quadtree:
of every level only cells with an entry are kept, in Z-order, each with a mask of its quarters and the largest impact below
it. The children of a cell follow one another in the next level, so masks alone give all links.

An item walks down the paths of its rows jointly: a node is a range of documents with one cell per row, its bound the
weighted sum of these cells' maxima. Nodes are opened best bound first, some at a time, and a node whose bound is below the
score in place k is never opened. At a single document the bound is the score.

The impact of a term in a document depends on the corpus's averages alone, its weight on its document frequency; both are
exact over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.scratch import Stored, store
from cardmill.llm.wordhash import BYTE_TABLE, SPACE, doc_chunks, text_buffers
from cardmill.session import LARGE_ROWS

TOP = 50
#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 3_000_000
#: Text bytes of the items that are broadcast at a time; a longer item goes alone.
QUERY_BYTES = 4_000_000
#: Nodes opened at a time.
OPENED = 64
SALTS = 64

BLOCKS = "doc_ids array<long>, terms binary, df binary, height int, masks binary, best binary"
FOUND = "q long, doc_id long, score long"
_ARROW_BLOCKS = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("df", pa.binary()),
        ("height", pa.int32()),
        ("masks", pa.binary()),
        ("best", pa.binary()),
    ]
)
_ARROW_FOUND = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
#: Quarters of a cell that come before quarter q, by mask and q, and quarters in all.
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)
_QUARTERS = np.array([bin(m).count("1") for m in range(16)], np.int64)


def _word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of texts (n + 1 bounds), and where each of their terms begins and ends."""
    own = BYTE_TABLE[data]
    inside = own != SPACE
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(own)]] = False  # terms end with their text
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return own, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts as a dictionary array of bytes, and the text of each."""
    own, starts, ends = _word_bounds(data, bounds)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    joined = own[own != SPACE]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)]
    )
    return words.dictionary_encode(), np.searchsorted(bounds, starts, "right") - 1


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in doc_chunks(offsets):
                bounds = offsets[low : high + 1] - offsets[low]
                _, starts, _ = _word_bounds(data[offsets[low] : offsets[high]], bounds)
                n_docs += len(np.unique(np.searchsorted(bounds, starts, "right")))
                n_terms += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], ["n_docs", "n_terms"])

    sizes = docs.select(F.col("text").cast("string")).mapInArrow(run, "n_docs long, n_terms long")
    found = sizes.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impact of a term that occurs ``tf`` times among ``n`` terms of its document."""
    if len(n) and 50 * int(n.max()) * n_docs >= 2**63:
        ratio = np.array([50 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        ratio = 50 * n * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + ratio))


def _interleave(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    """Z-order: the bits of row and column in turn, the row's first."""
    code = np.zeros(len(rows), np.int64)
    for bit in range(height):
        code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
    return code


def quadtree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of all cells above the entries and maxima of all cells, level after level from the whole grid down."""
    code = _interleave(rows, columns, height)
    order = np.argsort(code)
    code, best = code[order], values[order].astype(np.int32)
    masks, maxima = [], [best]
    for _ in range(height):
        starts = np.flatnonzero(np.concatenate(([True], code[1:] >> 2 != code[:-1] >> 2)))
        masks.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), starts))
        best = np.maximum.reduceat(best, starts)
        code = code[starts] >> 2
        maxima.append(best)
    return np.concatenate([np.empty(0, np.uint8), *masks[::-1]]), np.concatenate(maxima[::-1])


def _block(ids: list[int | None], data: np.ndarray, bounds: np.ndarray, n_docs: int, n_terms: int) -> dict | None:
    """The treap of some whole documents; None if they hold no term."""
    words, docs = _terms(data, bounds)
    if len(docs) == 0:
        return None
    n = np.bincount(docs, minlength=len(ids))
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    column_of = np.full(len(ids), -1)
    column_of[used] = np.arange(len(used))
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(used) + column_of[docs], return_counts=True)
    term, column = pairs // len(used), pairs % len(used)
    df = np.bincount(term)
    order = np.argsort(-df, kind="stable")
    row_of = np.empty_like(order)
    row_of[order] = np.arange(len(order))
    height = max(len(order) - 1, len(used) - 1).bit_length()
    masks, best = quadtree(row_of[term], column, impacts(tf, n[used][column], n_docs, n_terms), height)
    return {
        "doc_ids": [ids[i] for i in used.tolist()],
        "terms": b" ".join(words.dictionary.take(pa.array(order)).to_pylist()),
        "df": df[order].astype("<i4").tobytes(),
        "height": height,
        "masks": masks.tobytes(),
        "best": best.astype("<i4").tobytes(),
    }


@dataclass
class Index:
    """Stored blocks, and the sizes of the corpus that their impacts are measured by."""

    blocks: Stored
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    """Indexes every document with a term; ``docs`` needs doc_id and text."""
    n_docs, n_terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            bounds = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            block = _block(ids, np.concatenate(parts), bounds, n_docs, n_terms)
            if block:
                yield pa.RecordBatch.from_pylist([block], schema=_ARROW_BLOCKS)

        held = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for low, high in doc_chunks(offsets, BLOCK_BYTES):
                size = int(offsets[high] - offsets[low])
                if ids and held + size > BLOCK_BYTES:
                    yield from close()
                    ids, parts, lengths, held = [], [], [], 0
                ids += batch.column(0).slice(low, high - low).to_pylist()
                parts.append(data[offsets[low] : offsets[high]])
                lengths.append(np.diff(offsets[low : high + 1]))
                held += size
        if ids:
            yield from close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return Index(store(rows.mapInArrow(run, BLOCKS), "treap", **LARGE_ROWS), n_docs, n_terms)


class Treap:
    """A block read back; cell 0 stands for an empty cell, the whole grid is cell 1."""

    def __init__(self, doc_ids: list[int | None], height: int, masks: bytes, best: bytes):
        self.doc_ids = doc_ids
        self.height = height
        self.best = np.concatenate((np.zeros(1, np.int32), np.frombuffer(best, "<i4")))
        inner = np.frombuffer(masks, np.uint8)
        self.mask = np.zeros(len(self.best), np.uint8)
        self.mask[1 : 1 + len(inner)] = inner
        quarters = _QUARTERS[self.mask]
        self.first = (np.cumsum(quarters) - quarters + 2).astype(np.int32)

    def _open(self, cells: np.ndarray, row_bits: np.ndarray, right: int) -> np.ndarray:
        quarter = 2 * row_bits + right
        mask = self.mask[cells]
        there = (mask >> quarter) & 1
        return np.where(there, self.first[cells] + _BEFORE[mask, quarter], 0)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offers every document that may be among the best; the number of opened nodes."""
        cells = np.ones((1, len(rows)), np.int64)
        bound = self.best[cells] @ weights
        column = np.zeros(1, np.int64)
        level = np.zeros(1, np.int64)
        opened = 0
        while True:
            alive = bound >= max(best.least, 1)
            if not alive.all():
                cells, bound, column, level = cells[alive], bound[alive], column[alive], level[alive]
            if len(bound) == 0:
                return opened
            if len(bound) > OPENED:
                split = np.argpartition(-bound, OPENED)
                now, later = split[:OPENED], split[OPENED:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            leaf = level[now] == self.height
            if leaf.any():
                at = now[leaf]
                best.offer(bound[at], [self.doc_ids[c] for c in column[at].tolist()])
            now = now[~leaf]
            opened += len(now)
            bits = (rows[None, :] >> (self.height - 1 - level[now])[:, None]) & 1
            both = [self._open(cells[now], bits, right) for right in (0, 1)]
            cells = np.concatenate([cells[later], *both])
            bound = np.concatenate([bound[later], *(self.best[c] @ weights for c in both)])
            column = np.concatenate([column[later], 2 * column[now], 2 * column[now] + 1])
            level = np.concatenate([level[later], level[now] + 1, level[now] + 1])


class Best:
    """The k best documents so far: higher scores first, among equals smaller ids, ids that are null last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, bool, int]] = []  # negative score, id is null, id
        self.least = 0  # a lower score cannot be among the best

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.rows += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids) if s >= self.least]
        if len(self.rows) >= self.k:
            self.rows = sorted(self.rows)[: self.k]
            self.least = -self.rows[-1][0]


def _item_terms(items: DataFrame) -> DataFrame:
    """(q, item_id, terms): a number for every row, and its distinct terms joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            terms = []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = _terms(np.frombuffer(raw[low:high], np.uint8), np.array([0, high - low]))[0].dictionary
                terms.append(b" ".join(found.to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], ["q", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("q"), "item_id", F.col("text").cast("string").alias("text"))
    numbered = store(numbered, "items").df  # numbers must not change when a task is run again
    return numbered.select("q", "item_id"), numbered.select("q", "text").mapInArrow(run, "q long, terms binary")


def _query_batches(terms: DataFrame, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with terms in lists of at most ``limit`` bytes; one partition and one list are in memory at a time."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for row in terms.where(F.length("terms") > 0).toLocalIterator():
        if held and size + len(row["terms"]) > limit:
            yield held
            held, size = [], 0
        held.append((row["q"], bytes(row["terms"]).split(b" ")))
        size += len(row["terms"])
    if held:
        yield held


def _document_frequencies(index: Index, terms: list[bytes]) -> dict[bytes, int]:
    """Documents of the corpus that hold each of the terms."""
    wanted = index.blocks.df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(wanted.value, pa.binary())
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for words, df in zip(batch.column(0), batch.column(1)):
                place = pc.index_in(asked, value_set=pa.array(words.as_py().split(b" "), pa.binary()))
                known = np.flatnonzero(place.is_valid())
                total[known] += np.frombuffer(df.as_py(), "<i4")[place.drop_null().to_numpy()]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["t", "df"])

    rows = index.blocks.df.select("terms", "df").mapInArrow(run, "t long, df long")
    return {terms[r["t"]]: r["df"] for r in rows.groupBy("t").agg(F.sum("df").alias("df")).collect()}


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_blocks(index: Index, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(q, doc_id, score): the best k of each task for each item of one batch."""
    df = _document_frequencies(index, sorted({t for _, terms in items for t in terms}))
    heavy = {t: w for t, n in df.items() if (w := weight(n, index.n_docs)) > 0}
    number = {t: i for i, t in enumerate(heavy)}
    asked = [(q, np.array([number[t] for t in terms if t in number], np.int64)) for q, terms in items]
    shared = index.blocks.df.sparkSession.sparkContext.broadcast((list(heavy), np.array(list(heavy.values()), np.int64), asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        known, weights, asked = shared.value
        for batch in batches:
            for block in range(batch.num_rows):
                ids, words, height, masks, maxima = (c[block].as_py() for c in batch.columns)
                place = pc.index_in(pa.array(known, pa.binary()), value_set=pa.array(words.split(b" "), pa.binary()))
                row_of = pc.fill_null(place, -1).to_numpy()
                treap = Treap(ids, height, masks, maxima)
                for q, terms in asked:
                    rows = row_of[terms]
                    if (here := rows >= 0).any():
                        treap.search(rows[here].astype(np.int64), weights[terms[here]], best.setdefault(q, Best(k)))
        out = [(q, None if void else i, -s) for q, b in best.items() for s, void, i in sorted(b.rows)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [[]] * 3, schema=_ARROW_FOUND)

    columns = index.blocks.df.select("doc_ids", "terms", "height", "masks", "best")
    return columns.mapInArrow(run, FOUND)


def search(index: Index, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item row's k best documents with a score above 0, all if there are fewer.

    ``items`` needs item_id and text, the indexed documents doc_id and text; other columns are ignored whatever their
    names. Null texts and texts without a term have no terms: such items have no rows, such documents are never found.
    Equal scores go by smaller doc_id, null ids last; repeated document rows are documents of their own, repeated item rows
    items of their own. Empty tables give no rows. Long texts are taken whole.
    """
    numbers, terms = _item_terms(items)
    found: DataFrame | None = None
    for batch in _query_batches(terms, query_bytes):
        part = store(_search_blocks(index, batch, k), "hits").df
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = index.blocks.df.sparkSession.createDataFrame([], FOUND)
    for keys in (["q", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["q"]):  # one item's hits of very many tasks
        place = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return found.join(numbers, "q").select("item_id", "rank", "doc_id", "score")
