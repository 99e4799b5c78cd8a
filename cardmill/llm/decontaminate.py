"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items.

Texts and items are normalised alike (A-Z lower-cased, words joined by one space); a pattern is a window of words with a
space at either end, so it only matches whole words. A text is scanned once. Hits are counted in words and mapped back
to code points of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.held import held
from cardmill.llm.wordhash import TRANSLATION

WINDOW = 10
#: Pattern bytes of one automaton. A larger benchmark is dealt to several automata, scanned one after the other.
AUTOMATON_BYTES = 24_000_000

SCHEMA = (
    "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; none for a null text."""
    return (text or "").encode("utf-8", "replace").translate(TRANSLATION).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Each ``size`` consecutive words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window with the sorted ids of the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wins = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(windows_of(words_of(text), size))
                ids += [item] * len(found)
                wins += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], ["item", "win"])

    cuts = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        cut, "item string, win binary"
    )
    return cuts.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _shards(windows: DataFrame, limit: int) -> list[tuple[str, Broadcast]]:
    """The windows as broadcasts of at most about ``limit`` pattern bytes each; one unless the benchmark is huge."""
    spark = windows.sparkSession
    total = windows.agg(F.sum(F.length("win") + F.size("items") * 24)).first()[0] or 0
    n = -(-total // limit) or 1
    out = []
    for k in range(n):
        rows = windows.where(F.pmod(F.xxhash64("win"), F.lit(n)) == k).collect()
        shard = spark.sparkContext.broadcast([(bytes(r["win"]), tuple(r["items"])) for r in rows])
        out.append((uuid.uuid4().hex, shard))
    return out


def _automaton(shard: tuple[str, Broadcast]) -> ahocorasick.Automaton:
    """Built once per worker process; only the latest is kept."""
    key, windows = shard

    def build() -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for win, items in windows.value:
            automaton.add_word(f" {win.decode('latin-1')} ", (win.count(b" ") + 1, items))
        automaton.make_automaton()
        return automaton

    return held(("windows", key), build)


def scan(text: str | None, automata: list[ahocorasick.Automaton]) -> tuple[int, int, list[str], list[dict]]:
    """Words, hit words, items with hits, and runs of hit words as code point spans of the text."""
    raw = (text or "").encode("utf-8", "replace")
    spaced = raw.translate(TRANSLATION)
    words = spaced.split()
    joined = b" " + b" ".join(words) + b" "
    as_text = joined.decode("latin-1")
    found: set[str] = set()
    hits: list[tuple[int, int]] = []
    for automaton in automata:
        if len(automaton):
            for end, (n, items) in automaton.iter(as_text):
                hits.append((end, n))
                found.update(items)
    if not hits:
        return len(words), 0, [], []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for end, n in set(hits):
        last = int(np.searchsorted(gaps, end))  # the space after the window is the gap after its last word
        marks[last - n] += 1
        marks[last] -= 1
    hit = np.cumsum(marks)[:-1] > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    inside = np.concatenate(([False], np.frombuffer(spaced, np.uint8) != 32, [False]))
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    spans = [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last)]
    return len(words), int(hit.sum()), sorted(x for x in found if x is not None), spans


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids (sorted as strings), spans (original code points).

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored whatever their names. Null
    text has no words. Repeated rows give repeated rows; items with equal windows are all listed. An item without an id
    hits words but is not listed. Empty tables give no row, or no hit. Long texts are scanned whole.
    """
    shards = _shards(item_windows(items, window), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [scan(t, [_automaton(shards[0])]) for t in texts] if len(shards) == 1 else _scan_all(texts, shards)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(_ARROW)[1:]))],
                schema=_ARROW,
            ) if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _scan_all(texts: list[str | None], shards: list[tuple[str, Broadcast]]) -> list[tuple]:
    """Several automata, one in memory at a time; their hits on a text are united."""
    parts = [[scan(t, [_automaton(shard)]) for t in texts] for shard in shards]
    out = []
    for text, *seen in zip(texts, *parts):
        n_words = seen[0][0]
        items = sorted({i for s in seen for i in s[2]})
        spans = _united([(x["start"], x["end"]) for s in seen for x in s[3]], text or "")
        n_hit = sum(len(words_of((text or "")[a:b])) for a, b in spans)
        out.append((n_words, n_hit, items, [{"start": a, "end": b} for a, b in spans]))
    return out


def _united(spans: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and (start <= out[-1][1] or not words_of(text[out[-1][1] : start])):
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents that no test item occurs in, with their columns; a null text is clean. Decided where the row is."""
    shards = _shards(item_windows(items, window), limit)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            hit = np.zeros(len(texts), bool)
            for shard in shards:
                hit |= np.fromiter((scan(t, [_automaton(shard)])[1] > 0 for t in texts), bool, len(texts))
            yield batch.filter(pa.array(~hit))

    return docs.mapInArrow(clean, docs.schema)
