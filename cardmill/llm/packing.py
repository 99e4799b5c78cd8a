"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens, dot-product heuristic.

A bin takes, as long as any fits, the example with the largest dot product of its demand and the bin's remaining room,
both as shares of the limits. Where examples may be cut, what room is left then takes the head of one more example. Each
task packs what it reads, a bounded pool at a time, so nothing is shuffled and a long or repeated text is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tokens import encoder

CAPACITY = 2048
MAX_SEGMENTS = 256
POOL = 1024
#: Pieces and bytes of one output batch.
BATCH_PIECES, BATCH_BYTES = 4_000, 4_000_000


@dataclass
class Example:
    key: int | None
    ids: np.ndarray  # uint32
    loss: np.ndarray  # bool: this token bears loss
    at: int = 0  # ids before this one are placed


class Packer:
    """Fills bins from a pool of examples. ``put`` and ``flush`` give the pieces of every bin that is complete:
    (example, start, length, bin, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, pool: int = POOL):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.cut = cut
        self.size = pool
        self.pool: list[Example | None] = [None] * pool
        self.demand = np.full((pool, 3), np.inf)
        self.free = list(range(pool))[::-1]
        self.bins = 0

    def put(self, example: Example) -> Iterator[tuple[Example, int, int, int, int]]:
        full = int(self.limits[0])
        if self.cut:
            whole = example.loss.all() and self.limits[2] >= full
            while whole and len(example.ids) - example.at >= full:  # a bin of its own
                yield example, example.at, full, self.bins, 0
                self.bins += 1
                example.at += full
        elif len(example.ids) > full or example.loss.sum() > self.limits[2]:
            raise ValueError("an example that may not be cut exceeds the limits of a sequence")
        if len(example.ids) > example.at:
            while not self.free:
                yield from self._fill()
            self._keep(example)

    def flush(self) -> Iterator[tuple[Example, int, int, int, int]]:
        while len(self.free) < self.size:
            yield from self._fill()

    def _keep(self, example: Example) -> None:
        k = self.free.pop()
        self.pool[k] = example
        self.demand[k] = (len(example.ids) - example.at, 1, example.loss[example.at :].sum())

    def _take(self, k: int) -> Example:
        example, self.pool[k] = self.pool[k], None
        self.demand[k] = np.inf
        self.free.append(k)
        return example

    def _fill(self) -> list[tuple[Example, int, int, int, int]]:
        room, pieces, offset = self.limits.copy(), [], 0
        weights = 1 / self.limits**2
        while room[0] > 0 and room[1] > 0:
            fits = (self.demand <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, np.where(fits[:, None], self.demand, 0) @ (room * weights), -1)))
                room -= self.demand[k]
                example = self._take(k)
                pieces.append((example, example.at, len(example.ids) - example.at, self.bins, offset))
                offset += len(example.ids) - example.at
                continue
            here = np.isfinite(self.demand[:, 0])
            if not self.cut or not here.any():
                break
            k = int(np.argmax(np.where(here, np.where(here[:, None], self.demand, 0) @ (room * weights), -1)))
            example = self.pool[k]
            ahead = example.loss[example.at : example.at + int(room[0])]
            size = int(np.searchsorted(np.cumsum(ahead), room[2], "right"))  # as far as the loss limit goes
            if size == 0:
                break
            pieces.append((example, example.at, size, self.bins, offset))
            room -= (size, 1, ahead[:size].sum())
            offset += size
            example.at += size
            self.demand[k] -= (size, 0, ahead[:size].sum())
        self.bins += 1
        if not self.cut or offset == self.limits[0] or len(self.free) < self.size:
            return pieces
        return self._halved(pieces, offset)

    def _halved(self, pieces: list, total: int) -> list[tuple[Example, int, int, int, int]]:
        """The last bin, dealt to sequences of powers of two, which need no padding."""
        self.bins -= 1
        out, left = [], 0
        for example, start, length, _, _ in pieces:
            while length:
                if left == 0:
                    left = size = 1 << (total.bit_length() - 1)
                    total -= size
                    number, self.bins, offset = self.bins, self.bins + 1, 0
                part = min(length, left)
                out.append((example, start, part, number, offset))
                start, length, left, offset = start + part, length - part, left - part, offset + part
        return out


PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, padded_length long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("padded_length", pa.int64()),
    ]
)


def _batches(examples: Iterator[Example], packer: Packer) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    rows: list[tuple] = []
    held = 0

    def pieces() -> Iterator[tuple[Example, int, int, int, int]]:
        for example in examples:
            yield from packer.put(example)
        yield from packer.flush()

    def batch() -> pa.RecordBatch:
        filled: dict[int, int] = {}
        for row in rows:
            filled[row[3]] = max(filled.get(row[3], 0), row[4] + row[2])
        cells = [
            (
                e.key,
                start,
                size,
                e.ids[start : start + size].astype("<u4").tobytes(),
                len(e.ids),
                base + number,
                offset,
                int(e.loss[start : start + size].sum()),
                filled[number] if filled[number].bit_count() == 1 else int(packer.limits[0]),
            )
            for e, start, size, number, offset in rows
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*cells), _ARROW)], schema=_ARROW)

    last = None
    for piece in pieces():
        if rows and piece[3] != last and (len(rows) >= BATCH_PIECES or held >= BATCH_BYTES):
            yield batch()
            rows, held = [], 0
        rows.append(piece)
        held += 4 * piece[2]
        last = piece[3]
    if rows:
        yield batch()


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS
) -> DataFrame:
    """Pieces of the documents in sequences of at most ``capacity`` tokens; every token bears loss.

    One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, loss_tokens,
    padded_length (the capacity, or the sequence's own length where that is a power of two). A null or empty text is its
    end id alone. Repeated rows and rows without an id are packed like any other; columns but doc_id and text are
    ignored; an empty table gives no piece. Sequence ids are unique, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[Example]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for low, ids, bounds in encoder(tokenizer).encode(batch.column(1)):
                    for k in range(len(bounds) - 1):
                        own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                        yield Example(keys[low + k], own, np.ones(len(own), bool))

        yield from _batches(examples(), Packer(capacity, max_segments, capacity, cut=True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack_examples(
    examples: DataFrame, capacity: int = CAPACITY, max_segments: int = 16, max_loss: int = CAPACITY
) -> DataFrame:
    """Instruction examples, never cut: needs example_id, ids array<int> and loss array<boolean>, of equal lengths.

    Rows as of pack_documents, doc_id being the example_id. Null or empty ids give no piece; a null loss array means
    that no token bears loss. An example over a limit stops the job: it fits no sequence and is not dropped silently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Example]:
            for batch in batches:
                for key, ids, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    if ids:
                        yield Example(key, np.array(ids, np.uint32), np.array(loss or [False] * len(ids), bool))

        yield from _batches(rows(), Packer(capacity, max_segments, max_loss, cut=False))

    columns = [F.col("example_id").cast("long"), F.col("ids").cast("array<int>"), F.col("loss").cast("array<boolean>")]
    return examples.select(*columns).mapInArrow(run, PIECES)
