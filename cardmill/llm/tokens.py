"""Token ids of whole text columns by a public tokenizer, each distinct piece encoded once per process.

Texts are cut where the tokenizer itself cuts whatever stands around: at white space, and between letters, digits and
punctuation in runs of plain characters (ASCII, and Latin letters of two bytes). A run with an apostrophe or any other
character is one piece and goes through the library's own normalizer and pre-tokenizer; a text with white space next to
white space, where the cut depends on what follows, goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

from cardmill.llm.held import held  # noqa: E402
from cardmill.llm.wordhash import _BYTE_VALUES, _powers, doc_chunks, mix64, text_buffers  # noqa: E402

#: Remembered pieces per process, about 200 bytes each; beyond it those met only once since the last time go.
REMEMBERED = 250_000
CHUNK_BYTES = 500_000

SPACE, BLANK, LETTER, DIGIT, MARK, OTHER = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x21:0x7F] = MARK
    table[0x30:0x3A] = DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = LETTER
    table[[9, 10, 11, 12, 13]] = BLANK
    table[0x20] = SPACE
    table[0x27] = OTHER  # contractions are cut by what follows the apostrophe
    return table


_CLASS = _classes()


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


_BYTE_LETTER = _byte_letters()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        #: Byte-level: a piece owns the space before it. Else white space is dropped, letters lower-cased.
        self.spaced = isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[bytes, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._starts = np.zeros(1, np.int64)  # n + 1 bounds in _ids
        self._uses = np.empty(0, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces met again since the last time."""
        keep = np.flatnonzero(self._uses > 1)
        keep = keep if len(keep) <= REMEMBERED // 2 else keep[:0]
        lengths = np.diff(self._starts)[keep]
        self._ids = self._ids[ragged(self._starts[keep], lengths)]
        self._starts = np.concatenate(([0], np.cumsum(lengths)))
        place = np.full(len(self._uses), -1)
        place[keep] = np.arange(len(keep))
        self._known = {p: k for p, k in zip(self._known, place.tolist()) if k >= 0}
        self._uses = np.zeros(len(keep), np.int32)

    def _encode_piece(self, piece: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.tokenizer.model.tokenize("".join([_BYTE_LETTER[b] for b in piece]))]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def _learn(self, pieces: list[bytes], plain: list[bool]) -> None:
        found = [self._encode_piece(p, easy) for p, easy in zip(pieces, plain)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array([i for ids in found for i in ids], np.uint32)
        for piece in pieces:
            self._known[piece] = len(self._known)
        self._ids = np.concatenate([self._ids, flat])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(lengths)])
        self._uses = np.concatenate([self._uses, np.zeros(len(pieces), np.int32)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, n + 1 bounds) for some rows at a time; null counts as empty."""
        data, offsets = text_buffers(column)
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        for low, high in doc_chunks(offsets, CHUNK_BYTES):
            ids, counts, odd = self._encode_some(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            bounds = np.concatenate(([0], np.cumsum(counts)))
            if len(odd):
                whole = texts.take(pa.array(odd + low)).to_pylist()
                found = dict(zip(odd.tolist(), self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)))
                parts = [
                    np.array(found[t].ids, np.uint32) if t in found else ids[bounds[t] : bounds[t + 1]]
                    for t in range(high - low)
                ]
                ids = np.concatenate(parts)
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield low, ids, bounds.astype(np.int64)

    def _encode_some(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts but the odd ones, ids per text, and the odd texts."""
        n = len(data)
        n_texts = len(bounds) - 1
        if n == 0:
            return np.empty(0, np.uint32), np.zeros(n_texts, np.int64), np.empty(0, np.int64)
        kind = _CLASS[data]
        lead = data == 0xC3
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)  # not the signs of multiplication and division
        kind[tail] = LETTER
        kind[:-1][tail[1:]] = LETTER
        blank = kind <= BLANK
        begins = np.zeros(n, bool)
        begins[bounds[:-1][bounds[:-1] < n]] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = blank[:-1]
        before &= ~begins
        doc_of = lambda at: np.searchsorted(bounds, at, "right") - 1
        odd = np.unique(doc_of(np.flatnonzero(before & blank))) if self.spaced else np.empty(0, np.int64)
        for token in self.special:  # special tokens are found in the text before anything else
            if token in (raw := data.tobytes()):
                hits, at = [], raw.find(token)
                while at >= 0:
                    hits.append(at)
                    at = raw.find(token, at + 1)
                odd = np.union1d(odd, doc_of(np.array(hits)))
        # Runs without white space; a run with any other character is one piece.
        run = np.cumsum(begins | (kind == SPACE if self.spaced else blank))
        mixed = np.bincount(run[kind == OTHER], minlength=int(run[-1]) + 1) > 0
        changes = np.ones(n, bool)
        changes[1:] = kind[1:] != kind[:-1]
        if self.spaced:
            start = changes | (kind == BLANK)
            start[1:] &= kind[:-1] != SPACE
            start &= ~mixed[run]
            start |= (kind == SPACE) | begins
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], n)
        else:
            start = (changes | (kind == DIGIT)) & ~mixed[run] | before | begins
            start &= ~blank
            starts = np.flatnonzero(start)
            stop = np.ones(n, bool)
            stop[:-1] = start[1:] | blank[1:] | begins[1:]
            ends = np.flatnonzero(stop & ~blank) + 1
            upper = (data >= 0x41) & (data <= 0x5A) | tail & (data >= 0x80) & (data <= 0x9E)
            data = np.where(upper & ~mixed[run], data + 0x20, data)
        if len(starts) == 0:
            return np.empty(0, np.uint32), np.zeros(n_texts, np.int64), odd
        docs = doc_of(starts)
        if len(odd):
            keep = ~np.isin(docs, odd)
            starts, ends, docs = starts[keep], ends[keep], docs[keep]
        up, down = _powers(max(CHUNK_BYTES, n) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[:n], dtype=np.uint64, out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        code = pa.array(hashes).dictionary_encode().indices.to_numpy()
        n_codes = int(code.max()) + 1 if len(code) else 0
        first = np.zeros(n_codes, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self._known) + len(pieces) > REMEMBERED:
            self._forget()
        known = self._known
        fresh = [k for k, p in enumerate(pieces) if p not in known]
        if fresh:
            self._learn([pieces[k] for k in fresh], (~mixed[run[starts[first[fresh]]]]).tolist())
        place = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
        self._uses[place] += 1
        where = place[code]
        lengths = self._starts[where + 1] - self._starts[where]
        ids = self._ids[ragged(self._starts[where], lengths)]
        return ids, np.bincount(docs, weights=lengths, minlength=n_texts).astype(np.int64), odd


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per process."""
    return held(("encoder", path), lambda: Encoder(path))
