"""Byte-pair encoding as a deterministic automaton over tokens, and back by the labels of its arcs.

The automaton reads tokens and accepts exactly the token sequences that byte-pair encoding can give. It starts as one state
with a loop for every byte. The gadget of a merge (u, v) -> uv is built in, merge after merge: the arcs of u now end in a
copy of their old end that lacks the arc v, and where u followed by v led, the new arc uv leads too, from every state with
an arc u. All arcs of a token therefore end in one state, and tokens that every state treats alike share a column, so the
table is states x columns bits (14,639 x 10,603, or 19 MB, for 50,000 merges): its size is given by the vocabulary.

As exactly one accepted sequence spells each string, so does one for each prefix of a word. A word is encoded from left to
right: of the arcs whose label ends at a place, one at most may be taken from the state at the place where it begins.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from cardmill.llm.held import held
from cardmill.llm.tokens import _BYTE_LETTER, ragged

#: Runs, and words, remembered per process, about 150 bytes each; beyond it all are forgotten.
REMEMBERED = 250_000
#: Text bytes encoded at a time before rows are handed back.
OUT_BYTES = 4_000_000

#: White space before a space, and the spaces that have none before them and open a run.
BLANK_THEN_SPACE = re.compile(r"\s ")
RUNS = re.compile(r"(?<=\S)(?= )")

_KINDS = r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]++|[0-9]++|[!-&(-/:-@\[-`{-~]++)"
#: One kind of characters after another, perhaps with single line feeds between: these are words wherever they stand. A run
#: with anything else (apostrophes open contractions) is cut by the library.
EASY_RUN = re.compile(rf" ?{_KINDS}(?:\n?{_KINDS})*")
EASY_WORD = re.compile(rf" ?{_KINDS}|\n")

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, text string"
START = 0


@dataclass
class Automaton:
    """Transition table of tokens 0 .. n - 1; -1 as a column marks a token that no arc carries."""

    labels: list[bytes]  # what each token spells
    target: np.ndarray  # state in which the arcs of a token end
    column: np.ndarray  # column of a token in the table
    table: np.ndarray  # uint8, a row of bits per state: which columns have an arc

    def has_arc(self, state: int, token: int) -> bool:
        c = int(self.column[token])
        return c >= 0 and bool(self.table[state, c >> 3] >> (c & 7) & 1)

    def accepts(self, tokens: list[int]) -> bool:
        state = START
        for token in tokens:
            if not self.has_arc(state, token):
                return False
            state = int(self.target[token])
        return True


def compile_merges(labels: list[bytes], symbols: list[int], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of ``merges`` (left, right, result) in order of priority over the tokens ``symbols``.

    A merge must join tokens that symbols or earlier merges give, and give a token that nothing gave before; otherwise the
    order of priority is not an order of building and the call raises ValueError.
    """
    target, column = [-1] * len(labels), [-1] * len(labels)
    given = [False] * len(labels)
    for token in symbols:
        target[token] = column[token] = 0
        given[token] = True
    sharing = [len(symbols) + 1]  # tokens that end in a state, and the start itself, which never changes
    alike = [len(symbols)]  # tokens of a column
    table = np.zeros((64, 8), np.uint8)
    table[START, 0] = 1
    for u, v, uv in merges:
        if not (given[u] and given[v]) or given[uv]:
            raise ValueError(f"merge of tokens {u} and {v} into {uv} is out of order or repeated")
        given[uv] = True
        if column[u] < 0 or column[v] < 0 or not table[target[u], column[v] >> 3] >> (column[v] & 7) & 1:
            continue  # earlier merges leave no such pair, so nothing gives this token
        after = target[v]
        if sharing[target[u]] > 1 or u == v:
            state = len(sharing)
            if state == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[state] = table[target[u]]
            sharing[target[u]] -= 1
            target[u] = state
            sharing.append(1)
        if alike[c := column[v]] > 1:
            k = len(alike)
            if k >> 3 == table.shape[1]:
                table = np.concatenate([table, np.zeros_like(table)], axis=1)
            used = table[: len(sharing)]
            used[:, k >> 3] |= ((used[:, c >> 3] >> (c & 7)) & 1) << (k & 7)
            alike[c] -= 1
            column[v] = k
            alike.append(1)
        table[target[u], column[v] >> 3] &= 0xFF ^ (1 << (column[v] & 7))
        target[uv], column[uv] = (after if u == v else target[v]), column[u]
        sharing[target[uv]] += 1
        alike[column[uv]] += 1
    kept = table[: len(sharing), : (len(alike) + 7) >> 3].copy()
    return Automaton(labels, np.array(target), np.array(column), kept)


def from_file(path: str) -> Automaton:
    """The automaton of a byte-level tokenizer file; ValueError for models with settings that change how merges apply."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"not a plain BPE model: {model.get('type')}, {odd}")
    vocab: dict[str, int] = model["vocab"]
    byte_of = {letter: b for b, letter in enumerate(_BYTE_LETTER)}
    labels = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        labels[i] = bytes(byte_of.get(c, 0x3F) for c in token)
    missing = [b for b, letter in enumerate(_BYTE_LETTER) if letter not in vocab]
    if missing:
        raise ValueError(f"no token for bytes {missing}")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return compile_merges(labels, [vocab[c] for c in _BYTE_LETTER], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


class Walker:
    """Runs words through an automaton; made once per process."""

    def __init__(self, automaton: Automaton):
        width = automaton.table.shape[1]
        self._bits = automaton.table.tobytes()
        self._arcs = ahocorasick.Automaton()
        self._whole = {}
        for token, label in enumerate(automaton.labels):
            if (c := int(automaton.column[token])) >= 0:
                # Length of the label, byte and bit of the column, row where the arc ends, token: read together, kept together.
                arc = (len(label), c >> 3, 1 << (c & 7), int(automaton.target[token]) * width, token)
                self._arcs.add_word(label.decode("latin-1"), arc)
                if automaton.has_arc(START, token):
                    self._whole[label] = token
        self._arcs.make_automaton()

    def tokens(self, word: bytes) -> list[int]:
        """The accepted sequence that spells the word."""
        if (only := self._whole.get(word)) is not None:
            return [only]
        row: list[int] = [-1] * (len(word) + 1)
        taken: list[tuple] = [()] * (len(word) + 1)
        row[0] = START
        bits = self._bits
        for last, arc in self._arcs.iter(word.decode("latin-1")):
            length, byte, bit, end, _ = arc
            here = row[last + 1 - length]
            if here >= 0 and bits[here + byte] & bit:
                row[last + 1] = end
                taken[last + 1] = arc
        out, at = [], len(word)
        while at:
            arc = taken[at]
            out.append(arc[4])
            at -= arc[0]
        return out[::-1]


class Coder:
    """Texts to ids and back as the library does with a byte-level tokenizer file, words by the automaton."""

    def __init__(self, path: str, automaton: Automaton):
        library = Tokenizer.from_file(path)
        if not isinstance(library.pre_tokenizer, ByteLevel):
            raise ValueError("words of other than byte-level tokenizers are not cut here")
        self._cut = library.pre_tokenizer.pre_tokenize_str
        self._normal = library.normalizer.normalize_str if library.normalizer is not None else None
        self._added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self._byte_of = {letter: b for b, letter in enumerate(_BYTE_LETTER)}
        self._walker = Walker(automaton)
        self._known: dict[str, bytes] = {}
        self._words: dict[bytes, bytes] = {}
        labels = dict(enumerate(automaton.labels)) | {i: c.encode() for c, i in self._added.items()}
        spelled = [labels.get(i, b"") for i in range(max(labels, default=-1) + 1)]
        self._spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self._lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self._starts = np.cumsum(self._lengths) - self._lengths

    def _run(self, run: str) -> bytes:
        """Ids of a run, as little-endian bytes: it is cut into words, the automaton spells each."""
        if EASY_RUN.fullmatch(run):
            words = [word.encode() for word in EASY_WORD.findall(run)]
        else:
            words = [bytes([self._byte_of[c] for c in word]) for word, _ in self._cut(run)]
        known, spell = self._words, self._spell
        return b"".join([known.get(word) or spell(word) for word in words])

    def _spell(self, word: bytes) -> bytes:
        if len(self._words) >= REMEMBERED:
            self._words.clear()
        tokens = self._walker.tokens(word)
        found = self._words[word] = struct.pack(f"<{len(tokens)}I", *tokens)
        return found

    def _after_space(self, rest: str) -> bytes:
        """Ids of a space and the run that follows it; remembered."""
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        found = self._known[rest] = self._run(" " + rest)
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        Words never run on over a space with no white space before it, whatever stands around, so the text is cut there.
        """
        text = self._normal(text) if self._normal else text
        if not text:
            return b""
        if BLANK_THEN_SPACE.search(text):
            first, *rest = RUNS.split(text)
            rest = [r[1:] for r in rest]
        else:
            first, *rest = text.split(" ")
        known, after = self._known, self._after_space
        return (self._run(first) if first else b"") + b"".join([known.get(r) or after(r) for r in rest])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; an added token written out in the text is that token."""
        parts: list[str | bytes] = [text or ""]
        for content, i in sorted(self._added.items(), key=lambda x: -len(x[0])):
            if content in (text or ""):
                mark = np.array([i], "<u4").tobytes()
                parts = [
                    q
                    for p in parts
                    for q in ([p] if isinstance(p, bytes) else [x for s in p.split(content) for x in (s, mark)][:-1])
                ]
        return b"".join([p if isinstance(p, bytes) else self._plain(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs one after the other; ids without a token spell nothing, broken UTF-8 is replaced."""
        path = np.frombuffer(ids, "<u4")
        path = path[path < len(self._lengths)]
        return self._spelled[ragged(self._starts[path], self._lengths[path])].tobytes().decode("utf-8", "replace")


def _coders(df: DataFrame, path: str):
    """Compiled once on the driver and broadcast (a vocabulary's size); one coder per worker process."""
    key = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(from_file(path))

    return lambda: held(("coder", key), lambda: Coder(path, shared.value))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most about OUT_BYTES of its last column; a longer row is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        room = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, room + OUT_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, path: str, coders=None) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    ``docs`` needs doc_id and text; other columns are ignored whatever their names. Null and empty texts have no ids. Long
    texts are encoded whole, repeated rows give repeated rows, a null doc_id stays null, an empty table gives no row.
    """
    coders = coders or _coders(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                ids = [coders().encode(t.as_py()) for t in part.column(1)]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, coders=None) -> DataFrame:
    """Adds the text that ids spell; null ids spell the empty text. Takes doc_id, n_tokens and ids, ignores the rest."""
    coders = coders or _coders(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                texts = [coders().decode(x.as_py() or b"") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"]
                )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode``, then ``decode`` of its ids, with one automaton for both."""
    coders = _coders(docs, path)
    return decode(encode(docs, path, coders), path, coders)
