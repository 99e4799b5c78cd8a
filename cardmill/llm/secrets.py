"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions only near its hits, then embedded checksums.

Scans run on an ASCII view of the text in which every other character is one question mark, so an offset in the view is
a code point offset of the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Public token formats whose last six characters are the CRC-32 of the thirty before them in base 62.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
VALUE_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_HEX_KEYWORD = b"h" * HEX_LENGTH
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def checksum62(body: str) -> str:
    """CRC-32 in base 62, six digits."""
    value, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= VALUE_LENGTH
    if kind == "access":
        return len(m[0]) >= ACCESS_LENGTH
    return checksum62(m[1]) == m[2]


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS; none for a null text.

    Per kind, matches are the leftmost non-overlapping ones: a match that fails its length or checksum still takes up
    its characters.
    """
    raw = (text or "").encode("ascii", "replace")
    view = raw.decode("ascii")
    spans: list[tuple[str, int, int]] = []
    hits = [(end - n + 1, kind) for end, (kind, n) in _automaton().iter(raw.lower().decode("ascii"))]
    taken: dict[str, int] = {}
    for start, kind in sorted(hits):
        if start >= taken.get(kind, 0) and (m := _ANCHORED[kind].match(view, start)):
            taken[kind] = m.end()
            if _accept(kind, m):
                spans.append((kind, start, m.end()))
    mapped = raw.translate(_HEX_CLASS)
    at = mapped.find(_HEX_KEYWORD)
    while at >= 0:
        end = HEX.match(view, at).end()
        spans.append(("hex", at, end))
        at = mapped.find(_HEX_KEYWORD, end)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id and its spans, sorted; needs doc_id and text, other columns are ignored.

    Null and empty texts have no span, repeated rows give repeated rows, an empty table gives none; texts are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(spans, _ARROW.field(1).type)], schema=_ARROW
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of the given kinds, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every stretch of secrets replaced by the mask; overlapping spans are one stretch."""
    if not (spans := find_secrets(text)):
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked in text; all other columns, also n_chars, as they were."""
    mask = F.pandas_udf(lambda s: s.map(redact, na_action="ignore"), "string")
    return docs.withColumn("text", mask("text"))
