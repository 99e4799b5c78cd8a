"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum per frame.

A file is, in this order: frames of the ids of whole documents (little-endian, two bytes each where the vocabulary
allows, else four); a skippable frame with the documents of the file; a skippable frame with the seek table in the
public seekable layout (sizes and the low 32 bits of XXH64 of each frame's contents, then a nine-byte footer). A reader
finds a document in the index and decompresses only its frame.

Files are rows of a table in the shared folder, because only Spark is sure to reach that store: part, file, n_docs,
n_tokens, body. ``body`` written to a file of its own is a valid zstandard stream.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardmill.llm.tokens import encoder
from cardmill.session import checkpoint_root

FRAME_TOKENS = 32_768
FILE_TOKENS = 2_000_000
LEVEL = 3
#: Fixed values of the seekable zstandard layout.
INDEX_MAGIC, SEEK_TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FILES = "part long, file long, n_docs long, n_tokens long, body binary"
_FILES = pa.schema(
    [("part", pa.int64()), ("file", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())]
)


class FileWriter:
    """Collects whole documents; ``finish`` gives the bytes of a file and starts the next one."""

    def __init__(self, width: int):
        self.width = width
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self._reset()

    def _reset(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, frame, tokens
        self.open: list[np.ndarray] = []
        self.open_tokens = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.open and self.open_tokens + len(ids) > FRAME_TOKENS:
            self._close_frame()
        self.docs.append((doc_id, len(self.frames), len(ids)))
        self.open.append(ids)
        self.open_tokens += len(ids)
        self.n_tokens += len(ids)

    def _close_frame(self) -> None:
        raw = np.concatenate(self.open).astype(f"<u{self.width}").tobytes()
        frame = self.compressor.compress(raw)
        self.frames.append(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.open_tokens = [], 0

    def finish(self) -> tuple[int, int, bytes]:
        """Documents, tokens and bytes of the file."""
        if self.open:
            self._close_frame()
        n_docs, n_tokens = len(self.docs), self.n_tokens
        ids = np.array([0 if d is None else d for d, _, _ in self.docs], "<i8").tobytes()
        known = np.array([d is not None for d, _, _ in self.docs], "u1").tobytes()
        frame = np.array([f for _, f, _ in self.docs], "<u4").tobytes()
        sizes = np.array([n for _, _, n in self.docs], "<u8").tobytes()
        index = struct.pack("<IB", n_docs, self.width) + ids + known + frame + sizes
        seek = b"".join(struct.pack("<III", *entry) for entry in self.table)
        seek += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        body = b"".join(self.frames)
        body += struct.pack("<II", INDEX_MAGIC, len(index)) + index
        body += struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek
        self._reset()
        return n_docs, n_tokens, body


@dataclass
class TokenFile:
    """Reads a file's tables at once and its frames on demand."""

    body: bytes

    def __post_init__(self) -> None:
        n_frames, flags, magic = struct.unpack_from("<IBI", self.body, len(self.body) - 9)
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        at = len(self.body) - 9 - 12 * n_frames
        self.table = np.frombuffer(self.body, "<u4", 3 * n_frames, at).reshape(n_frames, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        magic, _ = struct.unpack_from("<II", self.body, int(self.starts[-1]))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index behind the frames")
        at = int(self.starts[-1]) + 8
        n, self.width = struct.unpack_from("<IB", self.body, at)
        at += 5
        ids = np.frombuffer(self.body, "<i8", n, at).tolist()
        known = np.frombuffer(self.body, "u1", n, at + 8 * n).tolist()
        self.doc_ids = [d if k else None for d, k in zip(ids, known)]
        self.frame_of = np.frombuffer(self.body, "<u4", n, at + 9 * n).astype(np.int64)
        self.sizes = np.frombuffer(self.body, "<u8", n, at + 13 * n).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.decompressed: list[int] = []

    def frame(self, k: int) -> np.ndarray:
        """Ids of a frame; fails where its contents do not have the stored checksum."""
        raw = zstandard.ZstdDecompressor().decompress(
            self.body[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.table[k, 1])
        )
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        self.decompressed.append(k)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def documents(self, rows: list[int]) -> Iterator[np.ndarray]:
        """Ids of the documents at these places of the index; only their frames are decompressed."""
        at, ids = -1, np.empty(0, np.uint32)
        for row in rows:
            if (k := int(self.frame_of[row])) != at:
                at, ids = k, self.frame(k)
            start = int(self.first[row] - self.first[np.searchsorted(self.frame_of, k)])
            yield ids[start : start + int(self.sizes[row])]


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Ids of all documents, each with the end id behind it, in ascending doc_id order (null ids first).

    Rows of one id are dealt out by their text's hash, so that an id shared by many rows fills no single task. A null
    text is the end id alone; columns but doc_id and text are ignored; an empty table gives a table without files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        writer = FileWriter(2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else 4)

        def file() -> pa.RecordBatch:
            row = (part, number, *writer.finish())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FILES)], schema=_FILES)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for low, ids, bounds in coder.encode(batch.column(1)):
                for k in range(len(bounds) - 1):
                    writer.add(keys[low + k], np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
                    if writer.n_tokens >= FILE_TOKENS:
                        yield file()
                        number += 1
        if writer.docs:
            yield file()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    ordered.select("doc_id", "text").mapInArrow(run, FILES).write.parquet(path)


READ = "part long, file long, doc_id long, first long, n_tokens long, ids_crc32 long"
_READ = pa.schema([(name, pa.int64()) for name in ("part", "file", "doc_id", "first", "n_tokens", "ids_crc32")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, body in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(body)
                sums = [zlib.crc32(ids.tobytes()) for ids in file.documents(list(range(len(file.doc_ids))))]
                n = len(sums)
                cells = [[part] * n, [number] * n, file.doc_ids, file.first[:-1], file.sizes, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], schema=_READ)

    # Two levels of running sums: over the files of a part, then over the parts, which are as many as write tasks.
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "file", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    offsets = (
        sizes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "file", (F.col("_before") + F.col("_inside")).alias("_offset"))
    )
    return (
        files.select("part", "file", "body")
        .mapInArrow(run, READ)
        .join(offsets, ["part", "file"])
        .select("doc_id", (F.col("_offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents as token files in the shared folder and gives what they hold when read back."""
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_files(docs, tokenizer, path, end_id)
    return read_documents(spark, path)
