"""Token ids, packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardmill.llm import packing, tokenfile, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "\n\nfoo bar", "foo bar\n", "it's  'tis we'll IT'S", "x<|endoftext|> hi <|startoftext|>x",
    "é ́ ß ΑΣ Σ ÀÉ×÷ é,é.", "日本 語。 x", "tab\tx y\t z", "12 3456 a1b2 1,000.50!?", "re.\nNdw,ed(x)\ny", "é Å.b", "\x00\x01 a\x1fb",
    "word " * 5000, "don't\ncan't ÄÖÜ", "“quoted” — dash…, end", "emoji 😀😀 x😀y",
]


def random_texts(n=300):
    rng = random.Random(3)
    parts = ["the", "The", "é", "ß", "'", "'s", "n't", " ", " ", " ", "  ", "\n", "\t", ".", ",", "...", "1", "23", "Ü", "Ω", "日", "-", "x", "<|endoftext|>", "̈", " ", "×"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path, monkeypatch):
    texts = TEXTS + random_texts()
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for remembered in (tokens.REMEMBERED, 20):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        monkeypatch.setattr(tokens, "CHUNK_BYTES", 2_000_000 if remembered > 20 else 500)
        coder = tokens.Encoder(path)
        got = {}
        for low, ids, bounds in coder.encode(pa.array(texts)):
            for k in range(len(bounds) - 1):
                got[low + k] = ids[bounds[k] : bounds[k + 1]].tolist()
        assert [got[i] for i in range(len(texts))] == want


def documents(spark, n=120):
    rng = random.Random(5)
    words = "the of and a house Garten été ciudad\nline, x. 12".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 400, 9000 if i == 7 else 90])))) for i in range(n)]
    rows += [(None, "no id"), (5, rows[5][1]), (n, None)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)


def check_sequences(pieces, capacity):
    """Offsets gapless from 0, capacity kept, padding only where the length is no power of two."""
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        assert {r["padded_length"] for r in rows} == {at if at.bit_count() == 1 else capacity}
        padding += rows[0]["padded_length"] - at
    return padding


def test_packing_covers_every_id_once(spark):
    rows, docs = documents(spark)
    pieces = packing.pack_documents(docs, BYTE).collect()
    assert check_sequences(pieces, 2048) == 0
    plain = Tokenizer.from_file(BYTE)
    want = sorted(plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = []
    for own in by_doc.values():
        own.sort(key=lambda r: (r["start"], r["length"]))
        if len({r["start"] for r in own}) < len(own):  # the repeated row, cut alike or not
            continue
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own])
        assert len(ids) == own[0]["doc_tokens"]
        whole.append(ids.tolist())
    assert all(w in want for w in whole) and len(whole) >= len(rows) - 3
    assert sum(r["length"] for r in pieces) == sum(map(len, want))
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_packing_examples_keeps_three_limits(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        n = rng.randrange(1, 200)
        loss = [rng.random() < 0.7 for _ in range(n)]
        rows.append((i, list(range(n)), loss))
    rows.append((400, [], []))
    df = spark.createDataFrame(rows, "example_id long, ids array<int>, loss array<boolean>").coalesce(1)
    pieces = packing.pack_examples(df, capacity=512, max_segments=5, max_loss=300).collect()
    assert sorted(r["doc_id"] for r in pieces) == list(range(400))
    bins = {}
    for r in pieces:
        b = bins.setdefault(r["sequence_id"], [0, 0, 0])
        b[0] += r["length"]
        b[1] += 1
        b[2] += r["loss_tokens"]
    assert all(a <= 512 and s <= 5 and lo <= 300 for a, s, lo in bins.values())
    assert len(bins) <= 1.15 * max(sum(len(r[1]) for r in rows) / 512, sum(sum(r[2]) for r in rows) / 300)
    with pytest.raises(Exception, match="exceeds the limits"):
        packing.pack_examples(df, capacity=10).collect()


def test_cutting_under_a_loss_limit():
    packer = packing.Packer(64, 3, 20, cut=True, pool=8)
    rng = np.random.default_rng(0)
    made = [packing.Example(i, np.arange(n, dtype=np.uint32), rng.random(n) < 0.6) for i, n in enumerate(rng.integers(1, 200, 50))]
    pieces = [p for e in made for p in packer.put(e)] + list(packer.flush())
    seen = {}
    for example, start, length, _, _ in pieces:
        assert seen.get(example.key, 0) == start
        seen[example.key] = start + length
    assert seen == {e.key: len(e.ids) for e in made}
    for number in {p[3] for p in pieces}:
        own = [p for p in pieces if p[3] == number]
        assert len(own) <= 3 and sum(p[2] for p in own) <= 64
        assert sum(int(p[0].loss[p[1] : p[1] + p[2]].sum()) for p in own) <= 20


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_TOKENS", 3000)
    rows, docs = documents(spark)
    got = tokenfile.token_files(docs, WORD).collect()
    plain = Tokenizer.from_file(WORD)
    key = lambda i, t: (i is not None, i or 0)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: key(*r)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.token_files(docs.where(F.lit(False)), WORD).count() == 0


def test_token_file_seeks_and_checks():
    writer = tokenfile.FileWriter(2)
    made = [np.arange(n, dtype=np.uint32) % 50_000 for n in (5, 40_000, 0, 7, 30_000, 3)]
    for i, ids in enumerate(made):
        writer.add(i if i else None, ids)
    n_docs, n_tokens, body = writer.finish()
    assert (n_docs, n_tokens) == (6, sum(map(len, made)))
    file = tokenfile.TokenFile(body)
    assert file.doc_ids == [None, 1, 2, 3, 4, 5]
    assert (next(file.documents([3])) == made[3]).all() and len(file.decompressed) == 1
    assert all((a == b).all() for a, b in zip(file.documents(list(range(6))), made))
    broken = bytearray(body)
    broken[int(file.starts[1]) + 20] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - either the frame or its checksum
        tokenfile.TokenFile(bytes(broken)).frame(1)
    assert (tokenfile.TokenFile(bytes(broken)).frame(0) == np.concatenate(made[:1])).all()
