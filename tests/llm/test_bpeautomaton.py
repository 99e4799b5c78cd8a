"""The merge automaton against byte-pair encoding written down, and against the library."""

import hashlib
import itertools
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardmill.llm import bpeautomaton, catalog
from cardmill.llm.bpeautomaton import Walker, compile_merges

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    None,
    "",
    " ",
    "   \n\n  x  \t y  z 　\n",
    "<|endoftext|>a <|endoftext|><|endoftext|> b",
    "I'll they're IT'S 'quoted' ''s",
    "ñandú ÷×ßÿ Ωмега 漢字 😀😀 é ‍\x1c\x1f x",
    "abc123def!!??..\nNext\n\nline \n end\n",
    "a" * 3000 + "'" + " b" * 500,
    "\x00\x7f\x80",
]


def by_merging(word: list[int], merges: list[tuple[int, int, int]]) -> list[int]:
    """Each merge in turn, from left to right."""
    for u, v, uv in merges:
        out, i = [], 0
        while i < len(word):
            if word[i : i + 2] == [u, v]:
                out.append(uv)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies_equal_merging(seed):
    rng = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(merges) < 12:
        u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    automaton = compile_merges(labels, [0, 1, 2], merges)
    walker = Walker(automaton)
    for n in range(1, 8):
        for word in itertools.product(range(3), repeat=n):
            spelled = b"".join(labels[t] for t in word)
            found = walker.tokens(spelled)
            assert found == by_merging(list(word), merges)
            assert automaton.accepts(found)
    # Every other way to spell a word is refused.
    text = b"abcaab"
    ways = [[]]
    for _ in range(len(text)):
        ways += [w + [t] for w in ways for t in range(len(labels)) if text.startswith(b"".join(labels[x] for x in [*w, t]))]
    whole = {tuple(w) for w in ways if b"".join(labels[t] for t in w) == text}
    assert [w for w in whole if automaton.accepts(list(w))] == [tuple(walker.tokens(text))]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        compile_merges([b"a", b"b", b"ab", b"aba"], [0, 1], [(2, 0, 3), (0, 1, 2)])
    with pytest.raises(ValueError):
        compile_merges([b"a", b"b", b"ab", b"abab"], [0, 1], [(0, 1, 2), (0, 1, 2)])


def test_equals_the_library():
    library = Tokenizer.from_file(PATH)
    coder = bpeautomaton.Coder(PATH, bpeautomaton.from_file(PATH))
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n'abcdeinthgr01é漢.,!😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        found = coder.encode(text)
        assert found == b"".join(i.to_bytes(4, "little") for i in ids), text
        assert coder.decode(found) == library.decode(ids, skip_special_tokens=False)
    for _ in range(500):  # any ids, which may spell broken characters
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert coder.decode(b"".join(i.to_bytes(4, "little") for i in ids)) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode((2**32 - 1).to_bytes(4, "little")) == ""
    start = time.time()
    coder.encode("x" * 100 + "'" + "y" * 100_000 + "'z")
    assert time.time() - start < 20


def test_query_equals_the_library(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "x"), (3, ODD_TEXTS[3], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    found = catalog.op13_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.op13_bpe(spark, str(tmp_path)).count() == 0
