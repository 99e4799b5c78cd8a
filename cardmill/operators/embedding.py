"""Token-mean document vectors: BERT word split, greedy WordPiece over distinct words, mean, L2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from cardmill.functions.text import fold_letters, let
from cardmill.session import LARGE_ROWS, written

UNKNOWN = "[UNK]"
CONTINUED = "##"
LONGEST_WORD = 100
#: Characters of text whose words meet their vectors in one task, and so many at least if there are cores left.
BLOCK_CHARS, LEAST_CHARS = 128 << 20, 1 << 20
#: Vectors that are added up together, and words of the texts of a piece.
SUM_ROWS, MOST_WORDS = 1 << 13, 1 << 20
#: What a row of a block is, in the order in which a block takes its rows.
KINDS = SPELLED, VECTOR, PIECE = 0, 1, 2

_CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
# ASCII symbols count as punctuation besides the Unicode punctuation classes.
_PUNCTUATION = r"\p{P}$+<=>^`|~"
# Controls other than the white-space ones, the replacement character, and combining marks.
_DROPPED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Mn}\x{FFFD}&&[^\t\n\r]]"


def words(text: Column) -> Column:
    """Normalised words: controls and marks dropped, CJK and punctuation isolated, case and accents folded."""
    bare = F.regexp_replace(text, _DROPPED, "")
    apart = F.regexp_replace(fold_letters(bare), f"[{_CJK}{_PUNCTUATION}]", " $0 ")
    return F.filter(F.split(apart, r"[\t\n\r\p{Z}]+"), lambda w: w != "")


def word_pieces(vocabulary_words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, pos, token): greedy longest match for each distinct word of ``word``.

    A word that is itself a token is done. Of the others every start meets the vocabulary in one
    equi-join on its candidate substrings, no longer than a token of that kind (beginning or continuation)
    can be; the longest end per start is an aggregate on the same partitioning, and the greedy walk runs
    over that small map. A word that cannot be covered, or is too long, is one unknown token.
    """
    longest = tokens.agg(F.max(F.length("token"))).scalar()
    rest = F.max(F.when(F.col("token").startswith(CONTINUED), F.length("token") - len(CONTINUED)))
    longest_rest = tokens.agg(F.coalesce(rest, F.lit(0))).scalar()
    known = tokens.select("token")
    size = F.length("word")
    as_token = known.select(F.col("token").alias("word")).withColumn("whole", F.lit(True))
    looked_up = vocabulary_words.join(as_token, "word", "left").withColumn(
        "whole", F.coalesce("whole", F.lit(False)) & (size <= LONGEST_WORD)
    )
    done = looked_up.filter("whole").select("word", F.lit(0).alias("pos"), F.col("word").alias("token"))
    vocabulary_words = looked_up.filter(~F.col("whole")).select("word")
    candidates = (
        vocabulary_words.filter(size <= LONGEST_WORD)
        .withColumn("longest", longest)
        .withColumn("longest_rest", longest_rest)
        .select("word", "longest", "longest_rest", F.explode(F.sequence(F.lit(1), size)).alias("start"))
        .withColumn("most", F.least(size - F.col("start") + 1, F.when(F.col("start") == 1, F.col("longest")).otherwise(F.col("longest_rest"))))
        .filter("most >= 1")
        .select("word", "start", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("len"))
        .withColumn(
            "token",
            F.concat(
                F.when(F.col("start") > 1, F.lit(CONTINUED)).otherwise(""),
                F.substring(F.col("word"), F.col("start"), F.col("len")),
            ),
        )
    )
    # All (start, len) of a word meet in one shuffle; of those with one start the last is the longest.
    last = lambda c: F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1)["start"] != x["start"], F.lit(True)))
    reach = (
        candidates.join(known, "token")
        .groupBy("word")
        .agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("ends"))
        .select("word", F.map_from_entries(last(F.col("ends"))).alias("reach"))
    )
    state = "struct<next:int,starts:array<int>>"
    walk = F.aggregate(
        F.sequence(F.lit(1), size),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts")).cast(state),
        lambda s, i: F.when(
            (s["next"] == i) & F.try_element_at(F.col("reach"), i).isNotNull(),
            F.struct(
                (i + F.try_element_at(F.col("reach"), i)).cast("int").alias("next"),
                F.concat(s["starts"], F.array(i)).alias("starts"),
            ),
        ).otherwise(s),
    )
    walked = (
        vocabulary_words.join(reach, "word", "left")
        .withColumn("walk", F.when(F.col("reach").isNotNull(), walk))
        .withColumn("covered", F.coalesce(F.col("walk.next") == size + 1, F.lit(False)))
    )
    piece = lambda i: F.concat(
        F.when(i > 1, F.lit(CONTINUED)).otherwise(""),
        F.substring(F.col("word"), i, F.element_at(F.col("reach"), i)),
    )
    pieces = F.when(F.col("covered"), F.transform(F.col("walk.starts"), piece)).otherwise(F.array(F.lit(UNKNOWN)))
    return done.unionByName(walked.select("word", F.posexplode(pieces).alias("pos", "token")))


def tokenize(df: DataFrame, tokens: DataFrame, key: str = "subject_id", text: str = "text") -> DataFrame:
    """(key, position, piece, token): the token sequence of every text; each word is split once."""
    spoken = df.select(key, F.posexplode(words(F.col(text))).alias("position", "word"))
    pieces = word_pieces(spoken.select("word").distinct(), tokens)
    return spoken.join(pieces.withColumnRenamed("pos", "piece"), "word").select(key, "position", "piece", "token")


class _Block:
    """Words of one block of texts as numbers of vectors, and these vectors; the texts themselves are taken piece by piece."""

    def __init__(self, dim: int):
        self.dim = dim
        self.spelled: list[pa.RecordBatch] = []
        self.table: np.ndarray | None = None

    def _complete(self) -> None:
        if self.table is not None:
            return
        joined = lambda name, kind: pa.chunked_array([b.column(name) for b in self.spelled], kind).combine_chunks()
        self.words, codes = joined("word", pa.string()), joined("codes", pa.list_(pa.int64()))
        self.pieces = joined("pieces", pa.int64()).to_numpy(zero_copy_only=False)
        self.many = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = self.many.cumsum() - self.many
        self.codes, self.at = np.unique(codes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.table = np.zeros((len(self.codes), self.dim), np.float32)
        self.spelled = []

    def add_vectors(self, part: pa.RecordBatch) -> None:
        self._complete()
        at = np.searchsorted(self.codes, part.column("code").to_numpy())
        self.table[at] = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)

    def _by_word(self, words: np.ndarray) -> np.ndarray:
        """The sum of its tokens' vectors for each of some words."""
        out = np.zeros((len(words), self.dim))
        known = np.flatnonzero(self.many[words] > 0)
        for low in range(0, len(known), SUM_ROWS):
            some = words[known[low : low + SUM_ROWS]]
            many = self.many[some]
            begins = many.cumsum() - many
            places = np.arange(many.sum()) - np.repeat(begins - self.first[some], many)
            out[known[low : low + SUM_ROWS]] = np.add.reduceat(self.table[self.at[places]].astype(np.float64), begins)
        return out

    def sums(self, words: pa.Array, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(sum of vectors, tokens) of each text of a piece."""
        self._complete()
        many, word, times = unpacked(cells)
        total, n_tokens = np.zeros((len(many), self.dim)), np.zeros(len(many), np.int64)
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            raise ValueError(f"words without a spelling: {words.filter(at.is_null())[:3]}")
        at = at.to_numpy()
        by_word, pieces = self._by_word(at), self.pieces[at].astype(np.float64)
        times = times.astype(np.float64)
        ends = many.cumsum()
        for text, (low, high) in enumerate(zip((ends - many).tolist(), ends.tolist())):
            for cut in range(low, high, SUM_ROWS):
                w, n = word[cut : min(high, cut + SUM_ROWS)], times[cut : min(high, cut + SUM_ROWS)]
                total[text] += n @ by_word[w]
                n_tokens[text] += int(n @ pieces[w])
        return total, n_tokens


def packed(many: np.ndarray, word: np.ndarray, times: np.ndarray) -> bytes:
    """Words of each text, and which and how often: by text and word, so steps are small; equal bytes of the numbers side by side."""
    step = np.diff(word, prepend=0)
    first = (many.cumsum() - many)[many > 0]
    step[first] = word[first]
    flat = np.concatenate([[len(many)], many, step, times]).astype("<i4")
    return (4 * len(flat)).to_bytes(8, "little") + pa.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(cells[:8], "little")
    flat = np.frombuffer(pa.decompress(cells[8:], size, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
    many, rest = flat[1 : 1 + flat[0]], flat[1 + flat[0] :]
    step, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    upto = step.cumsum()
    first = many.cumsum() - many
    before = np.where(first > 0, upto[first - 1], 0) if len(step) else np.zeros(len(many), np.int64)
    return many, upto - np.repeat(before, many), times


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, size, keys, spoken, cells) of (key, words): some texts with their distinct words once."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        upto = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).cumsum()
        low = 0
        while low < len(batch):
            before = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, before + MOST_WORDS, "right")))
            flat = lists.slice(low, high - low).flatten()
            said = flat.dictionary_encode()
            sizes = np.diff(upto[low:high], prepend=before)
            width = max(1, len(said.dictionary))
            cells, times = np.unique(np.repeat(np.arange(high - low), sizes) * width + said.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, word = np.divmod(cells, width)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            chars = pc.sum(pc.binary_length(flat)).as_py() or 0
            counts = packed(np.bincount(row, minlength=high - low), word, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | n]), pa.array([chars]), one(keys.slice(low, high - low)), one(said.dictionary), pa.array([counts])],
                ["piece", "size", "keys", "spoken", "cells"],
            )
            low, n = high, n + 1


def _unit(keys: pa.Array, total: np.ndarray, n_tokens: np.ndarray, dim: int) -> pa.RecordBatch:
    norm = np.sqrt((total * total).sum(axis=1))
    kept = np.flatnonzero(norm > 0)
    unit = (total[kept] / norm[kept, None]).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * dim, pa.int32()), pa.array(unit.ravel()))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(kept)), vectors, pa.array(n_tokens[kept])], ["key", "vector", "n_tokens"])


def _streamed_sums(dim: int, as_unit: bool):
    """Rows in the order of (block, kind) are taken one after the other; what is held is the words of a block, not its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block(dim)
        for batch in batches:
            marks = batch.column("block").to_numpy() * len(KINDS) + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(batch)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                number, kind = divmod(int(marks[low]), len(KINDS))
                part = batch.slice(low, high - low)
                if number != now:
                    now, block = number, _Block(dim)
                if kind == SPELLED:
                    block.spelled.append(part)
                elif kind == VECTOR:
                    block.add_vectors(part)
                else:
                    for keys, spoken, cells in zip(*(part.column(c) for c in ("keys", "spoken", "cells"))):
                        total, n_tokens = block.sums(spoken.values, cells.as_py())
                        if as_unit:
                            yield _unit(keys.values, total, n_tokens, dim)
                            continue
                        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * dim, pa.int32()), pa.array(total.ravel()))
                        yield pa.RecordBatch.from_arrays([keys.values, sums, pa.array(n_tokens)], ["key", "total", "n_tokens"])

    return run


def token_mean_vectors(
    df: DataFrame, token_vectors: DataFrame, key: str = "subject_id", text: str = "text"
) -> DataFrame:
    """(key, vector, n_tokens): mean of token vectors scaled to unit length; no tokens, no row.

    Texts become pieces of counted words where they are read, and pieces that follow one another a block of bounded size. A
    block gets the spelling of each of its words and each vector of their tokens once, and sums them where the pieces
    are: no vector travels per (document, word) and no text at all. The pieces stream past, so a block can be large, and the
    larger the blocks the fewer of them need a token's vector. Texts of one key are added up at the end, if there are any.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    dim = token_vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    again = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count() > 0
    schema = StructType([
        StructField("piece", LongType()), StructField("size", LongType()), StructField("keys", ArrayType(kind)),
        StructField("spoken", ArrayType(StringType())), StructField("cells", BinaryType()),
    ])
    pieces = written(df.select(key, words(F.col(text)).alias("words")).mapInArrow(_pieces, schema), **LARGE_ROWS)
    sizes = sorted((r["piece"], r["size"]) for r in pieces.select("piece", "size").toLocalIterator())
    size = sum(s for _, s in sizes)
    blocks = max(1, -(-size // BLOCK_CHARS), min(spark.sparkContext.defaultParallelism, size // LEAST_CHARS))
    upto, block_of = 0, []
    for piece, s in sizes:
        block_of.append((piece, min(blocks - 1, (upto + s // 2) * blocks // max(1, size))))
        upto += s
    dealt = pieces.drop("size").join(F.broadcast(spark.createDataFrame(block_of, "piece long, block int")), "piece").drop("piece")
    met = written(dealt.select("block", F.explode("spoken").alias("word")).distinct())
    spellings = word_pieces(met.select("word").distinct(), token_vectors.select("token"))
    # Tokens may share a vector: words are spelled in numbers of distinct vectors, and a block gets each of these once.
    usable = token_vectors.filter(F.size("vector") == dim).select("token", F.col("vector").cast("array<float>").alias("vector"))
    usable = usable.select("token", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"))
    vectors = written(usable.groupBy("h", "g").agg(F.first("vector").alias("vector")).withColumn("code", F.monotonically_increasing_id()))
    coded = usable.select("token", "h", "g").join(vectors.select("h", "g", "code"), ["h", "g"]).groupBy("token").agg(F.min("code").alias("code"))
    spellings = spellings.join(coded, "token", "left").groupBy("word").agg(F.collect_list("code").alias("codes"), F.count("*").alias("pieces"))
    spelled = written(met.join(spellings, "word").select("block", "word", "codes", "pieces"))
    needed = spelled.select("block", F.explode("codes").alias("code")).distinct().join(vectors.select("code", "vector"), "code")
    of = lambda rows, kind: rows.withColumn("kind", F.lit(kind))
    rows = of(spelled, SPELLED).unionByName(of(needed, VECTOR), True).unionByName(of(dealt, PIECE), True)
    in_order = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    made = lambda name, number: StructType([StructField("key", kind), StructField(name, ArrayType(number)), StructField("n_tokens", LongType())])
    if not again:
        units = in_order.mapInArrow(_streamed_sums(dim, True), made("vector", FloatType()))
        return units.withColumnRenamed("key", key)
    sums = in_order.mapInArrow(_streamed_sums(dim, False), made("total", DoubleType()))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sums = sums.groupBy("key").agg(F.collect_list("total").alias("parts"), F.sum("n_tokens").alias("n_tokens"))
    total = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), both)
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda n, x: n + x * x))
    unit = let(norm, lambda n: F.when((n > 0) & ~F.isnan(n), F.transform("total", lambda x: (x / n).cast("float"))))
    scaled = sums.select("key", "n_tokens", F.explode(F.array(total)).alias("total")).select(F.col("key").alias(key), unit.alias("vector"), "n_tokens")
    return scaled.filter(F.col("vector").isNotNull())


def check_token_table(token_vectors: DataFrame) -> DataFrame:
    """Data-quality facts of a token table: rows, distinct tokens, dimensions, unknown token present."""
    return token_vectors.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("token").alias("n_tokens"),
        F.min(F.size("vector")).alias("min_dim"),
        F.max(F.size("vector")).alias("max_dim"),
        F.max(F.col("token") == UNKNOWN).alias("has_unknown"),
    )
