"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. One pass counts, for the whole corpus, in how many documents the shingles of each of 2^18 hash buckets occur.
2. One pass weighs each document's five-word shingles by count times inverse document frequency and draws SAMPLES
   consistent samples; BANDS groups of ROWS samples are the document's bands. Equal texts become one.
3. Texts that share a band are candidates: first each with the smallest id of the band only. Where that leaves several
   components in a band, the pairs across components follow: small bands list them, large bands are cut into blocks of
   bounded size whose pairs are compared by matrix products and give no more than spanning links. Every candidate is
   verified by its weighted Jaccard similarity over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.components import components
from cardmill.llm.scratch import Stored, store
from cardmill.llm.wordhash import mix64, shingles, word_chunks

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^3)^16 = 1e-5.
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
BUCKETS = 1 << 18
IDF_SPAN = 0.2
#: Of two texts of similarity 0.8, fewer than 24 of 48 samples agree with probability 1e-6: such pairs are not read.
LEAST_AGREED = SAMPLES // 2
#: Members of a band whose cross pairs are listed; members and characters of a block of a larger band.
LISTED, BLOCK, BLOCK_CHARS = 48, 512, 8_000_000
CHUNK = 2048


def document_weights(words, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a chunk, by document: document, hash, weight (count times idf)."""
    hashes, docs = shingles(words, WORDS)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes) == 0:
        return docs, hashes, np.empty(0, np.float32)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes))).astype(np.float32)
    hashes, docs = hashes[at], docs[at]
    return docs, hashes, counts * idf[bucket_of(hashes)] if idf is not None else counts


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with text, and per hash bucket how often a shingle of it occurs in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += len(batch) - batch.column(0).null_count
            for words in word_chunks(batch.column(0)):
                counts += np.bincount(bucket_of(document_weights(words, None)[1]), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], ["bucket", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most one row per bucket and one for the number of documents
    out = np.zeros(BUCKETS, np.int64)
    rest = found[found["bucket"] >= 0]
    out[rest["bucket"].to_numpy()] = rest["n"].to_numpy()
    return int(found.loc[found["bucket"] < 0, "n"].sum()), out


def inverse_frequencies(n_docs: int, counts: np.ndarray) -> np.ndarray:
    """Weight of a shingle of each bucket, from 1 + IDF_SPAN (rare) to 1 (in every document).

    What a bucket has on average by sharing shingles is taken off first. The small span keeps the similarity of copies
    of a common text, whose own edits are rare shingles, near the plain one.
    """
    own = np.maximum(1.0, counts - counts.mean())
    share = np.log(np.maximum(1.0, n_docs / own)) / np.log(max(n_docs, 2))
    return (1 + IDF_SPAN * share).astype(np.float32)


@lru_cache(maxsize=1)
def _gamma_quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of the Gamma(2, 1) distribution, and their logarithms."""
    x = np.concatenate((np.geomspace(1e-6, 1, 20_000), np.linspace(1, 40, 200_000)[1:]))
    q = np.interp((np.arange(65_536) + 0.5) / 65_536, 1 - (1 + x) * np.exp(-x), x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


_KEYS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def draw(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int) -> np.ndarray:
    """Samples of each document: SAMPLES hashes of (shingle, step); a document without shingles has zeros.

    For sample k, a shingle of weight S has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all from its hash and k, the step
    t = floor(ln S / r + b), and ln a = ln c - r (t - b + 1); the shingle with the smallest a is the sample.
    """
    gamma, log_gamma = _gamma_quantiles()
    best = np.full((n_docs, SAMPLES), np.inf, np.float32)
    out = np.zeros((n_docs, SAMPLES), np.uint64)
    log_weights = np.log(weights)
    for low in range(0, len(hashes), CHUNK):
        own, here = hashes[low : low + CHUNK], docs[low : low + CHUNK]
        z = mix64(own[:, None] ^ _KEYS)
        r = gamma[z & np.uint64(0xFFFF)]
        b = (z >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_weights[low : low + CHUNK, None] / r + b)
        a = log_gamma[(z >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - b + 1)
        starts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        least = np.minimum.reduceat(a, starts, axis=0)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(here))))
        row, k = np.nonzero(a == least[group])
        at = np.zeros(least.shape, np.int64)
        at[group[row[::-1]], k[::-1]] = row[::-1]  # of equal values the first
        steps = np.take_along_axis(t, at, axis=0).astype(np.int64).astype(np.uint64)
        drawn = mix64(own[at] + steps * np.uint64(0x9E3779B97F4A7C15))
        target = here[starts]
        better = least < best[target]
        best[target] = np.where(better, least, best[target])
        out[target] = np.where(better, drawn, out[target])
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """Each ROWS samples in one hash, different in each band (int64)."""
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93), len(samples), axis=0)
    for k in range(ROWS):
        out = mix64(out ^ samples[:, k::ROWS])
    return out.view(np.int64)


SIGNED = "doc_id long, digest string, chars int, weight double, bands array<long>, samples binary"


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, digest of the text, total weight, bands and short samples of each row; a text without words has none."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(2)):
                docs_at, hashes, weights = document_weights(words, shared.value)
                samples = draw(docs_at, hashes, weights, words.n_docs)
                total = np.bincount(docs_at, weights=weights, minlength=words.n_docs).astype(np.float64)
                bands = bands_of(samples[total > 0])
                sizes = np.where(total > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(bands.ravel()))
                short = [row.tobytes() for row in samples.astype(np.uint16)]
                part = batch.slice(words.first, words.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(total), lists, pa.array(short, pa.binary())],
                    ["doc_id", "digest", "chars", "weight", "bands", "samples"],
                )

    return docs.select("doc_id", F.md5("text").alias("digest"), "text", F.length("text").alias("chars")).mapInArrow(run, SIGNED)


def weighted_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; each side sorted distinct hashes and their weights."""
    small, large = (left, right) if len(left[0]) <= len(right[0]) else (right, left)
    if len(small[0]) == 0:
        return 0.0
    at = np.searchsorted(large[0], small[0])
    at[at == len(large[0])] = 0
    both = large[0][at] == small[0]
    common = float(np.minimum(small[1][both], large[1][at[both]]).sum(dtype=np.float64))
    total = float(left[1].sum(dtype=np.float64) + right[1].sum(dtype=np.float64))
    return common / (total - common)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (unit, text) have at least the threshold's weighted Jaccard similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def weights_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for words in word_chunks(column):
            docs_at, hashes, weights = document_weights(words, shared.value)
            cuts = np.searchsorted(docs_at, np.arange(words.n_docs + 1))
            for k in range(words.n_docs):
                yield hashes[cuts[k] : cuts[k + 1]], weights[cuts[k] : cuts[k + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 256):  # bounds what is weighed at once
                batch = whole.slice(low, 256)
                leads = batch.column(3).dictionary_encode()
                known = list(weights_of(leads.dictionary))
                keep = [
                    weighted_jaccard(own, known[k]) >= threshold
                    for own, k in zip(weights_of(batch.column(2)), leads.indices.to_pylist())
                ]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = texts.select(F.col("unit").alias("a"), F.col("text").alias("_left"))
    right = texts.select(F.col("unit").alias("b"), F.col("text").alias("_right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "_left", "_right").mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) whose samples agree often enough and whose weights do not rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(batch), SAMPLES) for k in (2, 3)
            )
            mask = pa.array((left == right).sum(axis=1) >= LEAST_AGREED)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = units.select(F.col("unit").alias("a"), F.col("samples").alias("_left"))
    right = units.select(F.col("unit").alias("b"), F.col("samples").alias("_right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_left", "_right")
    return joined.mapInArrow(run, "a long, b long")


def _possible(threshold: float):
    """Weights of two texts of that similarity differ by no larger factor."""
    return F.least("_wa", "_wb") >= (threshold - 1e-6) * F.greatest("_wa", "_wb")


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one (small) band and different components that their weights do not rule out."""
    left = members.select("band", F.col("unit").alias("a"), F.col("weight").alias("_wa"), F.col("component").alias("_ca"))
    right = members.select("band", F.col("unit").alias("b"), F.col("weight").alias("_wb"), F.col("component").alias("_cb"))
    both = (left["band"] == right["band"]) & (F.col("a") < F.col("b")) & (F.col("_ca") != F.col("_cb")) & _possible(threshold)
    return left.join(right, both).select("a", "b").distinct()


def occurrence_features(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and weight of each shingle occurrence, the n-th occurrence being a feature of its own; and the
    total weight of each document. Common features of two documents add up to the sum of their smaller weights."""
    docs, features, weights = [], [], []
    total = np.zeros(len(column))
    for words in word_chunks(column):
        at, hashes, counts = document_weights(words, None)
        times = counts.astype(np.int64)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        docs.append(np.repeat(at, times) + words.first)
        features.append(mix64(np.repeat(hashes, times) + nth.astype(np.uint64)))
        weights.append(np.repeat(idf[bucket_of(hashes)], times).astype(np.float64))
        np.add.at(total, docs[-1], weights[-1])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(docs, np.int64), join(features, np.uint64), join(weights, np.float64), total


def similar_in_block(texts: pa.Array, left: np.ndarray, right: np.ndarray, idf: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts left[i] and right[j] are similar, for all i and j, by products over some features at a time."""
    docs, features, weights, total = occurrence_features(texts, idf)
    _, feature, counts = np.unique(features, return_inverse=True, return_counts=True)
    shared = counts[feature] > 1
    docs, weights = docs[shared], weights[shared]
    _, feature = np.unique(feature[shared], return_inverse=True)
    order = np.argsort(feature, kind="stable")
    docs, weights, feature = docs[order], weights[order], feature[order]
    common = np.zeros((len(left), len(right)))
    width = 2048
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        some = slice(np.searchsorted(feature, low), np.searchsorted(feature, low + width))
        dense = np.zeros((len(texts), width))
        dense[docs[some], feature[some] - low] = np.sqrt(weights[some])
        common += dense[left] @ dense[right].T
    return common >= threshold * (total[left][:, None] + total[right][None, :] - common) - 1e-9


def _spanning(a: np.ndarray, b: np.ndarray, components_a: np.ndarray, components_b: np.ndarray) -> list[int]:
    """Of links between components, places of enough to connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    _, first = np.unique(np.stack([components_a, components_b]), axis=1, return_index=True)
    out = []
    for k in first.tolist():
        x, y = root(int(components_a[k])), root(int(components_b[k]))
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _block_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Spanning links (a, b) across the components of large bands.

    A band of n members has n / BLOCK blocks, dealt by hash; every pair of blocks is a task's bounded group.
    """
    shared = members.sparkSession.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unit, component = table["unit"].to_numpy(), table["component"].to_numpy()
        block = table["block"].to_numpy()
        ids = np.unique(block)
        left = np.flatnonzero(block == ids[0])
        right = np.flatnonzero(block == ids[-1])
        column = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        alike = similar_in_block(column, left, right, shared.value, threshold)
        alike &= component[left][:, None] != component[right][None, :]
        i, j = np.nonzero(alike)
        a, b = left[i], right[j]
        keep = _spanning(a, b, component[a], component[b]) if len(a) else []
        return pa.table({"a": pa.array(unit[a][keep], pa.int64()), "b": pa.array(unit[b][keep], pa.int64())})

    sizes = members.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).alias("blocks"))
    dealt = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("unit", "band"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = dealt.select("band", "unit", "component", "block", other.alias("_other"))
    paired = paired.select(
        "band", "unit", "component", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")
    )
    whole = paired.join(texts, "unit").select("band", "i", "j", "unit", "component", "block", "text")
    # A pair of blocks one of which got no member needs no comparison with the other, but the other with itself does.
    return whole.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, class_id (the smallest id reachable by links), kept (doc_id = class_id).

    Reads doc_id and text alone, whatever other columns are called. Equal texts are one class. Rows that share an id are
    one document. A null text links with nothing, nor does a text without words but with equal ones; a text of fewer
    than five words is one shingle. A row without an id is compared with nothing, its class_id is null and it is kept.
    An empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    n_docs, counts = document_frequencies(usable)
    idf = inverse_frequencies(n_docs, counts)
    signed = store(signatures(usable, idf), "signatures")
    # Stored, so that the joins below meet two exchanges and a text with very many copies can be split.
    unit_of = store(signed.df.groupBy("digest").agg(F.min("doc_id").alias("unit")), "copies").df
    units = store(
        signed.df.join(unit_of, (signed.df["digest"] == unit_of["digest"]) & (signed.df["doc_id"] == unit_of["unit"]))
        .where("weight > 0")
        .select("unit", "chars", "weight", "bands", "samples"),
        "units",
    )
    links = _links(usable, units, idf, threshold)
    roots = components(links.df)
    links.drop()
    classes = (
        signed.df.select("doc_id", "digest")
        .join(unit_of, "digest")
        .join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("root", "unit")).alias("_class"))
    )
    return (
        rows.select("doc_id")
        .join(classes, "doc_id", "left")
        .select("doc_id", F.coalesce("_class", "doc_id").alias("class_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )


def _links(docs: DataFrame, units: Stored, idf: np.ndarray, threshold: float) -> Stored:
    """Verified links (a, b) between units, enough to connect all that are connected."""
    banded = units.df.select("unit", "chars", "weight", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("unit").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = store(banded.join(leads, "band").select("band", "unit", "lead", "chars", "weight", "n"), "members")
    wanted = members.df.select("unit").distinct()
    texts = store(docs.join(wanted, docs["doc_id"] == wanted["unit"]).select("unit", "text"), "texts")
    weights = units.df.select(F.col("unit").alias("lead"), F.col("weight").alias("_wb"))
    starred = members.df.where("unit <> lead").select("unit", "lead", F.col("weight").alias("_wa")).distinct()
    starred = starred.join(weights, "lead").where(_possible(threshold))
    starred = agreeing(starred.select(F.col("unit").alias("a"), F.col("lead").alias("b")), units.df)
    first = store(verified(starred, texts.df, idf, threshold), "links")
    roots = components(first.df).select(F.col("node").alias("unit"), F.col("root").alias("_root"))
    placed = members.df.join(roots, "unit", "left").withColumn("component", F.coalesce("_root", "unit")).drop("_root", "lead")
    several = placed.groupBy("band").agg((F.min("component") < F.max("component")).alias("_several")).where("_several")
    open_bands = store(placed.join(several.select("band"), "band"), "open")
    pairs = agreeing(_across(open_bands.df.where(F.col("n") <= LISTED), threshold), units.df)
    listed = verified(pairs, texts.df, idf, threshold)
    blocked = _block_links(open_bands.df.where(F.col("n") > LISTED), texts.df, idf, threshold)
    out = store(first.df.union(listed).union(blocked), "links")
    for table in (first, members, open_bands, texts):
        table.drop()
    return out


def without_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the smallest id, with its columns; of repeated rows one stays. Rows without
    an id all stay."""
    kept = near_duplicates(docs, threshold).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    known = docs.join(kept, docs["doc_id"] == kept["_kept"]).drop("_kept").dropDuplicates(["doc_id"])
    return known.union(docs.where(docs["doc_id"].isNull()))
