"""Vector arm: exact cosine scan in blocks, int8 quantization, parity checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.scoring import cosine, is_usable
from cardmill.operators.lexical import top_k
from cardmill.session import written

#: Bytes of queries that are broadcast at a time.
QUERY_BYTES = 8 << 20
#: Rows of the corpus that are cut into blocks together, and blocks they are cut into.
CELL_ROWS, CELLS = 2048, 16
SLACK = 1e-8

FOUND = "query_id long, subject_id long, score double"
REPORT_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64())


def same_model(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Only vectors that can be compared; a different dimension is skipped, not an error."""
    return vectors.filter((F.col("model") == model) & (F.size("vector") == dim))


def vector_rows(df: DataFrame, model: str) -> DataFrame:
    """What the vector store keeps: usable vectors with their dimension and model."""
    return df.filter(is_usable(F.col("vector"))).select(
        "subject_id", "vector", F.size("vector").alias("dim"), F.lit(model).alias("model")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _by_kind(models: pa.Array, sizes: np.ndarray) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """Rows of each (model, dimension); rows without either are left out."""
    codes = models.dictionary_encode()
    index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    for code in np.unique(index[index >= 0]):
        for dim in np.unique(sizes[(index == code) & (sizes > 0)]):
            yield (codes.dictionary[int(code)].as_py(), int(dim)), np.flatnonzero((index == code) & (sizes == dim))


class Best:
    """The best subjects of one kind's queries so far, and how much of the corpus could be passed over."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: float):
        self.ids, self.queries, self.k, self.floor = ids, queries, k, floor
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.least = np.full(len(ids), floor)  # a lower score is not among the best
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        self.blocks = self.skipped = 0

    def meet(self, x: np.ndarray, subjects: np.ndarray) -> None:
        """Scores a batch of the corpus in blocks of near vectors; vectors with a component that is no number match nothing.

        No vector of a block scores above (query . centre) + |query| * radius, so queries that this cannot help stay out.
        """
        finite = np.isfinite(x).all(axis=1)
        x, subjects = (x, subjects) if finite.all() else (x[finite], subjects[finite])
        for low in range(0, len(x), CELL_ROWS):
            part, ids = x[low : low + CELL_ROWS], subjects[low : low + CELL_ROWS]
            pivots = part[:: max(1, len(part) // CELLS)][:CELLS]
            apart = (pivots * pivots).sum(axis=1) - 2 * part @ pivots.T
            cell = apart.argmin(axis=1)
            for c in np.unique(cell):
                self._block(part[cell == c], ids[cell == c])

    def _block(self, x: np.ndarray, subjects: np.ndarray) -> None:
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
        self.blocks += len(self.ids)
        asked = np.flatnonzero(self.queries @ centre + self.norms * radius + SLACK >= self.least)
        self.skipped += len(self.ids) - len(asked)
        if len(asked) == 0:
            return
        scores = np.clip(self.queries[asked] @ x.T, -1.0, 1.0)
        better = scores >= self.least[asked][:, None] - SLACK
        for row in np.flatnonzero(better.any(axis=1)):
            i = asked[row]
            hits = np.flatnonzero(better[row] & (scores[row] >= self.floor))
            old_scores, old_ids = self.found[i]
            values, ids = np.concatenate([old_scores, scores[row][hits]]), np.concatenate([old_ids, subjects[hits]])
            if len(values) > self.k:
                order = np.lexsort((ids, -np.round(values, 9)))[: self.k]
                values, ids = values[order], ids[order]
            self.found[i] = (values, ids)
            if len(values) == self.k:
                self.least[i] = max(self.floor, values.min())


def _scan(shared, k: int, floor: float, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {kind: Best(ids, queries, k, floor) for kind, (ids, queries) in shared.value.items()}
        for batch in batches:
            sizes = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for kind, rows in _by_kind(batch.column(1), sizes):
                if kind in best:
                    some = batch.take(pa.array(rows))
                    best[kind].meet(_matrix(some.column(2), kind[1]), some.column(0).to_numpy())
        for (model, dim), b in best.items():
            if report:
                cells = [[model], [dim], [b.blocks], [b.skipped]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, REPORT_TYPES)], ["model", "dim", "blocks", "skipped"])
                continue
            cells = [
                np.repeat(b.ids, [len(v) for v, _ in b.found]),
                np.concatenate([ids for _, ids in b.found]),
                np.concatenate([values for values, _ in b.found]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "subject_id", "score"])

    return run


def _query_batches(queries: DataFrame) -> Iterator[dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]]:
    """The queries by kind, at most QUERY_BYTES at a time; one partition and one batch are on the driver."""
    held: dict[tuple[str, int], list[tuple[int, list[float]]]] = {}
    size = 0

    def packed():
        return {kind: (np.array([q for q, _ in rows], np.int64), np.array([v for _, v in rows], np.float64)) for kind, rows in held.items()}

    for row in queries.select("query_id", "model", "vector").dropna().filter(F.size("vector") > 0).toLocalIterator():
        cost = 8 * len(row["vector"])
        if held and size + cost > QUERY_BYTES:
            yield packed()
            held, size = {}, 0
        held.setdefault((row["model"], len(row["vector"])), []).append((row["query_id"], row["vector"]))
        size += cost
    if held:
        yield packed()


def _scans(queries: DataFrame, corpus: DataFrame, k: int, floor: float, schema: str, report: bool) -> DataFrame:
    rows = corpus.select(F.col("subject_id").cast("long"), "model", "vector")
    found: list[DataFrame] = []
    for batch in _query_batches(queries):
        shared = corpus.sparkSession.sparkContext.broadcast(batch)
        found.append(rows.mapInArrow(_scan(shared, k, floor, report), schema))
    if not found:
        return corpus.sparkSession.createDataFrame([], schema)
    # One batch of queries, as usual, is one scan; of more batches each scan's result is stored when it is done.
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, [written(f) for f in found])


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int = fixed.ARM_LIMIT, floor: float = fixed.SIMILARITY_FLOOR
) -> DataFrame:
    """Exact top-k by cosine for (query_id, vector, model) against (subject_id, vector, model).

    The corpus stays where it is read; queries travel to it, some megabytes at a time. Every task keeps k subjects per
    query and passes over blocks that cannot reach them, so what is shuffled is k rows per query and task.
    """
    return top_k(_scans(queries, corpus, k, floor, FOUND, False), k).select("query_id", "subject_id", "score", "rank")


def scan_report(queries: DataFrame, corpus: DataFrame, k: int = fixed.ARM_LIMIT, floor: float = fixed.SIMILARITY_FLOOR) -> DataFrame:
    """(model, dim, blocks, skipped): pairs of a query and a block of the corpus, and how many of them were passed over."""
    found = _scans(queries, corpus, k, floor, "model string, dim int, blocks long, skipped long", True)
    return found.groupBy("model", "dim").agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))


# --- quantization --------------------------------------------------------------------------------


def quantize_int8(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Symmetric per-row int8: scale = max|x| / 127 in single precision, values rounded half to even."""
    largest = F.aggregate(
        vector, F.lit(0.0).cast("float"), lambda m, x: F.greatest(m, F.abs(x).cast("float"))
    )
    return df.withColumn("scale", (largest.cast("double") / 127.0).cast("float")).withColumn(
        "scale", F.when(F.col("scale") == 0, F.lit(1.0).cast("float")).otherwise(F.col("scale"))
    ).withColumn(
        "quantized",
        F.transform(
            vector,
            lambda x: F.greatest(
                F.lit(-127.0),
                F.least(F.lit(127.0), F.rint((x.cast("double") / F.col("scale").cast("double")).cast("float"))),
            ).cast("tinyint"),
        ),
    )


def dequantize(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "restored",
        F.transform(
            "quantized", lambda q: (q.cast("double") * F.col("scale").cast("double")).cast("float")
        ),
    )


def quantize_quality(df: DataFrame, vector: str = "vector", gate: float = 0.999) -> DataFrame:
    """Largest absolute error and worst cosine over all rows, and whether the gate holds."""
    restored = dequantize(quantize_int8(df, vector))
    gap = F.array_max(F.zip_with(vector, "restored", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))

    def norm(col: str):
        return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    dot = F.aggregate(
        F.zip_with(vector, "restored", lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return (
        restored.select(gap.alias("gap"), (dot / (norm(vector) * norm("restored"))).alias("cos"))
        .agg(F.max("gap").alias("max_abs_error"), F.min("cos").alias("worst_cosine"))
        .withColumn("passes", F.col("worst_cosine") >= gate)
    )


def vector_parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Same subjects from two runs: largest difference per vector, null when one side is missing."""
    left = a.select("subject_id", F.col("vector").alias("va"))
    right = b.select("subject_id", F.col("vector").alias("vb"))
    gap = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return (
        left.join(right, "subject_id", "full")
        .withColumn("gap", F.when(F.size("va") == F.size("vb"), gap))
        .select("subject_id", "gap", F.coalesce(F.col("gap") <= tolerance, F.lit(False)).alias("same"))
    )


def pairwise_margin(df: DataFrame) -> DataFrame:
    """(id, anchor, related, unrelated) vectors: related above 0.3 and 0.25 clear of the unrelated one."""
    return (
        df.withColumn("near", cosine(F.col("anchor"), F.col("related")))
        .withColumn("far", cosine(F.col("anchor"), F.col("unrelated")))
        .withColumn("holds", (F.col("near") > 0.3) & (F.col("near") > F.col("far") + 0.25))
        .select("id", "near", "far", "holds")
    )

