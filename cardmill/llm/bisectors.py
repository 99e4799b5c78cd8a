"""Centroid clustering of integer vectors by a tournament of bisectors, exact in every step.

For centroids a and b the vectors nearer to a than to b satisfy 2 (b - a) . x < |b|^2 - |a|^2, all in integers. Normals and
thresholds of all pairs are computed once a round. A vector's champion meets the other centroids in the order of their
numbers: one sign test each, k - 1 in all; zero favours the smaller number. Only the winner's distance is computed.

Vectors are read where they lie, each task sends a few sums per centroid and component, and k centroids are all the driver
sees. Components beyond +-2^27 go through Python's integers, so no sum ever overflows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.scratch import store

K = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
#: Below this, differences, products and sums of up to 64 components stay within 62 bits.
SMALL = 1 << 27
#: Sums travel as digits of this many bits, low one first, each with the sign of the sum.
LIMB = 48
#: Vectors of a block of the tournament.
BLOCK = 4096

ASSIGNED = "vec_id long, cluster int, distance decimal(24,0)"
SUMS = "cluster int, component int, limb int, total long, n long"


def integers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has exactly ``dimensions`` components, none null or non-finite, and floor(scale * x) of these.

    int64, or Python integers where a component leaves +-SMALL.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = np.array(column.value_lengths().fill_null(-1)) == dimensions
    flat = column.filter(pa.array(fits)).flatten()
    x = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimensions)  # null: not a number
    finite = np.isfinite(x).all(axis=1)
    rows, x = np.flatnonzero(fits)[finite], x[finite]
    if (np.abs(x) * scale < SMALL).all():
        return rows, np.floor(x * scale).astype(np.int64)
    exact = [[_floor(v, scale) for v in row] for row in x.tolist()]
    return rows, np.array(exact, dtype=object).reshape(-1, dimensions)


def _floor(value: float, scale: int) -> int:
    up, down = value.as_integer_ratio()
    return scale * up // down


@dataclass
class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    centroids: np.ndarray  # int64, or objects beyond SMALL
    normals: np.ndarray  # [a, b, component]
    thresholds: np.ndarray  # [a, b]

    @staticmethod
    def between(centroids: list[list[int]]) -> Bisectors:
        if not centroids:
            nothing = np.empty((0, 0), np.int64)
            return Bisectors(nothing, nothing, nothing)
        small = all(abs(v) <= SMALL for c in centroids for v in c)
        c = np.array(centroids, dtype=np.int64 if small else object).reshape(len(centroids), -1)
        squares = (c * c).sum(axis=1)
        return Bisectors(c, 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (smaller number among equals) and squared distance of each vector."""
        if x.dtype == object or self.centroids.dtype == object:
            x = x.astype(object)
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            for holder in np.unique(champion):  # one normal for all vectors with the same champion
                rows = np.flatnonzero(champion == holder)
                lost = x[rows] @ self.normals[holder, rival] > self.thresholds[holder, rival]
                champion[rows[lost.astype(bool)]] = rival
        gap = x - self.centroids[champion]
        return champion, (gap * gap).sum(axis=1)


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the kept rows, a block at a time; the vector is the last column."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            rows, x = integers(part.column(part.num_columns - 1), dimensions, scale)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def _limbs(total: int) -> list[int]:
    sign, rest, out = (-1 if total < 0 else 1), abs(int(total)), []
    while rest or not out:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def first_centroids(rows: DataFrame, k: int, dimensions: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the smallest hash of their id; null ids last, equal ids by their components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.select("vec_id", x.alias("embedding")).where((F.size(x) == dimensions) & finite)
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(key.asc_nulls_last(), F.col("embedding").asc()).limit(k).collect()
    return [[_floor(v, scale) for v in row["embedding"]] for row in top]


def moved(rows: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> list[list[int]]:
    """Every centroid that has vectors becomes floor(sum / count) of their components; the others stay."""
    bisectors = Bisectors.between(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for _, x in _batches(batches, dimensions, scale):
            cluster, _ = bisectors.nearest(x)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                part = own.sum(axis=0).tolist()
                sums[c] = [a + b for a, b in zip(sums[c], part)] if c in sums else part
                counts[c] = counts.get(c, 0) + len(own)
        out = [
            (c, i, j, limb, counts[c])
            for c, total in sums.items()
            for i, value in enumerate(total)
            for j, limb in enumerate(_limbs(value))
        ]
        columns = zip(*out) if out else [[]] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["cluster", "component", "limb", "total", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    found = (
        rows.mapInArrow(run, SUMS)
        .groupBy("cluster", "component", "limb")
        .agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    total: dict[tuple[int, int], int] = {}
    count: dict[int, int] = {}
    for row in found:
        place = (row["cluster"], row["component"])
        total[place] = total.get(place, 0) + (int(row["total"]) << LIMB * row["limb"])
        if row["component"] == 0 and row["limb"] == 0:  # a sum of any size has a lowest digit
            count[row["cluster"]] = row["n"]
    return [
        [total[c, i] // count[c] for i in range(dimensions)] if c in count else centroid
        for c, centroid in enumerate(centroids)
    ]


def assigned(rows: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector; null where the distance has over 24 digits."""
    bisectors = Bisectors.between(centroids)
    kind = pa.decimal128(24, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, dimensions, scale):  # of an empty table or of vectors that are not kept: none
            cluster, distance = bisectors.nearest(x)
            if distance.dtype == object:
                far = pa.array([None if d >= 10**24 else int(d) for d in distance], kind)
            else:
                far = pa.array(distance).cast(kind)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), far], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, ASSIGNED)


def clusters(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """Rows of (vec_id, cluster, distance, cluster_inertia, inertia), and the final centroids by number.

    ``vectors`` needs vec_id and embedding; other columns are ignored whatever their names. One row per vector with exactly
    ``dimensions`` components, none null or non-finite; other rows are left out. Repeated rows are vectors of their own; a
    null vec_id stays null and is chosen last as a start. With fewer than k vectors each is a centroid; equal ones leave
    the later number empty, and an empty centroid stays where it is. An empty table gives no row. Distances and their sums
    are exact decimals; a distance of over 24 digits is null, and so are the sums that hold it.
    """
    number_type = vectors.schema["embedding"].dataType.elementType.typeName()
    x = F.col("embedding") if number_type in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    centroids = first_centroids(rows, k, dimensions, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids, dimensions, scale)
    found = store(assigned(rows, centroids, dimensions, scale), "clusters").df
    lost = F.count("*") > F.count("distance")
    by_cluster = {
        r["cluster"]: None if r["total"] is None else int(r["total"])
        for r in found.groupBy("cluster").agg(F.when(~lost, F.sum("distance")).alias("total")).collect()
    }
    whole = None if None in by_cluster.values() else sum(by_cluster.values())
    number = lambda v: F.lit(None if v is None else str(v)).cast("decimal(38,0)")
    inertia = F.lit(None).cast("decimal(38,0)")
    for c, total in by_cluster.items():
        inertia = F.when(F.col("cluster") == c, number(total)).otherwise(inertia)
    return found.withColumn("cluster_inertia", inertia).withColumn("inertia", number(whole)), centroids
