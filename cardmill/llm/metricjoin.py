"""Embedding near-duplicates: an exact metric range join under pivots.

On unit vectors cosine >= c is Euclidean distance <= r = sqrt(2 - 2c). Every vector's home is the cell of its nearest
pivot. By the triangle inequality it can have a partner at home in cell j only if d(x, p_j) <= d(x, p_home) + 2r and if it
is within r of the plane halfway between both pivots; it visits those cells. So all partners of a vector visit its home,
cells are joined independently, and each vector's links are counted where it is at home. Homes of a cell are dealt to
groups of bounded size; visitors stream past them, so no group has to fit into memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.components import components
from cardmill.llm.scratch import Stored, store

COSINE = 0.95
#: Vectors of a pivot's cell on average, up to MAX_PIVOTS (they are broadcast); homes of a group; visitors at a time.
PER_PIVOT, MAX_PIVOTS, HOMES, VISITORS = 4096, 1024, 4096, 1024
#: Cosines are sums of products in double precision; a sum this little below the bound counts as equal to it.
ROUNDING = 1e-13


def directions(vectors: DataFrame) -> DataFrame:
    """vec_id and the unit vector as little-endian doubles: null for null, empty, zero or non-finite vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            out = []
            for end, size in zip(ends.tolist(), sizes.tolist()):
                own = values[end - size : end]
                top = np.abs(own).max() if size else 0.0
                if not np.isfinite(top) or top == 0:  # a NaN anywhere makes the maximum NaN
                    out.append(None)
                else:
                    own = own / top
                    out.append((own / np.sqrt(own @ own)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "direction"])

    wanted = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return wanted.mapInArrow(run, "vec_id long, direction binary")


def matrix_of(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.empty((0, 0))


def by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the vectors of each dimension."""
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def fitted(pivots: np.ndarray, dimension: int) -> np.ndarray:
    """Pivots cut or filled up with zeros: any point may be a pivot."""
    return np.pad(pivots, ((0, 0), (0, max(0, dimension - pivots.shape[1]))))[:, :dimension]


class Cells:
    """The pivots as vectors of one dimension, their squares, and their distances from each other, computed once."""

    def __init__(self, pivots: np.ndarray, dimension: int, radius: float):
        self.pivots = fitted(pivots, dimension)
        self.squares = (self.pivots * self.pivots).sum(axis=1)
        self.radius = radius
        apart = self.squares[:, None] + self.squares - 2 * self.pivots @ self.pivots.T
        self.between = np.sqrt(np.maximum(apart, 0, out=apart), out=apart)

    def _squares_to(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(axis=1)[:, None] + self.squares - 2 * x @ self.pivots.T
        return np.maximum(squares, 0, out=squares)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivot of each vector."""
        return self._squares_to(x).argmin(axis=1)

    def visits(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which cells a vector must meet (vectors x pivots), its home among them; valid whichever cell is its home."""
        squares = self._squares_to(x)
        at = np.arange(len(x))
        own_square = squares[at, home][:, None]
        slack = 1e-7
        visits = squares - own_square <= 2 * self.radius * self.between[home] + slack
        np.sqrt(squares, out=squares)
        visits &= squares <= squares[at, home][:, None] + 2 * self.radius + slack
        visits[at, home] = True
        return visits


def cells_by_dimension(pivots: np.ndarray, radius: float):
    """The cells of each dimension, made when first asked for."""
    made: dict[int, Cells] = {}

    def get(dimension: int) -> Cells:
        if dimension not in made:
            made[dimension] = Cells(pivots, dimension, radius)
        return made[dimension]

    return get


PLACED = "unit long, code long, copies long, direction binary, dimension int, home int"
MEETING = "cell long, part int, role int, unit long, code long, copies long, direction binary"
_MEETING = pa.schema(
    [
        ("cell", pa.int64()), ("part", pa.int32()), ("role", pa.int32()), ("unit", pa.int64()), ("code", pa.int64()),
        ("copies", pa.int64()), ("direction", pa.binary()),
    ]
)
FOUND = "is_link boolean, a long, b long, n long"
_FOUND = pa.schema([("is_link", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _pivots(classes: DataFrame) -> np.ndarray:
    """Pivots drawn by hash, a bounded number."""
    n = min(MAX_PIVOTS, max(1, -(-classes.count() // PER_PIVOT)))
    rows = classes.orderBy(F.xxhash64("direction", F.lit(1)), "direction").limit(n).collect()
    vectors = [np.frombuffer(bytes(r["direction"]), "<f8") for r in rows]
    size = max((len(v) for v in vectors), default=1)
    return np.stack([np.pad(v, (0, size - len(v))) for v in vectors]) if vectors else np.zeros((1, 1))


def _place(classes: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cells_by_dimension(pivots, radius)
        for batch in batches:
            sizes = np.array([len(d) // 8 for d in batch.column(3).to_pylist()], np.int64)
            for rows in by_size(sizes):
                for low in range(0, len(rows), VISITORS):
                    part = batch.take(pa.array(rows[low : low + VISITORS]))
                    x = matrix_of(part.column(3))
                    home = cells(x.shape[1]).home(x)
                    size = np.full(len(x), x.shape[1], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(size), pa.array(home.astype(np.int32))],
                        ["unit", "code", "copies", "direction", "dimension", "home"],
                    )

    return classes.select("unit", "code", "copies", "direction").mapInArrow(run, PLACED)


def _meet(placed: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """A row for each vector at home in its group, and one for each group of each cell that it visits."""
    counts = placed.groupBy("dimension", "home").count().collect()  # at most one row per pivot and dimension
    groups = {(r["dimension"], r["home"]): -(-r["count"] // HOMES) for r in counts}
    parts = {d: np.array([groups.get((d, k), 0) for k in range(len(pivots))]) for d in {d for d, _ in groups}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cells_by_dimension(pivots, radius)
        for batch in batches:
            for rows in by_size(batch.column(4).to_numpy()):
                for low in range(0, len(rows), VISITORS):
                    some = batch.take(pa.array(rows[low : low + VISITORS]))
                    x = matrix_of(some.column(3))
                    size, n = x.shape[1], parts[x.shape[1]]
                    home = some.column(5).to_numpy().astype(np.int64)
                    visits = cells(size).visits(x, home)
                    own_part = (some.column(1).to_numpy().view(np.uint64) % n[home].astype(np.uint64)).astype(np.int32)
                    row, cell = np.nonzero(visits & (n > 0))
                    times = n[cell]
                    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    all_rows = pa.array(np.concatenate([np.arange(len(x)), row]))
                    base = np.int64(size) << 32
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([home, cell]) + base),
                            pa.array(np.concatenate([own_part, nth.astype(np.int32)])),
                            pa.array(np.repeat([0, 1], [len(x), len(row)]).astype(np.int32)),
                            *(some.column(k).take(all_rows) for k in range(4)),
                        ],
                        schema=_MEETING,
                    )

    return placed.mapInArrow(run, MEETING)


class Group:
    """Homes of one group; visitors come in batches and are forgotten."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.parts: list[np.ndarray] = []
        self.units: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []

    def add(self, x: np.ndarray, units: np.ndarray, codes: np.ndarray) -> None:
        self.parts.append(x)
        self.units.append(units)
        self.codes.append(codes)

    def close(self) -> bool:
        """Whether the group has homes: vectors are dealt to the groups of a cell by their code, so one may stay empty."""
        if not self.parts:
            return False
        self.x, self.unit, self.code = (np.concatenate(p) for p in (self.parts, self.units, self.codes))
        self.n = np.zeros(len(self.x), np.int64)
        self.label = np.arange(len(self.x))
        return True

    def visit(self, x: np.ndarray, units: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts what the homes meet and gives a link of each visitor with a partner other than itself."""
        alike = self.x @ x.T >= self.cosine - ROUNDING
        self.n += alike @ copies
        visitor, home = np.nonzero(alike.T)
        if len(visitor) == 0:
            return units[:0], units[:0]
        starts = np.flatnonzero(np.append(True, visitor[1:] != visitor[:-1]))
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(visitor))))
        while True:  # homes with a common visitor get one label
            own = self.label[home]
            least = np.minimum.reduceat(own, starts)[which]
            if (least == own).all():
                break
            np.minimum.at(self.label, own, least)
            while (up := self.label[self.label] != self.label).any():
                self.label[up] = self.label[self.label][up]
        a, b = units[visitor[starts]], self.unit[home[starts]]
        return a[a != b], b[a != b]

    def finish(self) -> pa.RecordBatch:
        """Links per home, itself left out, and links that join the homes of one label."""
        joined = np.flatnonzero(self.unit[self.label] != self.unit)
        n, m = len(self.n), len(joined)
        cells = [
            np.repeat([False, True], [n, m]),
            np.concatenate([self.unit, self.unit[joined]]),
            np.concatenate([self.code, self.unit[self.label[joined]]]),
            np.concatenate([self.n - 1, np.zeros(m, np.int64)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=_FOUND)


def _join_cells(meetings: DataFrame, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, closed, lived_in = Group(cosine), None, False, False
        for batch in batches:
            cell, part, role = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            bounds = np.concatenate(([0], cuts, [len(batch)]))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if low == high:
                    continue
                if (cell[low], part[low]) != key:
                    if lived_in:
                        yield group.finish()
                    group, key, closed, lived_in = Group(cosine), (cell[low], part[low]), False, False
                for at in range(low, high, VISITORS):
                    some = batch.slice(at, min(VISITORS, high - at))
                    x, units = matrix_of(some.column(6)), some.column(3).to_numpy()
                    if role[low] == 0:
                        group.add(x, units, some.column(4).to_numpy())
                        continue
                    if not closed:
                        closed, lived_in = True, group.close()
                    if not lived_in:
                        continue
                    a, b = group.visit(x, units, some.column(5).to_numpy())
                    cells = [np.ones(len(a), bool), a, b, np.zeros(len(a), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=_FOUND)
        if lived_in:  # homes visit their own group, so one with homes has been closed
            yield group.finish()

    dealt = meetings.repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    return dealt.mapInArrow(run, FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Reads vec_id and embedding alone, whatever other columns are called. Vectors that are null, empty or zero or that
    hold null or non-finite components link with nothing, nor do vectors of different lengths or rows without an id;
    the latter have no component and are kept. Equal vectors are compared once and link with each other. Rows that share
    an id are in one component. An empty table gives no row.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    rows = store(directions(vectors).withColumn("code", F.xxhash64("direction")), "directions")
    usable = rows.df.where("vec_id IS NOT NULL AND direction IS NOT NULL")
    classes: Stored = store(
        usable.groupBy("direction", "code").agg(F.min("vec_id").alias("unit"), F.count("*").alias("copies")), "classes"
    )
    pivots = _pivots(classes.df)
    placed = store(_place(classes.df, pivots, radius), "placed")
    found = store(_join_cells(_meet(placed.df, pivots, radius), cosine), "found")
    placed.drop()
    roots = components(found.df.where("is_link").select("a", "b"))
    counts = found.df.where("NOT is_link").select(F.col("a").alias("unit"), F.col("b").alias("code"), "n")
    same_id = usable.join(classes.df.select("direction", "code", "unit"), ["direction", "code"])
    of_row = (
        classes.df.select("direction", "code", "unit")
        .join(counts, ["unit", "code"])
        .join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left")
        .select("direction", "code", "n", F.coalesce("root", "unit").alias("component"))
    )
    shared = same_id.groupBy("vec_id").agg(F.min("unit").alias("_low"), F.max("unit").alias("_high")).where("_low <> _high")
    if not shared.isEmpty():  # rows of one id with different vectors tie their components together
        ties = same_id.select(F.col("vec_id").alias("a"), F.col("unit").alias("b"))
        roots = components(found.df.where("is_link").select("a", "b").union(ties))
        up = roots.select(F.col("node").alias("component"), F.col("root").alias("_up"))
        of_row = of_row.join(up, "component", "left").select("direction", "code", "n", F.coalesce("_up", "component").alias("component"))
    return (
        rows.df.withColumn("_match", F.col("vec_id").isNotNull() & F.col("direction").isNotNull())
        .join(of_row.withColumn("_match", F.lit(True)), ["direction", "code", "_match"], "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
