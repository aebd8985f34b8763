"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors get one more component that brings all candidates to one length (queries: zero), so the largest inner product is the
nearest vector. M Gaussian (2-stable) projections keep distances in proportion: the square of a projected distance
over that of the true one is chi-square with M degrees of freedom.

The projected vectors are indexed by a kd-tree, built and stored once. Its upper splits, which cut space into cells, come
from at most `SAMPLE` vectors, those of the least hashes; every vector is indexed. Below, each block of a cell has leaves
with their boxes. A query takes the leaves of a block in order of projected distance. A vector as near as the
k-th best so far is projected within a certain reach with probability P: vectors within that reach are verified by their
true inner products, those beyond are passed over (the reach only shrinks), and the query stops at the first leaf beyond
it. It begins in its own cell and takes its k-th best score to the cells that its reach touches. Queries that are at one
leaf are worked on together.

Candidates are indexed in ranges of length, each half as long as the one before, scaled by powers of two to one range: a vector that
dwarfs the others stands in a range of its own and leaves their distances as they are. Queries are scaled alike, and begin in
the longest range that fills a block (else in the fullest).

Scores are inner products of the original vectors in double precision. Those that overflow upwards are infinite and rank first;
those that are minus infinity or not a number aren't found. Zero vectors take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import CELLS, LOWEST, clean, extent, matrix, packed, raised, search, top_of

K, M, P, LEAF, BLOCK_ROWS, SAMPLE, SEED = 20, 16, 0.95, 256, 4096, 16_384, 5
#: Of a product of scaled vectors (their lengths are under 2), for rounding.
SLACK = 1e-11


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _log_length(v: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths of rows that aren't zero, without overflow."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    return power + np.log2(np.linalg.norm(np.ldexp(v, -power[:, None]), axis=1))


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The leaves of a kd-tree that halves its widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= size or not spread.any():
            leaves.append(rows)
            continue
        half = len(rows) // 2
        order = rows[np.argpartition(points[rows, spread.argmax()], half)]
        todo += [order[:half], order[half:]]
    return [r for r in leaves if len(r)]


class Splits:
    """The upper part of the kd-tree: each split halves the sample of a cell at its widest side."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.value, self.child = [], [], []  # child: a node, or ~cell
        self.cells = 0
        self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if cells <= 1 or not spread.any():
            self.cells += 1
            return ~(self.cells - 1)
        node, side = len(self.axis), int(spread.argmax())
        middle = float(np.median(points[:, side]))
        left = points[:, side] < middle
        if not left.any():  # half of the sample or more stands at its least
            left = points[:, side] <= middle
            middle = float(np.nextafter(middle, np.inf))
        self.axis.append(side)
        self.value.append(middle)
        self.child.append([0, 0])
        self.child[node] = [self._split(points[left], cells // 2), self._split(points[~left], cells - cells // 2)]
        return node

    def cell(self, points: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(points), np.int64)
        axis, value, child = np.array(self.axis), np.array(self.value), np.array(self.child)
        at, open_ = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(open_):
            node = at[open_]
            at[open_] = child[node, (points[open_, axis[node]] >= value[node]).astype(int)]
            open_ = open_[at[open_] >= 0]
        return ~at


class Projection:
    """Of scaled vectors. top: the binary logarithm of the greatest length."""

    def __init__(self, dim: int, top: float, m: int, p: float, seed: int):
        self.plane = np.random.default_rng(seed).standard_normal((dim + 1, m))
        self.dim, self.top, self.m, self.limit = dim, top, m, chi_square_quantile(p, m)
        self.longest = 2.0 ** (top - math.floor(top))

    def exponents(self, v: np.ndarray) -> np.ndarray:
        """The powers of two by which vectors are scaled: lengths come to longest / 2 up to longest."""
        return math.floor(self.top) - np.floor(self.top - _log_length(v)).astype(np.int64)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -self.exponents(v)[:, None])

    def candidates(self, c: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.longest**2 - (c * c).sum(axis=1), 0))
        return c @ self.plane[: self.dim] + lift[:, None] * self.plane[self.dim]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.plane[: self.dim]

    def reach(self, q: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """The squared projected distance within which better scores are looked for; floors: one for each query, or a row."""
        base = ((q * q).sum(axis=1) + self.longest**2).reshape(-1, *[1] * (floors.ndim - 1))
        return self.limit * np.maximum(0.0, base - 2 * floors)


def _distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes, side by side to keep memory small."""
    out = np.zeros((len(points), len(low)))
    for a in range(points.shape[1]):
        x = points[:, a, None]
        far = np.maximum(0, np.maximum(low[None, :, a] - x, x - high[None, :, a]))
        out += far * far
    return out


def _finish(projection: Projection, leaf: int):
    """A block's leaves: the order of its vectors, their projections, where leaves start and their boxes."""

    def run(ids: np.ndarray, vecs: np.ndarray) -> dict[str, np.ndarray]:
        points = projection.candidates(projection.scaled(vecs))
        leaves = kd_leaves(points, leaf)
        order = np.concatenate(leaves)
        starts = np.cumsum([0, *map(len, leaves)])
        points = points[order]
        boxes = np.array([[points[a:b].min(axis=0), points[a:b].max(axis=0)] for a, b in zip(starts, starts[1:], strict=False)])
        return {"ids": ids[order], "floors": np.empty(0), "vecs": vecs[order], "points": points, "starts": starts.astype(np.int64), "boxes": boxes, "power": projection.exponents(vecs[:1])}

    return run


def _kernel(projection: Projection, k: int):
    m = projection.m

    def run(own: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, c: np.ndarray, points: np.ndarray, starts: np.ndarray, boxes: np.ndarray, power: np.ndarray):
        points, starts, boxes, power = points.reshape(-1, m), starts.view(np.int64), boxes.reshape(-1, 2, m), int(power.view(np.int64)[0])
        powers = projection.exponents(q) + power
        unit = np.ldexp(q, power - powers[:, None])
        reach = lambda asks: projection.reach(unit[asks], np.ldexp(floors[asks], -powers[asks]))
        at = projection.queries(unit)
        far = _distance(at, boxes[:, 0], boxes[:, 1])
        visit = np.argsort(far, axis=1, kind="stable")
        size_at, size_points = (at * at).sum(axis=1), (points * points).sum(axis=1)
        floors = floors.copy()
        best, who = np.full((len(q), k), LOWEST), np.full((len(q), k), np.iinfo(np.int64).max)
        going = np.arange(len(q))
        for step in range(len(boxes)):
            leaf = visit[going, step]
            on = far[going, leaf] <= reach(going)
            going, leaf = going[on], leaf[on]
            if not len(going):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1, append=-1))
            for lo, hi in zip(edges, edges[1:], strict=False):
                who_asks, l = going[by_leaf[lo:hi]], leaf[by_leaf[lo]]  # noqa: E741
                rows = slice(starts[l], starts[l + 1])
                gap = size_at[who_asks, None] + size_points[rows] - 2 * (at[who_asks] @ points[rows].T)
                product = unit[who_asks] @ np.ldexp(c[rows], -power).T
                least = np.ldexp(floors[who_asks], -powers[who_asks])[:, None] - SLACK
                good = (gap <= reach(who_asks)[:, None] * (1 + 1e-9)) & (product >= least) & (ids[rows] != own[who_asks, None])
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                # the same sum for the same vectors, wherever they stand
                exact = np.einsum("ij,ij->i", q[who_asks[i]], c[rows][j])
                exact[np.isnan(exact)] = LOWEST
                asks, place = np.unique(i, return_inverse=True)
                turn = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                width = int(turn.max()) + 1
                scores, names = np.full((len(asks), width), LOWEST), np.full((len(asks), width), np.iinfo(np.int64).max)
                scores[place, turn], names[place, turn] = exact, ids[rows][j]
                asks = who_asks[asks]
                scores, names = top_of(np.concatenate((best[asks], scores), axis=1), np.concatenate((who[asks], names), axis=1), k)
                best[asks], who[asks] = scores, names
                floors[asks] = raised(floors[asks], scores, LOWEST)
        return best, who

    def quietly(*args):
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            return run(*args)

    return quietly


def _assign(dim: int, cell_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(matrix(part.column(1), dim)), pa.int64()), *part.columns], names=["cell", "id", "vec"])

    return run


def _levels(dim: int):
    """The logarithm of each vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(_log_length(matrix(batch.column(0).slice(at, 4096), dim)))], names=["level"])

    return run


class Cells:
    """Numbers of the cells: those of each range of lengths in turn, longest first."""

    def __init__(self, projection: Projection, sizes: dict[int, int], sample: np.ndarray):
        self.projection, total = projection, sum(sizes.values())
        self.powers, self.first, self.splits, at = sorted(sizes, reverse=True), [], [], 0
        powers = projection.exponents(sample) if len(sample) else np.empty(0, np.int64)
        for power in self.powers:
            cells = max(1, min(-(-sizes[power] // BLOCK_ROWS), CELLS * sizes[power] // total))
            points = projection.candidates(np.ldexp(sample[powers == power], -power)) if cells > 1 else np.empty((0, projection.m))
            self.splits.append(Splits(points, cells))
            self.first.append(at)
            at += self.splits[-1].cells

    def of(self, v: np.ndarray) -> np.ndarray:
        powers, out = self.projection.exponents(v), np.empty(len(v), np.int64)
        for power, first, splits in zip(self.powers, self.first, self.splits, strict=True):
            on = powers == power
            if on.any():
                out[on] = first + splits.cell(self.projection.candidates(np.ldexp(v[on], -power)))
        return out

    def power(self, cells: np.ndarray) -> np.ndarray:
        return np.array(self.powers)[np.searchsorted(self.first, cells, side="right") - 1]


def _boxes(m: int):
    """Each block's own box, a row for each side of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, boxes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(boxes).reshape(-1, 2, m)
                yield pa.RecordBatch.from_arrays([pa.array([cell] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array(b[:, 0].min(axis=0)), pa.array(b[:, 1].max(axis=0))], names=["cell", "side", "low", "high"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = K, m: int = M, p: float = P, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of about k largest inner products of each query, among df's other ids."""
    used = lambda d: clean(d, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    vectors = used(df)
    dim, n = extent(vectors)
    if not n:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    levels = staged(vectors.select("vec").mapInArrow(_levels(dim), "level double"), "levels")
    top = levels.agg(F.max("level")).first()[0]
    projection = Projection(dim, top, m, p, seed)
    # at most as many ranges as doubles have exponents
    sizes = dict(map(tuple, levels.groupBy((math.floor(top) - F.floor(F.lit(top) - F.col("level"))).alias("power")).count().collect()))
    some = vectors.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks() if n > BLOCK_ROWS else None
    known_cells = Cells(projection, sizes, matrix(some, dim) if some is not None else np.empty((0, dim)))

    placed = vectors.mapInArrow(_assign(dim, known_cells.of), "cell bigint, id bigint, vec array<double>")
    together = placed.repartitionByRange(max(1, -(-n // (4 * BLOCK_ROWS))), "cell", "id").sortWithinPartitions("cell", "id")
    more = ("points", "starts", "boxes", "power")
    index = staged(packed(together, dim, BLOCK_ROWS, _finish(projection, LEAF), more), "index")

    sides = index.select("cell", "boxes").mapInArrow(_boxes(m), "cell bigint, side bigint, low double, high double").groupBy("cell", "side").agg(F.min("low"), F.max("high")).collect()
    names = np.array(sorted({r[0] for r in sides}), np.int64)
    low, high = np.empty((len(names), m)), np.empty((len(names), m))
    for cell, side, lo, hi in sides:
        at = np.searchsorted(names, cell)
        low[at, side], high[at, side] = lo, hi
    powers = known_cells.power(names)
    begin = max(sizes, key=lambda power: (min(sizes[power], BLOCK_ROWS), power))
    homes = powers == begin

    def home(asked: DataFrame) -> DataFrame:
        return asked.mapInArrow(_assign(dim, lambda v: names[homes][_distance(projection.queries(projection.scaled(v)), low[homes], high[homes]).argmin(axis=1)]), "cell bigint, id bigint, vec array<double>")

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q, own, floors = matrix(part.column("vec"), dim), part.column("cell").to_numpy(), part.column("floor").to_numpy()
                unit = projection.scaled(q)
                with np.errstate(over="ignore", under="ignore"):
                    reach = projection.reach(unit, np.ldexp(floors[:, None], -(projection.exponents(q)[:, None] + powers)))
                near = (_distance(projection.queries(unit), low, high) <= reach) & (names[None, :] != own[:, None])
                row, cell = np.nonzero(near)
                row_index = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(names[cell]), part.column("id").take(row_index), part.column("vec").take(row_index), part.column("floor").take(row_index)], names=["cell", "id", "vec", "floor"])

    others = lambda known: known.select("cell", "id", "vec", "floor").mapInArrow(touched, "cell bigint, id bigint, vec array<double>, floor double")
    return search(used(queries), index, dim, _kernel(projection, k), k, "double", home, others, more)
