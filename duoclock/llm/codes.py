"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Vectors become whole numbers, floor(scale * x), and are cut into equal parts. A part position's codebook is trained by
Lloyd's rounds with a filter: every partition lays its vectors in blocks and builds, once, a kd-tree over each part of a
block, whose nodes keep their bounding box and the sum of their points. A round goes down the trees with the entries
that can still be nearest to some point of a box; where one entry is left, the whole subtree is its own, by the cached
sum and count, and only leaves where several are left look at points. Blocks with their trees are stored in the shared folder, a row each;
a round reads them once and gives sums and counts for each entry, so what reaches the driver is as large as the codebooks.

All arithmetic is on whole numbers and exact, whatever the size of a component: parts with a component beyond `NEAR`
are looked at one by one in Python's integers, and an entry too large for 64 bits is first held against a block's
outer box. Ties go to the lower entry. Entries that no part is nearest to stay as they are.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors, and those whose size the
number of parts doesn't divide, count as ending in zeros. A null id is kept and comes last in order; rows that share
an id are different vectors, in the order of their components. Fewer vectors than entries: as many entries as vectors.
An error beyond a bigint is null. No rows: no rows and empty codebooks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS, LEAF = 4096, 16
#: Components up to this size are in trees; a limb of a sum that is sent in pieces.
NEAR, LIMB = 1 << 20, 32
_FAR = np.iinfo(np.int64).max
_TREE = "points binary, order binary, low binary, high binary, total binary, wide_at binary, wide array<array<string>>"
Book = list[list[list[int]]]


def _floor(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def levels_of(n: int, leaf: int) -> list[np.ndarray]:
    """Where nodes start and end, for each level of a tree over n points: halves of halves, down to leaves."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        edges = out[-1]
        split = np.empty(2 * len(edges) - 1, np.int64)
        split[::2], split[1::2] = edges, (edges[:-1] + edges[1:]) // 2
        out.append(split)
    return out


def build(points: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """The points in the tree's order, their places before, and low and high corners and sums of all nodes, level by level."""
    order, low, high, total = np.arange(len(points)), [], [], []
    levels = levels_of(len(points), leaf)
    for edges in levels:
        low.append(np.minimum.reduceat(points, edges[:-1]))
        high.append(np.maximum.reduceat(points, edges[:-1]))
        total.append(np.add.reduceat(points.astype(np.int64), edges[:-1]))
        if edges is not levels[-1]:  # each node's points by its widest side
            node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            axis = (high[-1] - low[-1]).argmax(axis=1)
            turn = np.lexsort((points[np.arange(len(points)), axis[node]], node))
            points, order = points[turn], order[turn]
    return points, order, np.concatenate(low), np.concatenate(high), np.concatenate(total)


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


def _gap(z: list[int], star: list[int], low: list[int], high: list[int]) -> int:
    """The least that z is farther than star, over the box."""
    corner = [b if x > y else a for x, y, a, b in zip(z, star, low, high, strict=True)]
    return sum((c - x) ** 2 - (c - y) ** 2 for c, x, y in zip(corner, z, star, strict=True))


def _nearest(point: list[int], book: list[list[int]]) -> tuple[int, int]:
    """(entry, squared distance)."""
    return min(((i, sum((a - b) ** 2 for a, b in zip(point, e, strict=True))) for i, e in enumerate(book)), key=lambda x: (x[1], x[0]))


@dataclass
class Tree:
    """A part's tree as stored, with the points that are too large for it."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    wide_at: np.ndarray
    wide: list[list[int]]

    @classmethod
    def read(cls, found: dict, d: int) -> Tree:
        ints = lambda name, t: np.frombuffer(found[name], t)
        shaped = {name: ints(name, t).reshape(-1, d) for name, t in (("points", "<i4"), ("low", "<i4"), ("high", "<i4"), ("total", "<i8"))}
        return cls(order=ints("order", "<i4"), wide_at=ints("wide_at", "<i4"), wide=[[int(x) for x in v] for v in found["wide"]], **shaped)

    def _can_win(self, book: list[list[int]]) -> list[int]:
        """Entries that the block's outer box leaves."""
        low, high = self.low[0].tolist(), self.high[0].tolist()
        star = min(range(len(book)), key=lambda i: (sum((a + b - 2 * c) ** 2 for a, b, c in zip(low, high, book[i], strict=True)), i))
        return [i for i, e in enumerate(book) if i == star or (gap := _gap(e, book[star], low, high)) < 0 or (gap == 0 and i < star)]

    def assign(self, book: list[list[int]], leaf: int, codes: np.ndarray | None = None, errors: list | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """Counts and sums for each entry, and (entry, point) of what was looked at in Python's integers.

        codes and errors, by places in the block, are filled in where they are given.
        """
        k, d = len(book), self.points.shape[1]
        counts, sums, single = np.zeros(k, np.int64), np.zeros((k, d), np.int64), []
        for at, point in zip(self.wide_at.tolist(), self.wide, strict=True):
            entry, error = _nearest(point, book)
            single.append((entry, point))
            if codes is not None:
                codes[at], errors[at] = entry, errors[at] + error
        if not len(self.points):
            return counts, sums, single
        left = self._can_win(book)
        most = math.isqrt((1 << 62) // d) // 2 - NEAR
        if any(abs(x) > most for i in left for x in book[i]):
            for at, point in zip(self.order.tolist(), self.points.tolist(), strict=True):
                entry, error = _nearest(point, book)
                single.append((entry, point))
                if codes is not None:
                    codes[at], errors[at] = entry, errors[at] + error
            return counts, sums, single
        entries = np.array([book[i] for i in left], np.int64)
        found = self._filter(entries, leaf, np.array(left), counts, sums, codes is not None)
        if codes is not None:
            codes[self.order] = np.array(left)[found]
            off = ((self.points.astype(np.int64) - entries[found]) ** 2).sum(axis=1).tolist()
            for at, error in zip(self.order.tolist(), off, strict=True):
                errors[at] += error
        return counts, sums, single

    def _filter(self, entries: np.ndarray, leaf: int, names: np.ndarray, counts: np.ndarray, sums: np.ndarray, wanted: bool) -> np.ndarray:
        """The nearest entry of each point, in the tree's order, if wanted; counts and sums grow."""
        k, n = len(entries), len(self.points)
        out, first = np.zeros(n if wanted else 0, np.int64), 0
        nodes, hopeful = np.zeros(1, np.int64), np.ones((1, k), bool)
        levels, rank = levels_of(n, leaf), np.arange(k)
        for depth, edges in enumerate(levels):
            low, high = (x[first + nodes].astype(np.int64) for x in (self.low, self.high))
            middle = ((low + high)[:, None, :] - 2 * entries) ** 2
            star = np.where(hopeful, middle.sum(axis=2), _FAR).argmin(axis=1)
            best = entries[star][:, None, :]
            corner = np.where(entries > best, high[:, None, :], low[:, None, :])
            gap = ((corner - entries) ** 2 - (corner - best) ** 2).sum(axis=2)
            hopeful = hopeful & ((gap < 0) | ((gap == 0) & (rank <= star[:, None])))
            done = hopeful.sum(axis=1) == 1
            np.add.at(counts, names[star[done]], edges[nodes[done] + 1] - edges[nodes[done]])
            np.add.at(sums, names[star[done]], self.total[first + nodes[done]])
            if wanted:
                starts, ends = edges[nodes[done]], edges[nodes[done] + 1]
                out[_places(starts, ends)] = np.repeat(star[done], ends - starts)
            nodes, hopeful, first = nodes[~done], hopeful[~done], first + len(edges) - 1
            if not len(nodes):
                return out
            if depth + 1 < len(levels):
                nodes, hopeful = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(hopeful, 2, axis=0)
        starts, ends = levels[-1][nodes], levels[-1][nodes + 1]
        places = _places(starts, ends)
        row, entry = np.nonzero(np.repeat(hopeful, ends - starts, axis=0))
        off = np.full((len(places), k), _FAR)
        off[row, entry] = ((self.points[places[row]] - entries[entry]) ** 2).sum(axis=1)
        nearest = off.argmin(axis=1)
        np.add.at(counts, names[nearest], 1)
        np.add.at(sums, names[nearest], self.points[places])
        if wanted:
            out[places] = nearest
        return out


def _lay(parts: int, dim: int, scale: int, rows: int, leaf: int):
    """A row for each block: its rows, and a tree for each part."""
    d = dim // parts

    def tree(values: np.ndarray, exact: np.ndarray) -> dict:
        inside = (np.abs(values) <= NEAR).all(axis=1)
        at, wide_at = np.flatnonzero(inside), np.flatnonzero(~inside)
        points = order = low = high = total = np.empty((0, d), np.int64)
        if len(at):
            points, order, low, high, total = build(values[at].astype(np.int32), leaf)
            order = at[order]
        as_bytes = {name: x.astype("<i4").tobytes() for name, x in (("points", points), ("order", order), ("low", low), ("high", high), ("wide_at", wide_at))}
        return as_bytes | {"total": total.astype("<i8").tobytes(), "wide": [[str(_floor(x, scale)) for x in v] for v in exact[wide_at].tolist()]}

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vecs = matrix(table.column(1), dim)
        with np.errstate(over="ignore"):
            values = np.floor(vecs * scale)
        trees = [tree(values[:, i * d : (i + 1) * d], vecs[:, i * d : (i + 1) * d]) for i in range(parts)]
        kept = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(0))
        return pa.RecordBatch.from_arrays([kept, pa.array([trees], pa.list_(_arrow_tree()))], names=["rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if count + part.num_rows > rows:
                    yield block(held)
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield block(held)

    return run


def _arrow_tree() -> pa.DataType:
    return pa.struct([*((n, pa.binary()) for n in ("points", "order", "low", "high", "total", "wide_at")), ("wide", pa.list_(pa.list_(pa.string())))])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, value) of the pieces of a whole number, each with its sign."""
    sign, rest, i = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        if piece := rest & ((1 << LIMB) - 1):
            yield i, sign * piece
        rest, i = rest >> LIMB, i + 1


def _totals(book: Book, leaf: int):
    """(part, entry, place, limb, total) of a task's blocks; place -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(book[0][0])
        totals = [[[0] * (d + 1) for _ in entries] for entries in book]
        for batch in batches:
            for i in range(batch.num_rows):
                for part, found in enumerate(batch.column(0)[i].as_py()):
                    counts, sums, single = Tree.read(found, d).assign(book[part], leaf)
                    for total, count, sum_ in zip(totals[part], counts.tolist(), sums.tolist(), strict=True):
                        total[:] = [a + b for a, b in zip(total, [count, *sum_], strict=True)]
                    for entry, point in single:
                        totals[part][entry] = [a + b for a, b in zip(totals[part][entry], [1, *point], strict=True)]
        rows = [(p, e, i - 1, limb, piece) for p, entries in enumerate(totals) for e, total in enumerate(entries) for i, x in enumerate(total) for limb, piece in _limbs(x)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int32()) for c in columns[:4]), pa.array(list(columns[4]), pa.int64())], names=["part", "entry", "place", "limb", "total"])

    return run


def _codes(book: Book, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(book[0][0])
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(0).slice(i, 1).flatten()
                codes, errors = np.zeros((len(rows), len(book)), np.uint8), [0] * len(rows)
                for part, found in enumerate(batch.column(1)[i].as_py()):
                    Tree.read(found, d).assign(book[part], leaf, codes[:, part], errors)
                yield pa.RecordBatch.from_arrays([rows, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], names=["row", "code", "error"])

    return run


class Codec:
    """Codebooks, one of lists of whole numbers for each part, and the stored blocks that they were trained on."""

    def __init__(self, book: Book, blocks: DataFrame, schema: str, leaf: int, scale: int):
        self.book, self.blocks, self.schema, self.leaf, self.scale = book, blocks, schema, leaf, scale

    def encoded(self) -> DataFrame:
        """The columns of each vector's row but the vector, and code (two hex digits a part) and error (squared distances, summed over parts), in place of columns of these names."""
        if not self.book:
            return self.blocks.select(F.explode("rows").alias("row"), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).select("row.*", "code", "error")
        return self.blocks.mapInArrow(_codes(self.book, self.leaf), f"row {self.schema}, code string, error bigint").select("row.*", "code", "error")

    def decoded(self, codes: DataFrame, code_col: str = "code", out_col: str = "vector") -> DataFrame:
        """All columns of codes, and the vector that each code stands for."""
        books = F.array(*[F.array(*[F.array(*[F.lit(x / self.scale) for x in e]) for e in part]) for part in self.book])
        entry = lambda i: F.conv(F.substring(code_col, 2 * i + 1, 2), 16, 10).cast("int")
        return codes.withColumn(out_col, F.flatten(F.array(*[books[i][entry(i)] for i in range(len(self.book))])))


def train(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> Codec:
    """Codebooks that start as the parts of the vectors with the least ids. entries: 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    good = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = [f for f in df.schema if f.name not in (vec_col, "code", "error")]
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept])
    vectors = df.where(F.coalesce(good, F.lit(False))).select(row.alias("row"), F.col(vec_col).cast("array<double>").alias("vec"))
    size = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    d = max(1, -(-size // parts))
    schema = f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in kept)}>"
    blocks = staged(vectors.mapInArrow(_lay(parts, d * parts, scale, block_rows, leaf), f"rows array<{schema}>, trees array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _TREE.split(', '))}>>"), "blocks")
    first = [r["vec"] for r in vectors.orderBy(F.col(f"row.{id_col}").asc_nulls_last(), "vec").select("vec").limit(entries).collect()]
    whole = [[_floor(x, scale) for x in v] + [0] * (d * parts - len(v)) for v in first]
    book = [[v[i * d : (i + 1) * d] for v in whole] for i in range(parts)] if whole else []
    for _ in range(rounds if book else 0):
        found = blocks.select("trees").mapInArrow(_totals(book, leaf), "part int, entry int, place int, limb int, total bigint")
        sums = {(p, e): [0] * (d + 1) for p in range(parts) for e in range(len(whole))}
        for p, e, place, limb, total in found.groupBy("part", "entry", "place", "limb").agg(F.sum("total")).collect():
            sums[p, e][place + 1] += total << (LIMB * limb)
        book = [[[x // n for x in total] if n else entry for entry, (n, *total) in ((part[e], sums[p, e]) for e in range(len(part)))] for p, part in enumerate(book)]
    return Codec(book, blocks, schema, leaf, scale)


def with_group_error(codes: DataFrame, by: str = "label") -> DataFrame:
    """label_error: the errors' sum over rows of equal labels, nulls together; null if one of them or the sum is beyond a bigint."""
    stored = staged(codes, "codes")
    whole = F.count("error") == F.count(F.lit(1))
    sums = staged(stored.groupBy(F.col(by).alias("_by")).agg(F.when(whole, F.try_sum("error")).alias("label_error")), "errors")
    return stored.drop("label_error").join(sums, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
