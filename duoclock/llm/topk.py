"""Exact top-k inner products over whole-number vectors.

Candidates are dealt to cells by descending length, and the blocks of a cell keep that order. Vectors are turned by
the principal axes of all candidates (the right singular vectors), so that the first axes carry most of an inner
product. A product is bounded by its partial sum over those axes and, by Cauchy-Schwarz, the lengths of what remains;
the bound is looked at after half and after three quarters of the axes, and only products whose bound reaches the
query's k-th score are worked out in full. Every query begins with the longest vectors, takes its k-th score from
there to the other cells, and leaves out all cells and blocks whose longest vector times its own length is under it.

Products are exact. Where the lengths of two vectors allow no product of 2**53 or more it is worked out in double precision,
under 2**62 in 64-bit whole numbers, and beyond in Python's integers; each pair of vectors takes its own way, so a few
huge vectors cost the others nothing. Products beyond a bigint count as its ends, the least but one at the low end; 64 * x
beyond all doubles counts as the greatest. Ties go to smaller ids.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import CELLS, NO_SCORE, clean, extent, matrix, packed, raised, search, squares, top_of

SCALE, K, BLOCK_ROWS, CHUNK = 64, 20, 8192, 1024
#: Shares of the axes after which a product's bound is looked at.
PARTS = (0.5, 0.75)
#: Vectors with a larger component are shortened to it where the axes are found, and there only.
STEEP = 2.0**26
#: Pairs whose exact product is worked out at once.
PAIRS = 16_384


def _moments(dim: int):
    """Sums of products of components, over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            x = x / np.maximum(1, np.abs(x).max(axis=1, initial=0, keepdims=True) / STEEP)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: right singular vectors of all vectors, the strongest first. dim * dim numbers come to the driver."""
    sums = vectors.select("vec").mapInArrow(_moments(dim), "part array<double>").select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(dim * dim)
    for at, x in sums.collect():
        total[at] = x
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1]


def _finish(axes: np.ndarray, heads: list[int]):
    """A block's turned vectors, and the lengths of what remains of them after each part of the axes."""

    def run(ids: np.ndarray, vecs: np.ndarray) -> dict[str, np.ndarray]:
        turned = vecs @ axes
        rests = np.array([np.linalg.norm(turned[:, h:], axis=1) for h in heads])
        return {"ids": ids, "floors": np.empty(0), "vecs": vecs, "turned": turned[:, : heads[-1]], "rests": rests, "lengths": np.linalg.norm(vecs, axis=1)}

    return run


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x).max() for x in batch.column(1).to_pylist()], pa.float64())], names=["cell", "length"])


def _whole(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Exact products of the rows of q with those of c, whatever their size; bound: the lengths' products."""
    out, small = np.empty(len(q), np.int64), bound < 2.0**62
    for at in range(0, len(q), PAIRS):
        part = slice(at, at + PAIRS)
        on = np.flatnonzero(small[part]) + at
        out[on] = np.einsum("ij,ij->i", q[on].astype(np.int64), c[on].astype(np.int64))
    for i in np.flatnonzero(~small):
        product = sum(int(x) * int(y) for x, y in zip(q[i].tolist(), c[i].tolist(), strict=True))
        out[i] = min(max(product, NO_SCORE + 1), 2**63 - 1)
    return out


def _products(q: np.ndarray, c: np.ndarray, size_q: np.ndarray, size_c: np.ndarray, hopeful: np.ndarray) -> np.ndarray:
    """The products of the hopeful pairs as whole numbers, NO_SCORE elsewhere."""
    bound = size_q[:, None] * size_c
    plain = hopeful & (bound < 2.0**53)
    out = np.full(hopeful.shape, NO_SCORE)
    if plain.mean() > 0.25:  # a product of matrices is quicker than that many single ones
        out[plain] = (q @ c.T)[plain]
    else:
        i, j = np.nonzero(plain)
        out[i, j] = np.einsum("ij,ij->i", q[i], c[j])
    i, j = np.nonzero(hopeful & ~plain)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        out[a, b] = _whole(q[a], c[b], bound[a, b])
    return out


def _kernel(axes: np.ndarray, heads: list[int], k: int):
    """Bounds of huge vectors may overflow; what isn't known to be under a floor is worked out."""

    def run(own: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, c: np.ndarray, turned_c: np.ndarray, rests_c: np.ndarray, size_c: np.ndarray):
        size_q = np.linalg.norm(q, axis=1)
        turned_q, turned_c, rests_c = q @ axes, turned_c.reshape(len(c), heads[-1]), rests_c.reshape(len(heads), len(c))
        rests_q = [np.linalg.norm(turned_q[:, h:], axis=1) for h in heads]
        floors = floors.copy()
        scores, found = np.full((len(q), k), NO_SCORE), np.full((len(q), k), np.iinfo(np.int64).max)
        for at in range(0, len(c), CHUNK):
            reach = size_q * size_c[at]  # candidates only get shorter
            slack = 1e-9 * (1 + reach)
            live = np.flatnonzero(~(reach + slack < floors))
            if not len(live):
                break
            partial, columns, before, hopeful = 0.0, np.arange(at, min(len(c), at + CHUNK)), 0, None
            for h, rest_q, rest_c in zip(heads, rests_q, rests_c, strict=True):
                partial = partial + turned_q[live, before:h] @ turned_c[columns, before:h].T
                hopeful = ~(partial + rest_q[live, None] * rest_c[None, columns] + slack[live, None] < floors[live, None])
                rows, cols = np.flatnonzero(hopeful.any(axis=1)), np.flatnonzero(hopeful.any(axis=0))
                if len(rows) < len(live) or len(cols) < len(columns):
                    live, columns = live[rows], columns[cols]
                    partial, hopeful = partial[np.ix_(rows, cols)], hopeful[np.ix_(rows, cols)]
                before = h
                if not len(live):
                    break
            if not len(live):
                continue
            product = _products(q[live], c[columns], size_q[live], size_c[columns], hopeful)
            names = ids[columns]
            product[(names[None, :] == own[live, None]) | (product < floors[live, None])] = NO_SCORE
            best, who = top_of(product, names, k)
            best, who = top_of(np.concatenate((scores[live], best), axis=1), np.concatenate((found[live], who), axis=1), k)
            scores[live], found[live] = best[:, :k], who[:, :k]
            floors[live] = raised(floors[live], scores[live], NO_SCORE)
        return scores, found

    def quietly(*args):
        with np.errstate(over="ignore", invalid="ignore"):
            return run(*args)

    return quietly


def _scaled(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double; from 2**53 on doubles are whole already."""
    times = F.greatest(F.least(x * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    return F.when(F.abs(times) < 2.0**53, F.floor(times).cast("double")).otherwise(times)


def top_products(df: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products of floor(scale * x), among df's other ids."""
    whole = lambda d: clean(d, id_col, vec_col).select("id", F.transform("vec", lambda x: _scaled(x, scale)).alias("vec"))
    vectors = whole(df).withColumn("size", squares("vec"))
    dim, n = extent(vectors)
    heads = sorted({max(1, int(dim * x)) for x in PARTS})
    axes = principal_axes(vectors, dim)
    cells = min(CELLS, max(1, -(-n // BLOCK_ROWS)))
    ordered = vectors.repartitionByRange(cells, F.col("size").desc(), "id").sortWithinPartitions(F.col("size").desc(), "id")
    more = ("turned", "rests", "lengths")
    index = staged(packed(ordered.select(F.spark_partition_id().cast("bigint").alias("cell"), "id", "vec"), dim, BLOCK_ROWS, _finish(axes, heads), more), "index")
    longest = dict(map(tuple, index.select("cell", "lengths").mapInArrow(_longest, "cell bigint, length double").groupBy("cell").agg(F.max("length")).collect()))
    names = sorted(longest)
    start = names[0] if names else 0

    def others(known: DataFrame) -> DataFrame:
        """The further cells whose longest vector can reach the floor; cells are in descending length."""
        if len(names) < 2:
            return known.limit(0).select("cell", "id", "vec", "floor")
        reachable = F.filter(F.array(*[F.struct(F.lit(c).cast("bigint").alias("cell"), F.lit(float(longest[c])).alias("length")) for c in names[1:]]), lambda x: x["length"] * F.col("length") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        return known.withColumn("length", F.sqrt(squares("vec"))).select(F.explode(reachable).alias("to"), "id", "vec", "floor").select("to.cell", "id", "vec", "floor")

    home = lambda asked: asked.select(F.lit(start).cast("bigint").alias("cell"), "id", "vec")
    return search(whole(queries), index, dim, _kernel(axes, heads, k), k, "bigint", home, others, more)
