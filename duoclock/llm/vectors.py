"""Searches of a query set against all vectors, in blocks.

Candidates lie in cells, of which there are at most `CELLS`, so what is known of cells is small; a cell holds any
number of blocks of some thousands of vectors, each one row of a stored table. A search has two rounds. In the first
each query meets the blocks of one cell, where its best candidates are likely, and so gets a k-th best score. In the
second it takes that score to the other cells that can still hold better ones, and to no others. Queries travel in
batches by cell, and no task holds more than a batch and a block of each of a few rows.

A vector takes part if it has an id, is not null and has no null or non-finite component; shorter vectors count as
ending in zeros. Rows that share an id are never each other's results; equal query rows count as one query. Different
vectors of one query id are all searched, and what they find is ranked together. Fewer candidates than asked for:
all of them. No queries or no candidates: no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELLS, BATCH_ROWS, HELD, LOWEST = 1024, 1024, 64, -np.inf
#: What stands for no score where scores are whole numbers.
NO_SCORE = -(2**63 - 1)


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec as doubles."""
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def squares(vec: str):
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """One row for each list, with zeros at the end of short ones."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - (offsets[:-1] - offsets[0])[row]] = values
    return out


def _pack(dim: int, rows: int, finish: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cell, count = None, 0

        def block() -> pa.RecordBatch:
            ids, floors, vecs = (np.concatenate(x) for x in zip(*held, strict=True))
            parts = {"ids": ids, "floors": floors, "vecs": vecs}
            if finish is not None:
                parts |= finish(ids, vecs)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts.values())], names=["cell", *parts])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cells, ids, floors = (part.column(c).to_numpy() for c in ("cell", "id", "floor"))
                vecs = matrix(part.column("vec"), dim)
                edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if held and (cells[lo] != cell or count + hi - lo > rows):
                        yield block()
                        held, count = [], 0
                    cell = int(cells[lo])
                    held.append((ids[lo:hi], floors[lo:hi], vecs[lo:hi]))
                    count += hi - lo
        if held:
            yield block()

    return run


def packed(vectors: DataFrame, dim: int, rows: int, finish: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(cell, ids, floors, vecs, more...): runs of at most `rows` vectors of one cell, in their order; finish gives what is called `more`."""
    floor = F.col("floor") if "floor" in vectors.columns else F.lit(LOWEST)
    return vectors.select("cell", "id", floor.alias("floor"), "vec").mapInArrow(_pack(dim, rows, finish), "cell bigint, ids binary, floors binary, vecs binary" + "".join(f", {c} binary" for c in more))


def _by_cell(vectors: DataFrame, rows: int) -> DataFrame:
    """Cells together, in partitions of about `rows`; a hot cell spans several."""
    return vectors.repartitionByRange(max(1, -(-vectors.count() // (8 * rows))), "cell", "id").sortWithinPartitions("cell", "id")


def _meet(asked: DataFrame, index: DataFrame, dim: int, kernel: Callable, more: tuple[str, ...], score_type: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best that each query (cell, id, vec, floor) finds in the blocks of its cell."""
    names = ["ids", "vecs", *more]
    arrow_type, lowest = (pa.int64(), NO_SCORE) if score_type == "bigint" else (pa.float64(), LOWEST)

    def found(own: np.ndarray, _, __, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        number, place = np.nonzero(scores > lowest)
        return pa.RecordBatch.from_arrays([pa.array(own[number]), pa.array(ids[number, place], pa.int64()), pa.array(scores[number, place]).cast(arrow_type)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch takes what it has found, and the k-th score, from block to block of its task
        held: OrderedDict[bytes, list] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_floors, q_vecs, c_ids, c_vecs, *rest = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
                key = hashlib.blake2b(q_ids + q_vecs, digest_size=16).digest()
                if key not in held:
                    own = np.frombuffer(q_ids, np.int64)
                    held[key] = [own, np.frombuffer(q_vecs).reshape(len(own), dim), np.frombuffer(q_floors), np.full((len(own), k), lowest), np.full((len(own), k), np.iinfo(np.int64).max)]
                    if len(held) > HELD:
                        yield found(*held.popitem(last=False)[1])
                own, q, floors, scores, ids = held[key]
                new, names_of = kernel(own, q, floors, np.frombuffer(c_ids, np.int64), np.frombuffer(c_vecs).reshape(-1, dim), *map(np.frombuffer, rest))
                scores, ids = top_of(np.concatenate((scores, new), axis=1), np.concatenate((ids, names_of), axis=1), k)
                held[key][2:] = raised(floors, scores, lowest), scores, ids
        for batch_found in held.values():
            yield found(*batch_found)

    batches = packed(asked, dim, BATCH_ROWS).select("cell", *[F.col(c).alias(f"q_{c}") for c in ("ids", "floors", "vecs")])
    pairs = batches.join(index, "cell").select("q_ids", "q_floors", "q_vecs", *names)
    return _best(pairs.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, dim: int, kernel: Callable, k: int, score_type: str, home: Callable, others: Callable, more: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, vec_id, score).

    index: stored, packed. home(queries) adds the column cell; others(queries with home and floor) gives
    (cell, id, vec, floor) for the further cells. kernel(query ids, queries, floors, candidate ids, candidates, more...) gives
    the k best scores of each query that aren't under its floor, and their ids, as matrices filled up with LOWEST (whole numbers: NO_SCORE).
    """
    asked = staged(home(queries.dropDuplicates(["id", "vec"])), "asked")
    first = staged(_meet(_by_cell(asked, BATCH_ROWS), index, dim, kernel, more, score_type, k), "first").select("query_id", "vec_id", "score")
    floors = staged(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("worst")), "floors")
    known = asked.join(floors, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(LOWEST)))
    routed = staged(others(known), "routed")
    second = _meet(_by_cell(routed, BATCH_ROWS), index, dim, kernel, more, score_type, k).select("query_id", "vec_id", "score")
    return _best(first.union(second), k).select("query_id", "rank", "vec_id", "score")


def raised(floors: np.ndarray, scores: np.ndarray, lowest: float) -> np.ndarray:
    """Floors after what was found: the k-th score where there are k."""
    return np.where(scores[:, -1] > lowest, np.maximum(floors, scores[:, -1]), floors)


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to smaller ids, best first. ids: a row for all or one for each."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        # what beats or equals the k-th score; ties at the edge are settled by id below
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        width = int((scores >= edge[:, None]).sum(axis=1).max())
        if width > k:
            order = np.argsort(ids, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        order = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    order = np.argsort(ids, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def extent(vectors: DataFrame) -> tuple[int, int]:
    """The longest list's size (1 at least), the number of vectors."""
    d, n = vectors.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    return max(1, d or 0), n
