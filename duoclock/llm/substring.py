"""Substring dedup by seed and extend.

Every window of `length` words has an anchor: the least of the fingerprints of the runs of `seed_words` words in it
(winnowing), so equal windows have equal anchors at equal places, and one run in eighteen or so is an anchor. The
windows of a document that have one anchor are a block. Documents are joined on anchors:

* Equal blocks are one, and the document with the least id holds it; in the others it is repeated as a whole.
* Where an anchor has different blocks, each holder's block is laid on that of the least id at the anchor, and the
  match is extended word by word to the left and to the right. Windows inside the match are repeats.
* Windows outside it can still be repeats of a third document; those are compared by their fingerprints.

Repeated windows that touch, put together, are the maximal repeats of at least `length` words, and words in them go
from every document but the one with the least id. Every anchor has one block that others are laid on, and grouping
is pre-aggregated, so a passage in a third of all documents costs a row a task, and no pairs of documents are made.
Blocks and windows have fingerprints of 128 bits.

Words are runs of other characters than ASCII white space; null text has none. Only a smaller id takes words away:
rows that share an id take none from each other. A row with a null id loses nothing and takes nothing. A text of
under `length` words stays. Very long texts are worked on whole, in memory in proportion to the text. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, joined, mix, release, staged, tasks_for, words_of

LENGTH, SEED_WORDS = 50, 16
#: Rows to a task for tables of a row an anchor.
EACH = 100_000
SPANS = "id bigint, tag bigint, first int, count int, w1 bigint, w2 bigint"


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` values the place of the least, the first of equal ones; values count by all but their last bits."""
    n = len(values) - span + 1
    bits = np.uint64(max(1, len(values).bit_length()))
    low = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return (np.minimum(low[:n], low[span - size : span - size + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def blocks(words: np.ndarray, begin: list[int], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of texts one after another: number of the text, anchor's fingerprint, both halves of the block's, first window, number of windows, words before the anchor.

    Anchors are chosen by the first 32 bits of fingerprints, so that it doesn't matter what stands in other texts.
    """
    n = words.shape[1]
    sizes = np.diff(begin)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(np.arange(n) <= np.repeat(begin[1:], sizes) - length)  # where a window begins
    if not len(inside):
        return (np.empty(0, np.int64),) * 7
    runs = Runs(words)
    seeds = runs.all(k)[0]
    place = least_places(seeds >> np.uint64(32) << np.uint64(32), length - k + 1)[inside]
    turn = np.flatnonzero(np.diff(place, prepend=-1))
    first, count = inside[turn], np.diff(turn, append=len(inside))
    lead = place[turn] - first
    # a block has fewer windows than a window has words: its first and last window hold all its words
    whole = joined(runs.at(length, first), runs.at(length, first + count - 1)) ^ mix(lead.astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64))
    text = text[first]
    return text, seeds[place[turn]].view(np.int64), whole[0].view(np.int64), whole[1].view(np.int64), first - np.array(begin)[text], count, lead


def _find_blocks(length: int, k: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, begin = words_of([(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()])
                row, *columns = blocks(words, begin, length, k)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "tag", "anchor", "b1", "b2", "first", "count", "lead"])

    return run


def _cut_out(length: int):
    """The words of the blocks given, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, spans, parts = [], [], []
                for i, (text, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    words = text.encode("utf-8", "surrogatepass").split()
                    rows += [i] * len(wanted)
                    spans += wanted
                    parts += [b" ".join(words[s["first"] : s["first"] + s["count"] + length - 1]) for s in wanted]
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array([s["anchor"] for s in spans], pa.int64()), *(pa.array([s[c] for s in spans], pa.int32()) for c in ("first", "count", "lead")), pa.array(parts, pa.binary())],
                    names=["id", "tag", "anchor", "first", "count", "lead", "words"],
                )

    return run


def match(x: list[bytes], at_x: int, y: list[bytes], at_y: int, k: int) -> tuple[int, int]:
    """How many words before and after the seeds at these places are equal; (-1, -1) if the seeds aren't."""
    if x[at_x : at_x + k] != y[at_y : at_y + k]:
        return -1, -1
    left = right = 0
    while left < min(at_x, at_y) and x[at_x - left - 1] == y[at_y - left - 1]:
        left += 1
    at_x, at_y = at_x + k, at_y + k
    while at_x + right < len(x) and at_y + right < len(y) and x[at_x + right] == y[at_y + right]:
        right += 1
    return left, right


def _extend(length: int, k: int):
    """From blocks laid on one other: the windows that are repeats, as runs, and those left open, with fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, starts, counts, prints = [], [], [], []
                columns = [part.column(c).to_pylist() for c in ("id", "first", "count", "lead", "words", "id2", "lead2", "words2")]
                for i, (id_, first, count, lead, words, id2, lead2, words2) in enumerate(zip(*columns, strict=True)):
                    left, right = match(words.split(b" "), lead, words2.split(b" "), lead2, k)
                    lo, hi = max(0, lead - left), min(count, lead + k + right - length + 1)  # the windows inside the match
                    if left < 0 or hi <= lo:
                        lo = hi = 0
                    elif id_ > id2:
                        rows.append(i)
                        starts.append(first + lo)
                        counts.append(hi - lo)
                        prints.append((None, None))
                    if hi - lo < count:
                        w = Runs(words_of([words])[0]).all(length)[:, :count].T.copy().view(np.int64).tolist()
                        for j in (*range(lo), *range(hi, count)):
                            rows.append(i)
                            starts.append(first + j)
                            counts.append(1)
                            prints.append(w[j])
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(row), part.column("tag").take(row), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64())],
                    names=["id", "tag", "first", "count", "w1", "w2"],
                )

    return run


def _remove(length: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, removed, kept = [], [], []
                for text, spans in zip(part.column(0).field(text_at).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    if spans:
                        turn = np.zeros(len(words) + 1, np.int64)
                        for s in spans:
                            turn[s["first"]] += 1
                            turn[s["first"] + s["count"] + length - 1] -= 1
                        stays = np.cumsum(turn[:-1]) == 0
                        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, spans): windows of each document that a smaller id has too, as runs (first, count). tag: the text's hash."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("tag"), "text")
    found = staged(texts.mapInArrow(_find_blocks(length, seed_words), "id bigint, tag bigint, anchor bigint, b1 bigint, b2 bigint, first int, count int, lead int"), "blocks")
    tasks = tasks_for(found.count(), EACH)
    # what a join is with stands in a table of its own, so that Spark can split the partition of a hot key
    differs = (F.min("b1") < F.max("b1")) | (F.min("b2") < F.max("b2"))
    shared = staged(found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), differs.alias("differs")).where("lo < hi").select("anchor", "differs"), "shared", tasks)
    seeds = staged(found.join(shared, "anchor"), "seeds")
    holders = staged(seeds.groupBy("b1", "b2").agg(F.min("id").alias("holder")), "holders", tasks)
    held = staged(seeds.join(holders, ["b1", "b2"]).where("id > holder or differs").select("id", "tag", "anchor", "first", "count", "lead", (F.col("id") > F.col("holder")).alias("gone")), "held")
    release(spark)
    by_doc = held.where("not gone").groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "first", "count", "lead")).alias("spans"))
    laid = texts.join(by_doc, ["id", "tag"]).select("id", "tag", "text", "spans")
    cut = staged(laid.mapInArrow(_cut_out(length), "id bigint, tag bigint, anchor bigint, first int, count int, lead int, words binary"), "cut")
    base = staged(cut.groupBy("anchor").agg(F.min(F.struct("id", "first", "lead", "words")).alias("b")).select("anchor", F.col("b.id").alias("id2"), F.col("b.lead").alias("lead2"), F.col("b.words").alias("words2")), "base", tasks)
    extended = staged(cut.join(base, "anchor").drop("anchor").mapInArrow(_extend(length, seed_words), SPANS), "extended")
    release(spark)
    windows = extended.where("w1 is not null")
    firsts = staged(windows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "firsts", tasks)
    late = windows.join(firsts, ["w1", "w2"]).where("id > lo")
    parts = [held.where("gone"), extended.where("w1 is null"), late]
    spans = parts[0].select("id", "tag", "first", "count").union(parts[1].select("id", "tag", "first", "count")).union(parts[2].select("id", "tag", "first", "count"))
    out = staged(spans.distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("spans")), "repeats", tasks)
    release(spark)
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_words, n_removed, kept_text (words joined by one space), which replace columns of these names."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    gone = repeats(docs, length, seed_words, id_col, text_col).select(F.col("id").alias("_gone_id"), F.col("tag").alias("_gone_tag"), "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    marked = docs.select(row.alias("_row"), F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_tag"))
    joined_rows = marked.join(gone, (F.col("_id") == F.col("_gone_id")) & (F.col("_tag") == F.col("_gone_tag")), "left").select("_row", "spans")
    out = joined_rows.mapInArrow(_remove(length, docs.columns.index(text_col)), f"row struct<{fields}>, n_words bigint, n_removed bigint, kept_text string")
    return out.select("row.*", "n_words", "n_removed", "kept_text")
