"""Line dedup: drop lines that many documents hold, except in one document.

A text is split at \\n; a line's key is the line without ASCII white space at its ends and with A-Z in lower case.
Keys of at least `min_chars` code points found in at least `min_docs` documents lose their lines in every document
but the one with the largest id. Null or empty text is one empty line. Documents are told apart by id: rows with
one id count as one document, and each of them loses that document's dropped keys. A null id counts as a document
that is smaller than all others. No rows: no rows.

Lines travel as 128-bit hashes; counts are pre-aggregated, so a line in a third of all documents is one row a task in
the count, and the rows of its documents meet it in a join whose hot partition Spark splits. Very long texts are split
whole; equal hashes of different lines need about 2**64 lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_CHARS, MIN_DOCS = 20, 3
_EDGE = " \t\n\x0b\f\r"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """None: too short to count."""
    key = line.strip(_EDGE)
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, keys = [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = {h for line in text.split("\n") if (h := line_hash(line, min_chars))}
                    ids += [i] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    return run


def _drop_lines(min_chars: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, dropped, kept = [], [], []
                for text, keys in zip(part.column(0).field(text_at).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    lines = text.split("\n")
                    gone = set(keys or ())
                    left = [x for x in lines if line_hash(x, min_chars) not in gone] if gone else lines
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(left))
                    kept.append("\n".join(left) if gone else text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])

    return run


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keys): the hashes of the lines that each document loses."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = texts.mapInArrow(_hash_lines(min_chars), "id bigint, key binary")
    # stored, so that lines are hashed once and Spark can split the partition of a hot key
    held = staged(lines.distinct(), "lines")
    common = staged(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"), "common")
    lost = held.join(common, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_lines, n_dropped, kept_text, which replace columns of these names."""
    lost = dropped_keys(docs, min_chars, min_docs, id_col, text_col).select(F.col("id").alias("_lost_id"), F.col("keys").alias("_lost_keys"))
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    with_keys = docs.select(row.alias("_row"), F.col(id_col).cast("bigint").alias("_id")).join(lost, F.col("_id").eqNullSafe(F.col("_lost_id")), "left")
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    out = with_keys.select("_row", "_lost_keys").mapInArrow(_drop_lines(min_chars, docs.columns.index(text_col)), f"row struct<{fields}>, n_lines bigint, n_dropped bigint, kept_text string")
    return out.select("row.*", "n_lines", "n_dropped", "kept_text")
