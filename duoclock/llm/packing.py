"""Packing token ids into sequences of one capacity, first-fit decreasing by a tournament tree.

Each document's ids end with a separator id. A document's full blocks of `capacity` ids fill sequences of their
own; the tails go to randomised groups of about `group_docs` documents and are packed there, longest first, into
the first sequence with room, which a tournament tree of the sequences' free room finds in logarithmic time.
Then sequences that stay open are taken apart, the emptiest first, and their pieces cut to fill the others, so
that a group ends with one open sequence at most.

Groups are drawn by a hash of id, text and the row's place, so neither a key nor repeated rows can make one large;
each is packed alone, in bounded memory. The draw changes the sequences only, so it may differ between runs whose
files are split otherwise.
Null text is an empty document, of one separator. Equal rows are packed each for itself. No rows: no pieces.
A null id keeps its pieces, with a null id. Sequence ids are the group's number times 2**32 plus a count.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import SPLIT, byte_of_char

CAPACITY, SEPARATOR, GROUP_DOCS = 2048, 1, 2048
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Tournament:
    """Free room of bins; each match's winner has the more room, so the first bin with enough is found from the top."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The first bin with this much room, which it takes."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        room[at] -= length
        found = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length). lengths: positive, at most the capacity, in decreasing order."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for item, n in enumerate(lengths):
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((item, 0, n))
    return bins


def fill_up(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Take the emptiest open bins apart and cut their pieces to fill the other open ones."""
    used = [sum(n for _, _, n in b) for b in bins]
    order = sorted((i for i, n in enumerate(used) if n < capacity), key=lambda i: (-used[i], i))
    low, high, gone = 0, len(order) - 1, set()
    while low < high:
        to, source = order[low], order[high]
        item, start, n = bins[source].pop()
        part = min(n, capacity - used[to])
        bins[to].append((item, start, part))
        used[to] += part
        if part < n:
            bins[source].append((item, start + part, n - part))
        elif not bins[source]:
            gone.add(source)
            high -= 1
        if used[to] == capacity:
            low += 1
    return [b for i, b in enumerate(bins) if i not in gone]


@cache
def byte_encoder(path: str) -> Callable[[str], bytes]:
    """A text's token ids as little-endian unsigned 32-bit numbers, as the tokenizers library gives them.

    Where ids follow the order of merges, they come from tiktoken's core, which merges by the same ranks and is quicker.
    """
    machine = Tokenizer.from_file(path)
    machine.no_truncation()
    machine.no_padding()
    specials = {x.content: i for i, x in machine.get_added_tokens_decoder().items()}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = lambda text: np.array(machine.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if merged != sorted(merged) or (merged and merged[0] != 256):
        return plain
    alphabet = byte_of_char()
    ranks = {bytes(alphabet[c] for c in s): i for s, i in model["vocab"].items() if s not in specials}
    core = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=specials)

    def encode(text: str) -> bytes:
        try:
            return core.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern gives up on very long runs of white space
            return plain(text)

    return encode


def _cut_documents(path: str, capacity: int, separator: int):
    end = struct.pack("<I", separator)
    step = 4 * capacity
    schema = pa.schema([("grp", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("blocks", pa.list_(pa.int64())), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, blocks, tails = [], [], []
                for text in part.column(2).to_pylist():
                    data = encode(text) + end
                    full = len(data) // step * step
                    counts.append(len(data) // 4)
                    blocks.append([zlib.crc32(data[i : i + step]) for i in range(0, full, step)])
                    tails.append(data[full:])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(counts, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(tails, pa.binary())], schema=schema)

    return run


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        group = int(frame["grp"].iloc[0])
        frame["n"] = frame["tail"].map(len) // 4
        frame = frame.sort_values(["n", "doc_id", "doc_tokens", "tail"], ascending=[False, True, True, True], na_position="last")
        ids, totals, tails, lengths = frame["doc_id"].tolist(), frame["doc_tokens"].tolist(), frame["tail"].tolist(), frame["n"].tolist()
        out: list[tuple] = []
        bins = fill_up(first_fit_decreasing([n for n in lengths if n], capacity), capacity)
        for number, pieces in enumerate(bins):
            offset = 0
            for item, start, n in pieces:
                out.append((ids[item], totals[item] - lengths[item] + start, n, zlib.crc32(tails[item][4 * start : 4 * (start + n)]), totals[item], (group << 32) + number, offset))
                offset += n
        number = len(bins)
        for doc, total, crcs in zip(ids, totals, frame["blocks"].tolist(), strict=True):
            for i, crc in enumerate(crcs):
                out.append((doc, i * capacity, capacity, int(crc), total, (group << 32) + number, 0))
                number += 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        rows = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({name: pa.array([None if x is pd.NA else x for x in col], pa.int64()) for name, col in zip(names, rows, strict=True)})

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    drawn = source.select(F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id(), "text"), F.lit(groups)).alias("grp"), "doc_id", "text")
    cut = drawn.mapInArrow(_cut_documents(path, capacity, separator), "grp bigint, doc_id bigint, doc_tokens bigint, blocks array<bigint>, tail binary")
    return cut.groupBy("grp").applyInArrow(_pack_group(capacity), PIECES)
