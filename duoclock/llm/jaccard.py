"""Exact similarity join on word n-grams, by partitions of the universe and the pigeonhole principle.

Two sets of n and m elements have a Jaccard similarity of p % or more if and only if they differ in at most
H = (100 - p)(n + m) / (100 + p) elements. Sizes are in bands so narrow that a set's partners are in its own band or the
next. For each band the universe is hashed into segments, more of them than any H there, so similar sets are alike in
a whole segment; a set's part in each segment is one key, in its own band's and in the next band's partition.

Which keys a set is searched by is chosen by their cost, the number of sets that hold them. A segment counts 0 if it
is passed over, 1 if it must be alike, 2 if it may differ by one element, and H + 1 must come together. So the
most frequent keys are passed over as far as a set's own H leaves room. There are more segments than H + 1, by `extra`,
so that there is room for those that happen to be empty, or to hold one frequent element, and are alike in unrelated
sets; their number grows with the documents. Both of two similar sets keep the rarest key that they share, so a key is
one of the sets that keep it, not of those that pass it over: a cluster that keeps frequent keys doesn't draw all
their other holders in. Frequent keys beyond that are those of near copies and of pages that
are mostly template, whose pivot shows the links at a comparison a set. With `trade`, those held by more sets than
that are traded for the one-deletion neighbourhood of a segment that no other set shares. Only sets with such a
traded key are then indexed by their own deletions, and only in segments that some set is searched by in this way: a
pair that no other key has shown shares a traded one. That costs a row an element of each of these sets, so it is off by default.

Candidates share a key; they are compared by full sets through pivots, so a key in a third of all sets costs a
comparison a set, and what shares a pivot is told exactly (see minhash). Sets whose parities differ in more bits than
sets of their sizes may differ in elements are not compared. Nothing is sampled or capped.

A-Z count as a-z; words are runs of other characters than ASCII white space; fewer than k words make one shingle;
no words (or null text) an empty set, which links with nothing. A null id links with nothing; its component is
null. Rows with one id and different texts are looked at each for itself, under that id. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drop_staged, held_by_others, mix, release, staged
from .minhash import FEW, documents, grouped, parities, shingles, to_pivots

WORDS, PER_CENT = 4, 85
#: A key of more sets than this is traded for a one-deletion neighbourhood; None: none is.
TRADE: int | None = None
_SIGNED = "id bigint, n bigint, f1 bigint, f2 bigint, sketch binary, roles array<struct<band: int, own: boolean, m: int, spare: int, keys: array<bigint>>>"


@cache
def _bands(per_cent: int, upto: int) -> list[int]:
    """Where bands begin; a band ends with the greatest size that is similar enough to its least."""
    out = [1]
    while len(out) < 3 or out[-3] <= upto:
        out.append(100 * out[-1] // per_cent + 1)
    return out


def most_apart(n: int, m: int, per_cent: int) -> int:
    return (100 - per_cent) * (n + m) // (100 + per_cent)


def extra(most: int) -> int:
    """Segments beyond most + 1: as many as are empty in hardly any set, at some six elements a segment."""
    return min(most, 3 + most // 16)


def roles(n: int, per_cent: int) -> Iterator[tuple[int, bool, int, int]]:
    """(band, whether it is the size's own, segments, segments that may be passed over) for the bands where a set of this size can have partners."""
    begins = _bands(per_cent, 1 << n.bit_length() + 1)
    band = int(np.searchsorted(begins, n, "right")) - 1
    for b in (band, band + 1):
        last, most = begins[b + 1] - 1, 100 * n // per_cent
        if b == band or most >= begins[b]:
            m = most_apart(last, last, per_cent) + 1
            m += extra(m - 1)
            yield b, b == band, m, m - 1 - most_apart(n, min(last, most), per_cent)


class Segments:
    """A set's parts in the segments of a band: sums of mixed elements, modulo 2**64."""

    def __init__(self, found: np.ndarray, band: int, m: int):
        """found: fingerprints as two rows, sorted by the first, whose places divide the universe."""
        place = ((found[0] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        self.edges = np.searchsorted(place, np.arange(m + 1, dtype=np.uint64))
        self.values = mix(found[1] ^ (found[0] * np.uint64(0x9E3779B97F4A7C15)))
        self.sums = np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values, dtype=np.uint64)))[self.edges])
        self.salt = mix((np.uint64(band) << np.uint64(32)) + np.arange(m, dtype=np.uint64))

    def keys(self, kind: int = 0) -> np.ndarray:
        return mix(self.sums * np.uint64(0xC2B2AE3D27D4EB4F) + self.salt + np.uint64(kind)).view(np.int64)

    def less_one(self, segments: np.ndarray, kind: int) -> np.ndarray:
        """Keys of these segments without one of their elements, for each."""
        sizes = np.diff(self.edges)[segments]
        at = np.repeat(self.edges[segments] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        of = np.repeat(segments, sizes)
        return mix((self.sums[of] - self.values[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + self.salt[of] + np.uint64(kind)).view(np.int64)


def _sign(k: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("band", pa.int32()), ("own", pa.bool_()), ("m", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            for part in by_bytes(batch, 1):
                sizes, prints, sketches, found_roles = [], [], [], []
                for found in shingles([t or "" for t in part.column(1).to_pylist()], k):
                    n = found.shape[1]
                    sizes.append(n)
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sketches.append(parities(found[1], most_apart(n, n, per_cent)))
                    found_roles.append([{"band": b, "own": own, "m": m, "spare": spare, "keys": Segments(found, b, m).keys()} for b, own, m, spare in roles(n, per_cent)] if n else [])
                halves = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sketches), pa.array(found_roles, kind)], names=["id", "n", "f1", "f2", "sketch", "roles"])

    return run


def _neighbourhoods(k: int):
    """(id, key, asks): of each text, in its band, the keys of the segments that are wanted and of those that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                for i, found in enumerate(shingles([t or "" for t in part.column(1).to_pylist()], k)):
                    id_, band, m, wanted, asked = (part.column(c)[i].as_py() for c in (0, 2, 3, 4, 5))
                    own, wanted, asked = Segments(found, band, m), np.array(wanted, np.int64), np.array(asked or [], np.int64)
                    # what one side has whole, the other lacks an element of
                    index = np.concatenate((own.keys(1)[wanted], own.less_one(wanted, 2)))
                    asks = np.concatenate((own.keys(2)[asked], own.less_one(asked, 1)))
                    keys = np.concatenate((index, asks))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), id_)), pa.array(keys), pa.array(np.arange(len(keys)) >= len(index))], names=["id", "key", "asks"])

    return run


def allocate(listed: DataFrame, limits: DataFrame, trade: int | None = TRADE) -> DataFrame:
    """From (id, band, at, key, count), the keys that others hold too, and limits (id, band, m, spare): (id, band, m, keys, kept, passed, asked).

    kept: keys that the set is searched by; passed: those passed over for the segments in asked, whose neighbourhoods are searched instead.
    """
    slots = listed.groupBy("id", "band").agg(F.sort_array(F.collect_list(F.struct("count", "at", "key")), asc=False).alias("slots")).join(limits, ["id", "band"])
    hot = F.lit(0) if trade is None else F.size(F.filter("slots", lambda s: s["count"] > trade))
    trades = F.greatest(F.lit(0), F.least(hot - F.col("spare"), F.col("m") - F.size("slots")))
    slots = slots.withColumn("trades", trades).withColumn("over", F.least(F.size("slots"), F.col("spare") + F.col("trades")))
    alone = F.array_except(F.sequence(F.lit(0), F.col("m") - 1), F.transform("slots", lambda s: s["at"].cast("int")))
    of = lambda a, b: F.transform(F.slice("slots", a, b), lambda s: s["key"])
    return slots.select(
        "id", "band", "m", F.transform("slots", lambda s: s["key"]).alias("keys"), of(F.col("over") + 1, F.size("slots")).alias("kept"),
        F.when(F.col("trades") > 0, of(F.lit(1), F.col("over"))).alias("passed"), F.when(F.col("trades") > 0, F.slice(alone, F.lit(1), F.col("trades"))).alias("asked"),
    )


def searched_by(chosen: DataFrame, trade: int | None, tasks: int) -> DataFrame:
    """(id, key): the sets that meet under a key. chosen: from allocate.

    What two similar sets share is more than either may pass over, and keys have one order for both, so the last of those
    that they share is kept by both. Only where keys are traded, one may have passed over what the other keeps.
    """
    if trade is None:
        return chosen.select("id", F.explode("kept").alias("key"))
    searched = staged(chosen.select(F.explode("kept").alias("key")).distinct(), "searched", tasks)
    return chosen.select("id", F.explode("keys").alias("key")).join(searched, "key", "left_semi").select("id", "key")


def _candidates(texts: DataFrame, k: int, trade: int | None):
    def run(reps: DataFrame, tasks: int) -> DataFrame:
        placed = reps.select("id", F.explode("roles").alias("r"))
        # segment, band and whether it is the set's own in one number, so that rows stay small; a key is a row of each
        # set that holds it, of some hundred rows a set, so even one held by a third of all sets is few of them
        limits = staged(placed.groupBy("id", "r.band").agg(F.max("r.m").alias("m"), F.min("r.spare").alias("spare")), "limits", tasks)
        each = placed.select("id", (F.col("r.band") * 2 + F.col("r.own").cast("int")).cast("bigint").alias("role"), F.posexplode("r.keys").alias("at", "key"))
        each = each.select("key", "id", (F.shiftleft(F.col("at").cast("bigint"), 16) + F.col("role")).alias("slot"))
        held = staged(each.repartition("key").sortWithinPartitions("key").mapInArrow(held_by_others, each.schema), "held")
        drop_staged(reps)  # the keys are by far the largest table
        release(reps.sparkSession)
        counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.max(F.col("slot").bitwiseAND(F.lit(1).cast("bigint"))).alias("own"))
        # a key of sets that all belong to the band below can't be shared by partners
        counts = staged(counts.where("own = 1").select("key", "count"), "counts", tasks)
        band = F.shiftright("slot", 1).bitwiseAND(F.lit((1 << 15) - 1).cast("bigint")).cast("int")
        shared = held.join(counts, "key").select("id", band.alias("band"), F.shiftright("slot", 16).alias("at"), "key", "count")
        chosen = staged(allocate(shared, limits, trade), "chosen", tasks)
        release(reps.sparkSession)
        buckets = searched_by(chosen, trade, tasks)
        if trade is not None and not chosen.where("asked IS NOT NULL").isEmpty():
            buckets = buckets.union(_near_misses(chosen, texts, k, tasks))
        buckets = staged(buckets.distinct(), "buckets", tasks)
        often = staged(buckets.groupBy("key").count().where("count > 1"), "often", tasks)
        members = buckets.join(often, "key").groupBy("id").agg(F.sum("count").alias("weight"), F.collect_list("key").alias("keys"))
        release(reps.sparkSession)
        return to_pivots(staged(members, "members", tasks), tasks, merge=FEW)

    return run


def _near_misses(chosen: DataFrame, texts: DataFrame, k: int, tasks: int) -> DataFrame:
    """(id, key): keys by which sets that share a traded key may be alike but for one element of a segment."""
    traded = staged(chosen.where("asked IS NOT NULL").select(F.explode("passed").alias("key")).distinct(), "traded", tasks)
    holders = chosen.select("id", "band", "m", "asked", F.explode("keys").alias("key")).join(traded, "key", "left_semi").drop("key").distinct()
    wanted = staged(chosen.where("asked IS NOT NULL").select("band", F.explode("asked").alias("at")).groupBy("band").agg(F.array_sort(F.collect_set("at")).alias("wanted")), "wanted", 1)
    rows = holders.join(wanted, "band").join(texts, "id").select("id", "text", "band", "m", "wanted", "asked")
    found = staged(rows.mapInArrow(_neighbourhoods(k), "id bigint, key bigint, asks boolean"), "near-misses")
    asked = staged(found.where("asks").select("key").distinct(), "asked", tasks)
    return found.join(asked, "key", "left_semi").select("id", "key")


def join(docs: DataFrame, k: int = WORDS, per_cent: int = PER_CENT, trade: int | None = TRADE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the least id that links lead to), kept (it is that one)."""
    texts = documents(docs, id_col, text_col)
    signed = staged(texts.mapInArrow(_sign(k, per_cent), _SIGNED), "signatures")
    return grouped(texts, signed, _candidates(texts, k, trade), k, per_cent, id_col, with_sketches=True)
