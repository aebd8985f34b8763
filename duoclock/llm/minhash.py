"""Near-duplicates by min-max hashing.

A document's set is that of its distinct k-word shingles, as 128-bit fingerprints. Under each of `perms`
permutations both the least and the greatest value are kept, which gives two nearly independent samples for one
evaluation; runs of `rows` of them make the band keys. With 40 bands of 6, a pair at similarity 0.8 shares no key
with a chance of about 5e-6.

Documents with equal sets are one class, and only its least id goes on. Each bucket of documents that share a key
has a pivot, the member that shares most keys with others; members are compared with their pivots by full sets, and
what is linked becomes one component. Where that leaves many members outside, their groups get a further pivot.

What then shares a pivot across components is found exactly by an inverted index, not pair by pair. Let R be the
elements that most of a pivot's members have, and D what a member's set and R don't share. For two members x and y,
|x ^ y| = |Dx ^ Dy|, so either both are so near to R that they are similar for certain, or Dx and Dy have so many
elements in common, and then two prefixes of them, rarest elements first, share one. Members are joined on those, and
pairs that sizes, places in the prefixes and bitmaps of D leave possible are compared by full sets. What most members
have, such as a site's template, is in R and so in few differences. No link that a key has shown is lost.

A-Z count as a-z; words are runs of other characters than ASCII white space; fewer than k words make one shingle;
no words (or null text) an empty set, which links with nothing. A null id links with nothing; its component is
null. Rows with one id and different texts are looked at each for itself, under that id. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, by_bytes, drop_staged, held_by_others, mix, release, staged, tasks_for, words_of
from .components import connected_components

WORDS, PER_CENT, BANDS, ROWS, SEED = 5, 80, 40, 6, 11
#: Further pivots that a group gets at most, bits of a bitmap, and documents to a task for tables of about a row a document.
MORE_PIVOTS, BITS, EACH = 2, 512, 20_000
#: Members of a pivot that are held against each other by sketches, where there are any; more go through the index.
FEW = 32
#: Bytes of sets that a task keeps for further comparisons.
MEMO_BYTES = 32 << 20


def shingles(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For each text the distinct fingerprints of its k-word shingles, as two rows, sorted by the first and then the second."""
    words, begin = words_of([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    runs = Runs(words).all(k)
    for lo, hi in zip(begin, begin[1:], strict=False):
        found = runs[:, lo : hi - k + 1] if hi - lo >= k else Runs(words[:, lo:hi]).all(hi - lo) if hi > lo else words[:, :0]
        found = found[:, np.argsort(found[0])]
        again = found[0, 1:] == found[0, :-1]
        if (found[1, 1:] != found[1, :-1])[again].any():  # halves collide: whole fingerprints in order
            found = found[:, np.lexsort((found[1], found[0]))]
        new = np.ones(found.shape[1], bool)
        new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
        yield found[:, new]


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """First halves of the fingerprints that are in one set only."""
    both = np.concatenate((p, q), axis=1)
    both = both[:, np.argsort(both[0])]
    same = both[0, 1:] == both[0, :-1]
    if (both[1, 1:] != both[1, :-1])[same].any():  # halves collide: whole fingerprints in order
        both = both[:, np.lexsort((both[1], both[0]))]
        same = (both[:, 1:] == both[:, :-1]).all(axis=0)
    alone = np.ones(both.shape[1], bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return both[0, alone]


class MinMax:
    """Band keys of sets."""

    def __init__(self, bands: int, rows: int, seed: int):
        perms = (bands * rows + 1) // 2
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, perms, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, perms, np.uint32)[:, None]
        self.bands, self.rows = bands, rows

    def signature(self, fingerprints: np.ndarray) -> np.ndarray:
        """The least values under all permutations, then the greatest."""
        h = (fingerprints >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for at in range(0, len(h), 2048):
            values = self.a * h[at : at + 2048] + self.b
            least, most = values.min(axis=1), values.max(axis=1)
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
        return np.concatenate((low, high))

    def keys(self, fingerprints: np.ndarray) -> np.ndarray:
        parts = self.signature(fingerprints)[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
        return key.view(np.int64)


def _sign(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(bands, rows, seed)
        for batch in batches:
            for part in by_bytes(batch, 1):
                sizes, prints, keys = [], [], []
                for found in shingles([t or "" for t in part.column(1).to_pylist()], k):
                    sizes.append(found.shape[1])
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    keys.append(minmax.keys(found[0]) if found.shape[1] else None)
                halves = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "keys"])

    return run


def parities(items: np.ndarray, apart: int) -> bytes:
    """A bit for each of some classes of elements, whether their number is odd: as many as four times apart, a power of two.

    Two sets differ in as many elements as bits at least. Longer sketches fold into shorter ones.
    """
    size = 1 << max(7, (4 * apart).bit_length())
    counts = np.bincount((items % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _apart_at_least(a: bytes, b: bytes) -> int:
    p, q = (np.frombuffer(x, np.uint8) for x in (a, b))
    size = min(len(p), len(q))
    folded = [np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (p, q)]
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum())


def _possible(per_cent: int):
    """Pairs with n, m and sketches a, b: whether sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (1, 2))
            possible = 100 * np.minimum(n, m) >= per_cent * np.maximum(n, m)
            for i in np.flatnonzero(possible):
                possible[i] = (100 + per_cent) * _apart_at_least(batch.column(3)[i].as_py(), batch.column(4)[i].as_py()) <= (100 - per_cent) * int(n[i] + m[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(possible)], names=["row", "possible"])

    return run


def _marked(pairs: DataFrame, sketches: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (x, y and other columns) with possible: false where sizes or sketches rule a link out."""
    first = sketches.select(F.col("id").alias("x"), F.col("n").alias("_n"), F.col("sketch").alias("_a"))
    second = sketches.select(F.col("id").alias("y"), F.col("n").alias("_m"), F.col("sketch").alias("_b"))
    rows = pairs.join(first, "x").join(second, "y").select(F.struct(*pairs.columns).alias("row"), "_n", "_m", "_a", "_b")
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pairs.schema)
    found = rows.mapInArrow(_possible(per_cent), f"row struct<{fields}>, possible boolean").select("row.*", "possible")
    return found.groupBy(*pairs.columns).agg(F.bool_or("possible").alias("possible"))  # ids can have several texts


def _bits(items: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS // 64, np.uint64)
    place = items % np.uint64(BITS)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def _compare(k: int, per_cent: int, with_items: bool):
    """For two texts, x and y: sizes of their sets, whether they are similar enough, and what only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, np.ndarray] = OrderedDict()
        held = 0

        def of(text: str) -> np.ndarray:
            nonlocal held
            if text in known:
                known.move_to_end(text)
                return known[text]
            known[text] = found = next(shingles([text], k))
            held += found.nbytes + len(text)
            while held > MEMO_BYTES:
                text, gone = known.popitem(last=False)
                held -= gone.nbytes + len(text)
            return found

        for batch in batches:
            for part in by_bytes(batch, 1, 2):
                sizes_x, sizes_y, linked, counts, bits, items = [], [], [], [], [], []
                for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    p, q = of(x or ""), of(y or "")
                    alone = apart(p, q)
                    n, m = p.shape[1], q.shape[1]
                    common = (n + m - len(alone)) // 2
                    sizes_x.append(n)
                    sizes_y.append(m)
                    linked.append(common > 0 and 100 * common >= per_cent * (n + m - common))
                    counts.append(len(alone))
                    bits.append(_bits(alone))
                    items.append(alone.view(np.int64) if with_items else None)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (sizes_x, sizes_y)), pa.array(linked, pa.bool_()), pa.array(counts, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
                names = ["row", "n", "m", "linked", "apart", "bits"]
                if with_items:
                    columns.append(pa.array(items, pa.list_(pa.int64())))
                    names.append("items")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _compared(pairs: DataFrame, texts: DataFrame, k: int, per_cent: int, with_items: bool = False) -> DataFrame:
    """The pairs (x, y and other columns) with n, m, linked, apart, bits and, if wanted, items."""
    first = texts.select(F.col("id").alias("x"), F.col("text").alias("_x"))
    second = texts.select(F.col("id").alias("y"), F.col("text").alias("_y"))
    rows = pairs.join(first, "x").join(second, "y").select(F.struct(*pairs.columns).alias("row"), "_x", "_y")
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pairs.schema)
    out = rows.mapInArrow(_compare(k, per_cent, with_items), f"row struct<{fields}>, n bigint, m bigint, linked boolean, apart bigint, bits array<bigint>" + (", items array<bigint>" if with_items else ""))
    return staged(out.select("row.*", *out.columns[1:]), "compared")


def _pivot_pairs(reps: DataFrame, tasks: int) -> DataFrame:
    """(x, weight, y): documents and the pivots of their buckets. weight: how often the document's keys occur."""
    listed = reps.select("id", "n", F.explode("keys").alias("key"))
    # what a join is with stands in a table of its own, so that Spark can split the partition of a hot key
    sizes = staged(listed.groupBy("key").count().where("count > 1"), "sizes", tasks)
    members = staged(listed.join(sizes, "key").groupBy("id", "n").agg(F.sum("count").alias("weight"), F.collect_list("key").alias("keys")), "members", tasks)
    return to_pivots(members, tasks)


def to_pivots(members: DataFrame, tasks: int, merge: int | None = None) -> DataFrame:
    """(x, weight, y): members (id, weight, keys) and, for each key, the one of its members with the most weight.

    merge: keys of more members than this take the pivot with the most weight that any of their members has under such a
    key, so that a cluster whose keys overlap has few pivots, and each of its members is a row of few groups.
    """
    each = members.select(F.col("id").alias("x"), "weight", F.explode("keys").alias("key"))
    heaviest = F.max(F.struct("weight", (-F.col("x")).alias("neg"))).alias("p")
    if merge is None:
        pivots = each.groupBy("key").agg(heaviest)
    else:
        own = staged(each.groupBy("key").agg(heaviest, F.count(F.lit(1)).alias("count")), "own-pivots", tasks)
        large = each.join(own.where(F.col("count") > merge).select("key", "p"), "key").select("x", "key", "p")
        best = staged(large.groupBy("x").agg(F.max("p").alias("best")), "best-pivots", tasks)
        merged = large.join(best, "x").groupBy("key").agg(F.max("best").alias("p"))
        pivots = own.where(F.col("count") <= merge).select("key", "p").union(merged)
    pivots = staged(pivots.select("key", (-F.col("p.neg")).alias("y")), "pivots", tasks)
    return staged(each.join(pivots, "key").where("x <> y").select("x", "weight", "y").distinct(), "pairs", tasks)


def _with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components cx and cy of their ends."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    found = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return found.withColumns({"cx": F.coalesce("cx", "x"), "cy": F.coalesce("cy", "y")})


def _by_sketches(compared: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, per_cent: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Links among the members of pivots that have few, by their sketches; and the rows of other pivots."""
    counts = staged(compared.groupBy("y").count(), "counts", tasks)
    few = staged(_with_components(compared.join(counts.where(F.col("count") <= FEW).select("y"), "y"), labels).select("y", "x", "cx"), "few", tasks)
    pairs = few.join(few.select("y", F.col("x").alias("x2"), F.col("cx").alias("cx2")), "y").where("x < x2 AND cx <> cx2").select("x", F.col("x2").alias("y")).distinct()
    possible = staged(_marked(staged(pairs, "pairs", tasks), sketches, per_cent).where("possible").select("x", "y"), "pairs", tasks)
    links = _compared(possible, texts, k, per_cent).where("linked").select("x", "y")
    return links, compared.join(counts.where(F.col("count") > FEW).select("y"), "y", "left_semi")


def _further_links(compared: DataFrame, labels: DataFrame, texts: DataFrame, k: int, per_cent: int, tasks: int, sketches: DataFrame | None = None) -> DataFrame | None:
    """Links across components among documents that have a pivot in common; None: there can be none."""
    tested, links, round_ = compared.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), None, 0
    if sketches is not None:
        links, compared = _by_sketches(compared, labels, sketches, texts, k, per_cent, tasks)
        labels = connected_components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).union(links), "x", "y", tasks)
    while True:
        placed = staged(_with_components(compared, labels), "placed")
        rest = placed.where("cx <> cy")
        count = rest.groupBy("y").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1))).first()
        if not count[0]:
            return links
        if round_ == MORE_PIVOTS or count[1] <= 8 * count[0]:
            break
        round_ += 1
        best = staged(rest.groupBy("y").agg(F.max(F.struct("weight", (-F.col("x")).alias("neg"))).alias("p")).select("y", (-F.col("p.neg")).alias("next")), "pivots", tasks)
        more = rest.join(best, "y").where("x <> next").select(F.least("x", "next").alias("x"), F.greatest("x", "next").alias("y")).distinct()
        more = staged(more.join(tested, ["x", "y"], "left_anti"), "pairs", tasks)
        if sketches is not None:
            more = staged(_marked(more, sketches, per_cent).where("possible").select("x", "y"), "pairs", tasks)
        found = _compared(more, texts, k, per_cent).select("x", "y", "linked")
        tested = tested.union(found.select("x", "y"))
        new = found.where("linked").select("x", "y")
        links = new if links is None else links.union(new)
        labels = connected_components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).union(new), "x", "y", tasks)
        release(placed.sparkSession)
    possible, sure = _index_pairs(placed, texts, k, per_cent, tasks)
    new = _compared(staged(possible.join(tested, ["x", "y"], "left_anti"), "pairs", tasks), texts, k, per_cent).where("linked").select("x", "y").union(sure)
    return new if links is None else links.union(new)


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences from a pivot and what most of its members differ by: differences from the majority's set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counts, bits, items = [], [], []
            for own, most in zip(part.column(1), part.column(2), strict=True):
                own = own.values.to_numpy()
                if most.is_valid:
                    own = np.setxor1d(own, most.values.to_numpy())
                counts.append(len(own))
                bits.append(_bits(own.view(np.uint64)))
                items.append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (bits, items))], names=["row", "apart", "bits", "items"])


def _index_pairs(placed: DataFrame, texts: DataFrame, k: int, per_cent: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(x, y): pairs of one pivot and different components that may be similar enough, by an index of rare differences; and links that are certain.

    With w = (100 + p) |D| - (100 - p) n, two members are linked if and only if their w sum up to 2 (100 + p) |Dx & Dy| at most.
    """
    open_ = staged(placed.where("cx <> cy").select("y").distinct(), "open", tasks)
    rows = _compared(placed.join(open_, "y").select("x", "y", "cx"), texts, k, per_cent, with_items=True).select("x", "y", "cx", "n", "items")
    members = staged(rows.groupBy("y").agg(F.count(F.lit(1)).alias("members")), "members", tasks)
    counts = rows.select("y", F.explode("items").alias("item")).groupBy("y", "item").count()
    most = staged(counts.join(members, "y").where("2 * count > members").groupBy("y").agg(F.collect_list("item").alias("most")), "most", tasks)
    moved = rows.join(most, "y", "left").select(F.struct("x", "y", "cx", "n").alias("row"), "items", "most")
    rows = staged(moved.mapInArrow(_nearer, "row struct<x: bigint, y: bigint, cx: bigint, n: bigint>, apart bigint, bits array<bigint>, items array<bigint>").select("row.*", "apart", "bits", "items"), "nearer")
    rows = rows.withColumn("w", (100 + per_cent) * F.col("apart") - (100 - per_cent) * F.col("n"))
    least = staged(rows.groupBy("y").agg(F.min(F.struct("w", "x")).alias("l")).select("y", F.col("l.w").alias("least"), F.col("l.x").alias("core")), "least", tasks)
    rows = rows.join(least, "y").withColumn("sure", F.col("w") + F.col("least") <= 0)
    sure = rows.where("sure AND x <> core").select(F.least("x", "core").alias("x"), F.greatest("x", "core").alias("y")).distinct()
    # two members that aren't sure need so many differences in common
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("least")) / F.lit(2 * (100 + per_cent)) - 1e-9)).cast("int")
    wanted = rows.withColumn("tag", F.xxhash64("items")).withColumn("upto", F.greatest(F.lit(0), F.col("apart").cast("int") - need + 1)).drop("w", "least", "core")
    listed = wanted.select(F.explode("items").alias("item"), "y", "x", "tag").select(F.xxhash64("y", "item").alias("key"), "y", "x", "tag", "item")
    # elements that no other member's difference has come first in every order, and only their number counts
    held = staged(listed.repartition("key").sortWithinPartitions("key").mapInArrow(held_by_others, listed.schema), "held")
    often = staged(held.groupBy("y", "item").count(), "often", tasks)
    order = held.join(often, ["y", "item"]).groupBy("y", "x", "tag").agg(F.sort_array(F.collect_set(F.struct("count", "item"))).alias("order"))
    left = F.greatest(F.lit(0), F.col("upto") - (F.col("apart").cast("int") - F.size("order")))
    ranked = wanted.drop("items").join(order, ["y", "x", "tag"]).select("y", "x", "cx", "n", "apart", "bits", "sure", (F.col("apart") - F.size("order")).alias("alone"), F.posexplode(F.slice("order", F.lit(1), left)).alias("place", "e"))
    ranked = ranked.withColumn("at", F.col("alone") + F.col("place"))
    index = staged(ranked.where("e.count > 1").select("y", "x", "cx", "n", "apart", "bits", "sure", "at", F.col("e.item").alias("item")), "index")
    other = index.select("y", "item", *[F.col(c).alias(f"{c}2") for c in ("x", "cx", "n", "apart", "bits", "sure", "at")])
    own = lambda a, b: " + ".join(f"bit_count({a}[{i}] & ~{b}[{i}])" for i in range(BITS // 64))
    shared = f"least(apart - at, apart2 - at2, apart - ({own('bits', 'bits2')}), apart2 - ({own('bits2', 'bits')}))"
    possible = f"100 * least(n, n2) >= {per_cent} * greatest(n, n2) AND {100 + per_cent} * (apart + apart2 - 2 * {shared}) <= {100 - per_cent} * (n + n2)"
    found = index.join(other, ["y", "item"]).where(f"x < x2 AND cx <> cx2 AND NOT (sure AND sure2) AND {possible}").select("x", F.col("x2").alias("y")).distinct()
    return found, sure


def grouped(texts: DataFrame, signed: DataFrame, candidates: Callable[[DataFrame, int], DataFrame], k: int, per_cent: int, id_col: str, with_sketches: bool = False) -> DataFrame:
    """A row per document: id, n_shingles, component_id (the least id that links lead to), kept (it is that one).

    signed: stored, deleted when read; id, n and f1 and f2, the set's fingerprint, of each text, and what candidates need of it. candidates:
    from the rows of one document for each different set, and a number of tasks, (x, weight, y), documents and pivots, so
    that any two linked documents are a pair or have a pivot in common. with_sketches: signed has parities too, as sketch.
    """
    spark = texts.sparkSession
    real = signed.where("n > 0 and id is not null")
    tasks = tasks_for(signed.count(), EACH)
    classes = staged(real.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes", tasks)
    reps = staged(real.join(classes.select("f1", "f2", F.col("rep").alias("id")), ["f1", "f2", "id"], "left_semi").drop("f1", "f2"), "reps", tasks)
    sketches = staged(reps.select("id", "n", "sketch"), "sketches", tasks) if with_sketches else None
    sets = staged(signed.select("id", "n", "f1", "f2"), "sets")
    drop_staged(signed)
    pairs = candidates(reps, tasks)
    if sketches is not None:
        pairs = staged(_marked(pairs, sketches, per_cent), "marked", tasks)
    # all texts move once; from here on only those that share a key with another
    sharing = staged(pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct(), "sharing", tasks)
    texts = staged(texts.join(sharing, "id", "left_semi"), "texts")
    release(spark)
    if sketches is None:
        compared = _compared(pairs, texts, k, per_cent)
    else:
        looked_at = _compared(pairs.where("possible").drop("possible"), texts, k, per_cent).select("x", "weight", "y", "linked")
        compared = looked_at.union(pairs.where("NOT possible").select("x", "weight", "y", F.lit(False).alias("linked")))
    release(spark)

    labels = connected_components(compared.where("linked"), "x", "y", tasks)
    if not compared.where("not linked").isEmpty():
        more = _further_links(compared, labels, texts, k, per_cent, tasks, sketches)
        if more is not None:
            labels = connected_components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more), "x", "y", tasks)
    release(spark)

    several = classes.where("rep < last").select("f1", "f2", "rep")
    out = sets.join(several, ["f1", "f2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = out.join(labels, F.col("rep") == F.col("node"), "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text)."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, k: int = WORDS, per_cent: int = PER_CENT, bands: int = BANDS, rows: int = ROWS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the least id that links lead to), kept (it is that one)."""
    texts = documents(docs, id_col, text_col)
    signed = staged(texts.mapInArrow(_sign(k, bands, rows, seed), "id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>"), "signatures")
    return grouped(texts, signed, _pivot_pairs, k, per_cent, id_col)
