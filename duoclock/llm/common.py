"""Pieces the operators share: staged tables and 128-bit fingerprints of words and runs of words."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder


def staged(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor costs nothing.

    tasks: write with so many at most; for tables evenly dealt by an aggregation, whose rows need no more.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing planned or kept reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if path.getParent().getParent().getName() == "staged":
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def held_by_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, a bigint, those whose value another row has too; a row waits for the next, and no more are held."""
    last, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        found = np.zeros(len(keys), bool)
        found[1:], found[0] = same, again
        found[:-1] |= same
        last, again = batch.slice(len(keys) - 1), bool(found[-1])
        found[-1] = False
        yield batch.filter(pa.array(found))
    if again:
        yield last


def tasks_for(rows: int, each: int) -> int:
    """Tasks for so many rows, `each` to a task; a dozen at least. Beyond the number of shuffle partitions it has no effect."""
    return max(12, -(-rows // each))


def by_bytes(batch: pa.RecordBatch, *columns: int, most: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose strings in these columns take so many bytes together, or of one row, if that takes more."""
    taken = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < batch.num_rows:
        before = int(taken[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(taken, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words of non-(ASCII white space) start and end."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = _IS_SPACE[raw]
    turn = np.diff(gap)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


#: Odd multipliers, one for each half of a fingerprint, and words of more bytes than this are hashed one by one.
_FACTORS, _LONG = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit fingerprint of each word, as two rows of 64 bits; the same on every machine.

    Eight bytes at a time go through a mixer that is one-to-one in them, so words of up to eight bytes never
    collide; words of more than 32 bytes have a cryptographic hash.
    """
    sizes = ends - starts
    out = np.empty((2, len(starts)), np.uint64)
    if not len(starts):
        return out
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
    for half, factor in zip(out, _FACTORS, strict=True):
        half[:] = sizes.astype(np.uint64) * factor
    here = np.flatnonzero(sizes <= _LONG)
    for at in range(0, _LONG, 8):
        here = here[sizes[here] > at] if at else here
        if not len(here):
            break
        part = eights[starts[here] + at] & _KEEP[np.minimum(sizes[here] - at, 8)]
        for half, factor in zip(out, _FACTORS, strict=True):
            half[here] = mix((half[here] ^ part) * factor)
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The words' fingerprints of all texts, and where each text's begin; the last entry is where they end."""
    data = b"\n".join(texts)
    starts, ends = word_bounds(data)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return word_hashes(data, starts, ends), np.searchsorted(starts, begin).tolist()


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Fingerprints of what stands one after another, from those of its two parts; one row or both."""
    return np.stack([mix(a * factor + b) for a, b, factor in zip(first, second, _FACTORS[: len(first)], strict=True)])


class Runs:
    """Fingerprints of runs of k words, by their first words' positions, as rows of 64 bits like the words' own.

    Runs of 1, 2, 4 and so on words are joined two and two, and k is put together from those. Up to `WIDEST` words
    they are kept for all positions; longer ones are worked out where they are asked for.
    """

    WIDEST = 16

    def __init__(self, words: np.ndarray):
        self.powers, self.n = [words], words.shape[1]

    def _power(self, i: int) -> np.ndarray:
        while len(self.powers) <= i:
            size = 1 << (len(self.powers) - 1)
            before = self.powers[-1]
            self.powers.append(joined(before[:, :-size], before[:, size:]) if before.shape[1] > size else before[:, :0])
        return self.powers[i]

    def _at(self, i: int, places: np.ndarray) -> np.ndarray:
        if 1 << i <= self.WIDEST:
            return self._power(i)[:, places]
        return joined(self._at(i - 1, places), self._at(i - 1, places + (1 << (i - 1))))

    def at(self, k: int, places: np.ndarray) -> np.ndarray:
        done, covered = None, 0
        for i in range(k.bit_length()):
            if k >> i & 1:
                part = self._at(i, places + covered)
                done = part if done is None else joined(done, part)
                covered += 1 << i
        return done

    def all(self, k: int) -> np.ndarray:
        """For every position from which k words follow."""
        return self.at(k, np.arange(max(0, self.n - k + 1)))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what nothing refers to any more; else they stay until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
