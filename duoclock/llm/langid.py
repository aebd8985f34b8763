"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its
place (multiplied after a cyclic shift); a text's vector bundles (sums) those of its n-grams, and a language's
prototype bundles those of its documents. The language whose prototype has the largest cosine is predicted.

Texts are lower-cased; runs of other characters than letters become one blank. The score is that cosine, 0 at
least. Null texts, and those without a letter, are `und` with score 0, and so is everything if nothing could be
learned. Equal cosines: the language that sorts first. Rows with null id or language teach nothing. Repeated rows
teach and are predicted each for itself; very long texts are profiled whole. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, N, SEED = 1024, 3, 20240229
BLOCK = 4096


@cache
def letters() -> np.ndarray:
    """Code point -> its letter's code point in lower case; 0: not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0])
    return table


def symbols(text: str) -> np.ndarray:
    """Letters in lower case, other runs as one 0, which also stands at both ends."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def ngrams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, 21 bits a letter, and their counts."""
    s = symbols(text)
    if len(s) < n or not s.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = np.zeros(len(s) - n + 1, np.uint64)
    for i in range(n):
        gram = (gram << np.uint64(21)) | s[i : len(s) - n + 1 + i]
    return np.unique(gram, return_counts=True)


class Vectors:
    """Letters' vectors, drawn from their code points and kept, and those of n-grams, bound from them."""

    def __init__(self, dim: int, n: int, seed: int):
        self.dim, self.n, self.seed, self.known = dim, n, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.known[code]

    def grams(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.dim), np.int8)
        for place in range(self.n):
            codes = (keys >> np.uint64(21 * (self.n - 1 - place))) & np.uint64(0x1FFFFF)
            distinct, index = np.unique(codes, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(c)), self.n - 1 - place) for c in distinct])
            out *= table[index]
        return out.astype(np.float32)

    def bundle(self, texts: list[str], counted: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """A row for each text. Sums of whole numbers, exact in double precision. counted: the texts' n-grams, if known."""
        counted = [ngrams(t, self.n) for t in texts] if counted is None else counted
        out = np.zeros((len(texts), self.dim))
        if not sum(len(k) for k, _ in counted):
            return out
        keys, column = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(k) for k, _ in counted])
        count = np.concatenate([c for _, c in counted])
        order = np.argsort(column, kind="stable")
        row, column, count = row[order], column[order], count[order]
        for at in range(0, len(keys), BLOCK):
            lo, hi = np.searchsorted(column, (at, at + BLOCK))
            weights = np.zeros((len(texts), min(BLOCK, len(keys) - at)), np.float32)
            weights[row[lo:hi], column[lo:hi] - at] = count[lo:hi]
            out += weights @ self.grams(keys[at : at + BLOCK])
        return out


@cache
def vectors(dim: int, n: int, seed: int) -> Vectors:
    return Vectors(dim, n, seed)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that only those are Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _slices(texts: list, chars: int = 400_000, rows: int = 256) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (size > chars or i - at >= rows):
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if texts:
        yield at, len(texts)


def _learn(dim: int, n: int, seed: int):
    """Sums for each language of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in _parts(batches):
            langs, texts = np.array(part.column(0).to_pylist(), object), part.column(1).to_pylist()
            for lo, hi in _slices(texts):
                found = vectors(dim, n, seed).bundle(texts[lo:hi])
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + found[langs[lo:hi] == lang].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total], pa.list_(pa.float64()))], names=["lang", "part"])

    return run


def learn(docs: DataFrame, taught: Column, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = N, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes, from the rows where `taught` is true: `dim` numbers for each language come to the driver."""
    rows = docs.where(taught & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(_learn(dim, n, seed), "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, values in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect():
        vector = np.array([v["x"] for v in values])
        if vector.any():
            found[lang] = vector
    return found


def _predict(prototypes: dict[str, np.ndarray], text_at: int, dim: int, n: int, seed: int, grams_col: str | None):
    names = sorted(prototypes)
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = part.column(0).field(text_at).to_pylist()
            for lo, hi in _slices(texts):
                counted = [ngrams(t or "", n) for t in texts[lo:hi]]
                found = vectors(dim, n, seed).bundle(texts[lo:hi], counted)
                size = np.linalg.norm(found, axis=1)
                if names:
                    cosines = np.round((found @ unit.T) / np.maximum(size, 1e-9)[:, None], 12)
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(hi - lo), best], 0, 1)
                    has = [bool(t) and symbols(t).any() for t in texts[lo:hi]]
                    lang = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                    score = np.where(has, score, 0.0)
                else:
                    lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                columns = {"row": part.column(0).slice(lo, hi - lo), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
                if grams_col:
                    columns[grams_col] = pa.array([len(k) for k, _ in counted], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, n: int = N, seed: int = SEED, grams_col: str | None = None) -> DataFrame:
    """All columns of docs, and lang_pred and score, which replace columns of these names.

    grams_col: one more column of this name, the number of different n-grams; up to n = 3, 0 only without a letter.
    """
    added = ["lang_pred", "score", *([grams_col] if grams_col else [])]
    docs = docs.drop(*added)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    counts = f", `{grams_col}` bigint" if grams_col else ""
    out = docs.select(row.alias("row")).mapInArrow(_predict(prototypes, docs.columns.index(text_col), dim, n, seed, grams_col), f"row struct<{fields}>, lang_pred string, score double{counts}")
    return out.select("row.*", *[F.col(f"`{c}`") for c in added])
