"""A quality classifier learned from positives and unlabelled text.

A linear model over measures of a text (shares of kinds of characters and of single marks, word and line statistics, and
counts of character trigrams hashed to `BUCKETS` places) is fitted to the non-negative unbiased risk:
prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]), with logistic loss, so that its sigmoid estimates the
chance of label 1. Positives are trusted texts of label 1. The unlabelled texts are documents without any label; where
there are fewer of those than `LEAST`, labelled ones with their labels hidden make up for them. Labels of other classes
are never used. The class prior is estimated from positives and unlabelled texts alone: a model that tells one half of
both apart is tried on the other half, and the prior is the least ratio, over its thresholds, of the shares of unlabelled
and of positive texts above (a mixture holds at least that many positives), where the ratio's confidence bound is least.

The fit uses at most `SAMPLE` texts of each kind, those with the least hashes of their ids; this bound is the only one,
and every text is scored whole. Null and empty texts have zero measures and a score, and so do very long ones. Of
repeated labels of one id the least counts; null ids and labels teach nothing. Repeated rows are scored each for itself.
Without positives all scores are 0.5. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, LEAST, BUCKETS, STEPS, RATE, DECAY = 4096, 64, 256, 400, 0.05, 1e-3
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _kinds() -> np.ndarray:
    """Code point -> 0 other, 1 lower-case letter, 2 other letter, 3 digit, 4 white space, 5 and on: ASCII marks."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            table[c] = 1 if s.islower() else 2
        elif s.isnumeric():
            table[c] = 3
        elif s.isspace():
            table[c] = 4
    for i, s in enumerate(_MARKS):
        table[ord(s)] = 5 + i
    return table


def trigrams(codes: np.ndarray) -> np.ndarray:
    """How often each bucket is met, as square roots of shares."""
    if len(codes) < 3:
        return np.zeros(BUCKETS)
    c = codes.astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    counts = np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS - 1).bit_length()), minlength=BUCKETS)
    return np.sqrt(counts / (len(codes) - 2))


def measures(text: str | None) -> np.ndarray:
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_kinds()[codes], minlength=5 + len(_MARKS)).astype(float)
    n = max(1, len(codes))
    words = text.split()
    w = max(1, len(words))
    sizes = np.array([len(x) for x in words] or [0], float)
    distinct = set(words)
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    l = max(1, len(filled))  # noqa: E741
    return np.concatenate((
        np.sqrt(kinds / n),
        [
            np.log1p(len(codes)), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes <= 3).sum() / w, (sizes >= 10).sum() / w,
            len(distinct) / np.sqrt(w), np.log1p(len(distinct)), np.log1p(len(lines)), len(words) / l, len(set(filled)) / l,
            sum(x[:1].isupper() for x in words) / w, sum(not x[-1].isalnum() for x in words) / w, sum(not x[:1].isalnum() for x in words) / w, sum(len(x) == 1 and not x.isalnum() for x in words) / w,
        ],
        trigrams(codes),
    ))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = [measures(t).astype(np.float32).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], names=["positive", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(p: np.ndarray, u: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of a linear model, on rows that end in 1."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(p @ weights) + max(0.0, loss(-(u @ weights)) - prior * loss(-(p @ weights)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights of least risk by Adam over all rows; where the second part is negative, steps go against its gradient."""
    weights = np.zeros(p.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        zp, zu = p @ weights, u @ weights
        sp, su = _sigmoid(zp), _sigmoid(zu)
        as_positive = prior * (p.T @ (sp - 1)) / len(p)
        as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        excess = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gradient = as_positive + as_negative if excess >= 0 else -as_negative
        gradient = gradient + decay * np.append(weights[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def class_prior(p: np.ndarray, u: np.ndarray, steps: int = STEPS // 2, risk_of_error: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, from both halves of both."""
    found = []
    for learn_on, try_on in ((0, 1), (1, 0)):
        a, b = p[learn_on::2], u[learn_on::2]
        x, y = p[try_on::2], u[try_on::2]
        if not min(map(len, (a, b, x, y))):
            return 0.5
        # positives against unlabelled, each half of the weight: the risk with labels for both
        weights, rows = np.zeros(p.shape[1]), np.concatenate((a, b))
        side, share = np.repeat([1.0, 0.0], [len(a), len(b)]), np.repeat([0.5 / len(a), 0.5 / len(b)], [len(a), len(b)])
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, steps + 1):
            gradient = rows.T @ ((_sigmoid(rows @ weights) - side) * share) + DECAY * np.append(weights[:-1], 0)
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        zx, zy = np.sort(x @ weights), np.sort(y @ weights)
        above_x = 1 - np.searchsorted(zx, zx, side="left") / len(zx)
        above_y = 1 - np.searchsorted(zy, zx, side="left") / len(zy)
        slack = np.sqrt(np.log(4 / risk_of_error) / 2) * (len(x) ** -0.5 + len(y) ** -0.5)
        best = np.argmin((above_y + slack) / above_x)
        found.append(above_y[best] / above_x[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, **settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last); the prior is estimated if not given."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    ready = lambda x: np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    p, u = ready(positive), ready(unlabelled)
    return mean, scale, minimise(p, u, class_prior(p, u) if prior is None else prior, **settings)


def _least(rows: DataFrame, n: int) -> list[int]:
    """The n ids of least hashes."""
    return [r["doc_id"] for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


def learn(docs: DataFrame, labels: DataFrame, taught: Column, sample: int = SAMPLE, label_col: str = "quality") -> tuple | None:
    """A model from the rows where `taught` is true; None without positives. At most 2 * `sample` rows come to the driver."""
    spark = docs.sparkSession
    known = labels.where(taught & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.where(taught & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    any_label = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    positive = _least(known.where("label = 1").join(texts.select("doc_id"), "doc_id", "left_semi"), sample)
    if not positive:
        return None
    unlabelled = _least(texts.select("doc_id").join(any_label, "doc_id", "left_anti"), sample)
    if len(unlabelled) < LEAST:
        unlabelled += _least(known.join(texts.select("doc_id"), "doc_id", "left_semi"), sample - len(unlabelled))
    chosen = spark.createDataFrame([(i, True) for i in positive] + [(i, False) for i in unlabelled], "doc_id bigint, positive boolean")
    found = texts.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(_measured, "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(found.num_rows, -1).astype(float)
    y = np.array(found.column("positive").to_pylist(), bool)
    order = np.lexsort((*x.T[::-1], y))  # the rows' order must not matter
    x, y = x[order], y[order]
    mixed = np.random.default_rng(3).permutation(len(x))  # halves must be alike
    x, y = x[mixed], y[mixed]
    return fit(x[y], x[~y])


def score(docs: DataFrame, model: tuple | None, text_col: str = "text") -> DataFrame:
    """All columns of docs, and score, which replaces a column of this name."""
    docs = docs.drop("score")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).column(0)
                if model is None:
                    found = np.full(len(part), 0.5)
                else:
                    mean, scale, weights = model
                    x = np.array([measures(t) for t in part.field(text_at).to_pylist()])
                    z = np.clip((x - mean) / scale, -8, 8) @ weights[:-1] + weights[-1]
                    found = _sigmoid(z)
                yield pa.RecordBatch.from_arrays([part, pa.array(found, pa.float64())], names=["row", "score"])

    return docs.select(row.alias("row")).mapInArrow(run, f"row struct<{fields}>, score double").select("row.*", "score")
