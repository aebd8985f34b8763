"""Fill-in-middle: a text's middle is moved behind its suffix, so that a model learns to fill it in.

A text is kept as run-length classes: maximal runs of characters of one class (ASCII white space, or others by the
number of their UTF-8 bytes), each with the code points and units that end with it. A unit is a code point or a word:
the white space before a word belongs to it, and white space at the end is one more. A cut after k units is found by
binary search for the run that holds the k-th; where in the run follows by arithmetic, as its characters have one
width.

Both cuts, whether a text is transformed and which form it takes come from the SHA-256 of seed and id, so a retried
task gives the same. Null or empty text stays an empty plain one, and so do texts that hold a mark as they are. A null
id counts as an empty one; rows that share an id share the draws, each on its own text. Texts are worked on whole,
about a megabyte at a time. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that are transformed, and of those that start with the suffix.
RATE, SPM_RATE, SEED = 50, 80, 42
ADDED = ("n", "form", "prefix_chars", "middle_chars", "fim_text")

#: A byte's class: 0 for white space, else the width of the character that it starts, or 9 inside a character.
_CLASS = np.ones(256, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 9, 2, 3, 4


class ClassRuns:
    """Runs of a text in UTF-8: where each starts in bytes, its characters' width, and points and units up to its end."""

    def __init__(self, data: bytes, unit: str = "word"):
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        leads = np.flatnonzero(kind != 9)
        kinds = kind[leads]
        new = np.flatnonzero(np.diff(kinds, prepend=255))
        self.start, self.kind = leads[new], kinds[new]
        self.width = np.maximum(self.kind, 1)
        self.each = unit == "char"
        points = np.diff(new, append=len(leads))
        self.points = np.cumsum(points)
        if self.each:
            self.units = self.points
        else:  # a run ends a word if white space or nothing follows; white space ends a unit only at the end
            last = np.ones(len(new), bool)
            last[:-1] = (self.kind[:-1] != 0) & (self.kind[1:] == 0)
            self.units = np.cumsum(last)

    def __len__(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the place after k units."""
        if not k:
            return 0, 0
        run = int(np.searchsorted(self.units, k))
        before = int(self.points[run - 1]) if run else 0
        inside = (k if self.each else int(self.points[run])) - before
        return int(self.start[run]) + inside * int(self.width[run]), before + inside


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2**32 of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(key: object, text: str | None, unit: str = "word", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple:
    """(n, form, prefix_chars, middle_chars, fim_text)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    runs = ClassRuns(data, unit)
    n, (h1, h2, h3, h4) = len(runs), draws(seed, key)
    if not data or h3 % 100 >= rate or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text or ""
    (a, chars), (b, upto) = (runs.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (data[:a], data[a:b], data[b:]))
    if h4 % 100 < spm_rate:
        return n, "spm", chars, upto - chars, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", chars, upto - chars, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str | None, form: str | None) -> str | None:
    """The text that a transformed one was made of. Marks can't overlap, so the first of each is the one put in."""
    if output is None or form not in ("psm", "spm"):
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return one + middle + other if form == "psm" else other + middle + one


def _mapped(df: DataFrame, columns: tuple[str, ...], make, added: dict[str, str]) -> DataFrame:
    """df without columns called as those added, and for each row what make gives of its columns."""
    types = {"bigint": pa.int64(), "string": pa.string()}
    kept = [f for f in df.schema if f.name not in added]
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept]) if kept else F.struct(F.lit(0).alias("_none"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                found = [make(*values) for values in zip(*(part.column(i + 1).to_pylist() for i in range(len(columns))), strict=True)]
                arrays = [pa.array(list(x), types[t]) for x, t in zip(zip(*found, strict=True), added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", *added])

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept) or "_none: int"
    out = df.select(row.alias("row"), *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, f"row struct<{fields}>, " + ", ".join(f"{c} {t}" for c, t in added.items()))
    return out.select(*(["row.*"] if kept else []), *added)


def fill_in_middle(docs: DataFrame, unit: str = "word", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and n (units), form (plain, psm or spm), prefix_chars, middle_chars and fim_text, which replace columns of these names."""
    added = dict(zip(ADDED, ("bigint", "string", "bigint", "bigint", "string"), strict=True))
    return _mapped(docs, (text_col, id_col), lambda text, key: transformed(key, text, unit, rate, spm_rate, seed), added)


def restore(df: DataFrame, out_col: str = "restored_text", fim_col: str = "fim_text", form_col: str = "form") -> DataFrame:
    """All columns of df, and the texts that were transformed; a null text stays null, an unknown form counts as plain."""
    return _mapped(df, (fim_col, form_col), lambda text, form: (restored(text, form),), {out_col: "string"})
