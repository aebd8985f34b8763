"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens: it starts as one state in which every byte loops. Each merge (u, v) -> w, in
order of priority, adds a gadget: a copy of the state that u leads to, without its arc v, takes over all arcs
u, and wherever an arc u was, an arc w now leads to where v led. What is left are the token sequences that BPE
can give, one for each byte string, so encoding is finding the one path whose labels spell the word.

All arcs of a label lead to one state, so the state reached is known by the last label, and a word is encoded by one
pass over its bytes through a table of transitions, without going back. The gadgets keep their arcs by difference to
the state copied; a row of the table is filled in from them as texts use it, as the whole table would hold the square
of the vocabulary. Words and what stands between single spaces are remembered, in memory bounded in bytes.

Null text counts as empty. Special tokens of the tokenizer's file that stand in a text become their ids. Each row is
encoded for itself, so repeated rows and null ids give rows of their own; very long texts are encoded whole, and runs
of over 96 characters without a space aren't remembered. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-split pattern and the byte alphabet of this family of tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Up to U+024F these are all the characters that the standard library's \w has besides letters, \d and _.
_NO = "²³¹¼½¾"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_{_NO}]+| ?[\d{_NO}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_QUICK = re.compile("[^\x00-\x1b\x20-ɏ]")
_FULL = regex.compile(SPLIT)


def split_words(text: str) -> list[str]:
    """The text cut into the pieces that BPE works on."""
    return (_FULL if _NOT_QUICK.search(text) else _QUICK).findall(text)


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Strings of more characters are worked out each time, and a memo starts anew beyond this many bytes (estimated).
LONGEST_KEPT, MEMO_BYTES = 96, 96 << 20


class Memo(dict):
    """What `make` gives for keys met before, in bounded memory. Found keys cost one look-up in compiled code."""

    def __init__(self, make: Callable, limit: int = MEMO_BYTES):
        self.make, self.limit, self.held = make, limit, 0

    def keep(self, key: str, value) -> None:
        if len(key) <= LONGEST_KEPT:
            self.held += 200 + 4 * len(key) + 8 * len(value or ())
            self[key] = value

    def keep_all(self, keys: Iterable[str], values: list) -> None:
        """As keep, for keys of at most LONGEST_KEPT characters."""
        self.update(zip(keys, values, strict=True))
        self.held += 200 * len(values) + 4 * sum(map(len, keys)) + 8 * sum(map(len, values))

    def trim(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0

    def __missing__(self, key: str):
        value = self.make(key)
        self.trim()
        self.keep(key, value)
        return value


class TextEncoder:
    """Texts to ids: entry(word) gives those of one word, join(entries) puts entries together.

    The pattern puts a single space before its word, so between single spaces a text can be cut without a look at
    what is near, unless white space borders on the cut; then the whole text goes through the pattern.
    entries(words) is entry for many words at once.
    """

    def __init__(self, entry: Callable, join: Callable, specials: dict[str, int], special_entry: Callable, entries: Callable, limit: int = MEMO_BYTES):
        self.words = Memo(entry, limit)
        self.chunks = Memo(self._chunk, limit)
        self.join, self.specials, self.special_entry, self.entries = join, specials, special_entry, entries
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _chunk(self, chunk: str):
        """None, which no join takes, where white space borders on the cut."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self.join(map(self.words.__getitem__, split_words(" " + chunk)))

    def prepare(self, texts: list[str]) -> None:
        """Learn the words between single spaces that are new in these texts, together."""
        self.words.trim()
        self.chunks.trim()
        new = set().union(*(t.split(" ")[1:] for t in texts)) - self.chunks.keys()
        one = [c for c in new if c.isalpha() and len(c) <= LONGEST_KEPT]  # letters alone are one word
        self.chunks.keep_all(one, self.entries([" " + c for c in one]))
        split = {c: split_words(" " + c) for c in new.difference(one) if c and len(c) <= LONGEST_KEPT and not (c[0].isspace() or c[-1].isspace())}
        missing = list(set(chain.from_iterable(split.values())) - self.words.keys())
        self.words.keep_all(missing, self.entries(missing))
        find, join = self.words.__getitem__, self.join
        self.chunks.keep_all(split, [find(w[0]) if len(w) == 1 else join(map(find, w)) for w in split.values()])

    def _plain(self, text: str):
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.join(chain([self.join(map(self.words.__getitem__, split_words(first)))], map(self.chunks.__getitem__, rest)))
            except TypeError:
                pass
        return self.join(map(self.words.__getitem__, split_words(text)))

    def encode(self, text: str):
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return self._plain(text)
        return self.join([self.special_entry(self.specials[part]) if i % 2 else self._plain(part) for i, part in enumerate(parts)])


class Transitions:
    """The automaton's table: whether the state that a label leads to has an arc. -1 is the start, with all arcs.

    An open hash table of the cells that texts use, filled in from the gadgets; it grows to `limit` slots, then starts anew.
    """

    def __init__(self, arc: Callable, limit: int = 1 << 23):
        self.arc, self.limit = arc, limit
        self._start(1 << 16)

    def _start(self, slots: int) -> None:
        self.keys, self.found, self.held = np.full(slots, -1, np.int64), np.zeros(slots, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the empty slot where it would."""
        mask = len(self.keys) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        todo = np.arange(len(keys))
        while len(todo):
            at = self.keys[slot[todo]]
            todo = todo[(at != keys[todo]) & (at != -1)]
            slot[todo] = (slot[todo] + 1) & mask
        return slot

    def _put(self, keys: np.ndarray, found: np.ndarray) -> None:
        if 2 * (self.held + len(keys)) > len(self.keys):
            old, values = self.keys[self.keys >= 0], self.found[self.keys >= 0]
            slots = 1 << (4 * (self.held + len(keys))).bit_length()
            self._start(min(slots, self.limit) if slots <= self.limit else max(1 << 16, 1 << (4 * len(keys)).bit_length()))
            if slots <= self.limit:
                self._put(old, values)
        mask = len(self.keys) - 1
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), found.tolist(), strict=True):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & mask
            self.keys[slot], self.found[slot] = key, value
        self.held += len(keys)

    def have(self, labels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = (labels + 1) << 32 | tokens
        slot = self._slots(keys)
        new = self.keys[slot] != keys
        if new.any():
            cells = np.unique(keys[new])
            self._put(cells, np.array([self.arc((c >> 32) - 1, c & 0xFFFFFFFF) for c in cells.tolist()]))
            slot = self._slots(keys)
        return self.found[slot]


class Automaton:
    """The tokenization automaton of a tokenizer's file."""

    def __init__(self, vocab: dict[str, int], merges: list, specials: dict[str, int]):
        alphabet = byte_of_char()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *specials.values()], default=0))
        for s, i in vocab.items():
            if s not in specials:
                self.labels[i] = as_bytes(s)
        for s, i in specials.items():
            self.labels[i] = s.encode()
        self.names = [*map(str, range(len(self.labels)))]
        self.specials = specials
        self.left: dict[int, int] = {}  # label -> the left part of its merge
        self.born: dict[int, int] = {}  # label -> when it came; 0 for bytes
        self.times: dict[int, list[int]] = {}  # label -> when each later version of its state came
        self.dropped: dict[int, dict[int, int]] = {}  # label -> arc -> the version that lacks it first
        self.base: dict[int, tuple[int, int] | None] = {}  # label -> its version 0, a state of another label; None: the root
        self.table = Transitions(self.leads_on)
        self.cells: dict[tuple[int, int], bool] = {}
        for s, i in vocab.items():
            if len(s) == 1 and s not in specials:
                self.born[i], self.base[i], self.times[i], self.dropped[i] = 0, None, [], {}
        for k, pair in enumerate(merges, 1):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._merge(k, vocab[u], vocab[v], vocab[u + v])
        self.prefixes: dict[bytes, int] = {}
        for i in self.born:
            label = self.labels[i]
            for n in range(1, len(label)):
                self.prefixes.setdefault(label[:n], -1)
            self.prefixes[label] = i
        # the same as a table: a node for each beginning of a label, those that go on first
        goes_on = {x[:-1] for x in self.prefixes}
        number = {x: i for i, x in enumerate(sorted(goes_on | self.prefixes.keys(), key=lambda x: (x not in goes_on, len(x))))}
        self.next = np.zeros((len(goes_on), 256), np.int32)  # 0, the root: nothing
        self.token = np.full(len(number), -1, np.int64)
        for x, i in self.prefixes.items():
            self.next[number[x[:-1]], x[-1]] = number[x]
            self.token[number[x]] = i
        self.sizes = np.array([len(x) for x in self.labels])

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls(spec["model"]["vocab"], spec["model"]["merges"], {x["content"]: x["id"] for x in spec["added_tokens"]})

    def _merge(self, k: int, u: int, v: int, w: int) -> None:
        """Add the gadget of merge k, unless no state has an arc u that leads to an arc v."""
        if u not in self.born or v not in self.born or not self.has_arc(u, len(self.times[u]), v):
            return
        if w not in self.born:
            self.left[w], self.born[w], self.times[w], self.dropped[w] = u, k, [], {}
            self.base[w] = (v, len(self.times[v]))
        self.times[u].append(k)
        self.dropped[u][v] = len(self.times[u])

    def has_arc(self, label: int, version: int, token: int) -> bool:
        """Whether the state of this label and version has an arc `token`."""
        while True:
            if version == 0:
                below = self.base[label]
                if below is None:
                    return True  # the root has every arc
                label, version = below
                continue
            if self.dropped[label].get(token, version + 1) <= version:
                return False
            version = min(version, bisect_right(self.times[label], self.born[token]))
            if version:  # the arc came later than the state, to every state with an arc for its left part
                token = self.left[token]

    def leads_on(self, label: int, token: int) -> bool:
        """Whether the state that this label leads to has an arc `token`; the start, -1, has all."""
        return label < 0 or self.has_arc(label, len(self.times[label]), token)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The labels of the one path that spells the word.

        The path of each beginning of the word is unique too, so one pass over the bytes, without going back, gives
        the last arc of each: what follows the beginning `start` with an arc is the last arc of a longer one.
        """
        data = word.encode("utf-8", "surrogatepass")
        size, tokens, cells = len(data), self.prefixes.get, self.cells
        whole = tokens(data, -1)
        if whole >= 0:
            return (whole,)
        last = array("i", [-1]) * (size + 1)
        for start in range(size):
            before = last[start]
            for end in range(start + 1, size + 1):
                token = tokens(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    has = cells.get((before, token))
                    if has is None:
                        if len(cells) > 500_000:
                            cells.clear()
                        has = cells[before, token] = self.leads_on(before, token)
                    if has:
                        last[end] = token
        path, end = [], size
        while end:
            path.append(last[end])
            end -= len(self.labels[path[-1]])
        return tuple(path[::-1])

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """encode_word for many words, a step of all of them at a time; long ones go by themselves."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        short = []
        for i, x in enumerate(data):
            token = self.prefixes.get(x, -1)
            if token >= 0:
                out[i] = (token,)
            elif len(x) > 40:
                out[i] = self.encode_word(words[i])
            else:
                short.append(i)
        short.sort(key=lambda i: -len(data[i]))
        for at in range(0, len(short), 16_384):
            part = short[at : at + 16_384]
            for i, path in zip(part, self._paths([data[i] for i in part]), strict=True):
                out[i] = path
        return out

    def _paths(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words in descending length, so that those with a byte at a place come first."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes[0])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        last = np.full((width + 1, len(words)), -1, np.int64)
        longer = [int(np.searchsorted(-sizes, -n, side="left")) for n in range(width + 1)]  # how many words have over n bytes
        inner = len(self.next)
        for start in range(width):
            row, node = np.arange(longer[start]), np.zeros(longer[start], np.int32)
            for end in range(start + 1, width + 1):
                node = self.next[node, text[row, end - 1]]
                token = self.token[node]
                arc = np.flatnonzero((node > 0) & (token >= 0))
                if len(arc):
                    who, what = row[arc], token[arc]
                    has = self.table.have(last[start, who], what)
                    last[end, who[has]] = what[has]
                on = (node > 0) & (node < inner) & (row < (longer[end] if end < width else 0))
                row, node = row[on], node[on]
                if not len(row):
                    break
        steps, end, row = [], sizes.copy(), np.arange(len(words))
        while len(row):
            token = last[end[row], row]
            steps.append((row, token))
            end[row] -= self.sizes[token]
            row = row[end[row] > 0]
        # steps go from each word's end to its start
        who, what = np.concatenate([r for r, _ in steps]), np.concatenate([t for _, t in steps])
        order = np.argsort(who, kind="stable")
        cuts = np.cumsum(np.bincount(who, minlength=len(words))).tolist()
        what = what[order].tolist()
        return [tuple(what[lo:hi][::-1]) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@cache
def automaton(path: str) -> Automaton:
    """One automaton a Python worker."""
    return Automaton.from_file(path)


@cache
def text_encoder(path: str) -> TextEncoder:
    """Entries are tuples of token ids."""
    machine = automaton(path)
    return TextEncoder(machine.encode_word, lambda parts: tuple(chain.from_iterable(parts)), machine.specials, lambda token: (token,), machine.encode_words)


def _batches(columns: list[str], out: pa.Schema, work: Callable) -> Callable:
    """An Arrow function that keeps the first column and works on the second, in small slices of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(done, list(out)[1:], strict=True))], schema=pa.schema([pa.field(columns[0], part.column(0).type), *list(out)[1:]]))

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""

    def work(texts: list[str]) -> list:
        encoder = text_encoder(path)
        encoder.prepare(texts)
        return [[list(encoder.encode(t)) for t in texts]]

    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    source = _texts(docs, id_col, text_col)
    return source.mapInArrow(_batches(["id"], schema, work), f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts that the ids spell; null ids count as none."""

    def work(rows: list) -> list:
        machine = automaton(path)
        return [[machine.decode(ids or []) for ids in rows]]

    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    source = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(_batches(["id"], schema, work), f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded, where both stay in one worker."""

    def work(texts: list[str]) -> list:
        machine, encoder = automaton(path), text_encoder(path)
        counts, coded, decoded = [], [], []
        encoder.prepare(texts)
        for text in texts:
            ids = encoder.encode(text)
            counts.append(len(ids))
            coded.append(hashlib.sha256(",".join(map(machine.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
        return [counts, coded, decoded]

    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    source = _texts(docs, id_col, text_col)
    return source.mapInArrow(_batches(["id"], schema, work), f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
