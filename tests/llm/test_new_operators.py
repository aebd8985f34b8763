"""N-gram joins, vector codes and fill-in-middle against plain Python, on fixtures with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duoclock.llm import codes, common, fim, jaccard, minhash

from .test_text_operators import SCHEMA, brute_components, docs, empty, prose, texts  # noqa: F401


@pytest.mark.parametrize(("k", "per_cent", "trade"), [(4, 85, 1), (1, 60, 2), (2, 100, 64)])
def test_join(docs, texts, k, per_cent, trade):  # noqa: F811
    got = jaccard.join(docs, k, per_cent, trade).collect()
    plain = lambda x: -1 if x is None else x
    assert sorted((plain(r["doc_id"]), r["n_shingles"], plain(r["component_id"])) for r in got) == brute_components(texts, k, per_cent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def template_pages(n: int, shared: int, own: int, seed: int = 1) -> list[tuple[int, str]]:
    """Pages of one template; every tenth is nearly a copy of the one before."""
    rng, out = random.Random(seed), []
    common_words = [f"shared{i}" for i in range(shared)]
    for i in range(n):
        words = [*common_words, *(f"own{i}x{j}" for j in range(own))]
        if i % 10 == 1:
            words = [*out[-1][1].split()[:-1], f"last{i}"]
        elif i % 7 == 2:
            words[rng.randrange(shared)] = f"changed{i}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("shared", "own"), [(100, 30), (60, 3)])
def test_pages_of_one_template(spark, shared, own):
    rows = template_pages(120, shared, own)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for got, k, per_cent in ((jaccard.join(frame, 4, 85, 8), 4, 85), (minhash.near_duplicates(frame, 2, 80), 2, 80)):
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, k, per_cent)


def test_index_of_a_template_grows_with_documents(spark):
    """Documents alike in a template only leave no pairs to look at."""
    for n in (100, 200):
        rows = [(i, i, f"{' '.join(f's{j}' for j in range(100))} {' '.join(f'o{i}x{j}' for j in range(30))}") for i in range(n)]
        frame = spark.createDataFrame(rows, "id bigint, cx bigint, text string")
        placed = frame.where("id > 0").selectExpr("id AS x", "0L AS y", "cx", "0L AS cy")
        possible, sure = minhash._index_pairs(placed, frame.select("id", "text"), 2, 80, 4)
        assert possible.count() == 0 and sure.count() == 0


def test_segments_keep_every_link():
    """Sets that are similar enough share a key, whatever their sizes; one-deletion keys meet."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 6, 11, 40, 333):
        for _ in range(20):
            one = rng.integers(0, 1 << 63, (2, n), np.uint64)
            lost = int(rng.integers(0, jaccard.most_apart(n, n, 85) + 1))
            other = one[:, lost:] if n > lost and 100 * (n - lost) >= 85 * n else one
            keys = []
            for s in (one, other):
                s = s[:, np.argsort(s[0])]
                keys.append({int(x) for b, _, m, _ in jaccard.roles(s.shape[1], 85) for x in jaccard.Segments(s, b, m).keys()})
            assert keys[0] & keys[1]
    one = rng.integers(0, 1 << 63, (2, 12), np.uint64)
    one = one[:, np.argsort(one[0])]
    whole, less = jaccard.Segments(one, 3, 1), jaccard.Segments(one[:, 1:], 3, 1)
    assert less.keys(1)[0] in whole.less_one(np.array([0]), 1)


def test_near_copies_make_no_near_misses(spark, monkeypatch):
    """A group of near copies is found by its pivot alone, and segments that are empty by chance can be passed over."""
    monkeypatch.setattr(jaccard, "_near_misses", None)
    common_words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*common_words[: i % 97], f"own{i}", *common_words[i % 97 :]])) for i in range(100)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4, 85)
    for n in (8, 40, 232, 1000, 5000):
        for _, _, m, spare in jaccard.roles(n, 85):
            expected = m * (1 - 1 / m) ** n  # empty segments
            assert spare >= 1 and (n < 40 or spare >= 10 * expected)


@pytest.mark.parametrize(("k", "per_cent"), [(4, 85), (1, 60), (2, 100)])
def test_join_by_kept_keys(docs, texts, k, per_cent):  # noqa: F811
    got = jaccard.join(docs, k, per_cent).collect()
    plain = lambda x: -1 if x is None else x
    assert sorted((plain(r["doc_id"]), r["n_shingles"], plain(r["component_id"])) for r in got) == brute_components(texts, k, per_cent)


def test_keys_passed_over_draw_no_set_in(spark):
    """A key that two sets of a cluster keep, and many others pass over, is a key of those two only."""
    hot = [(i, 0, 0, 7, 40) for i in range(40)]
    cluster = [(i, 0, at, 10 + at, 50 + at) for i in (0, 1) for at in (1, 2)]
    listed = spark.createDataFrame(hot + cluster, "id bigint, band int, at bigint, key bigint, count bigint")
    limits = spark.createDataFrame([(i, 0, 9, 1) for i in range(40)], "id bigint, band int, m int, spare int")
    got = jaccard.searched_by(jaccard.allocate(listed, limits), None, 2).collect()
    assert sorted((r["id"], r["key"]) for r in got) == [(0, 7), (0, 11), (1, 7), (1, 11)]


def test_large_keys_of_a_cluster_share_a_pivot(spark):
    """Ten keys of a cluster, each with its own heaviest member, lead to one pivot if its members share a key; small keys keep theirs."""
    rows = [(i, 100 - i, [i % 10, 50]) for i in range(60)] + [(100, 5, [99]), (101, 4, [99])]
    members = spark.createDataFrame(rows, "id bigint, weight bigint, keys array<bigint>")
    plain, merged = (minhash.to_pivots(members, 2, merge).collect() for merge in (None, 4))
    assert len(plain) == 59 + 45 + 1
    assert sorted((r["x"], r["y"]) for r in merged) == [*((i, 0) for i in range(1, 60)), (101, 100)]
    # members of one key still are a pair or have a pivot in common
    of = lambda x: {x} | {r["y"] for r in merged if r["x"] == x}
    assert all(of(i) & of(j) for i, _, a in rows for j, _, b in rows if set(a) & set(b))


def test_join_on_nothing(empty):  # noqa: F811
    assert jaccard.join(empty).count() == 0


def plain_codes(rows: list[tuple[int | None, list[float]]], parts: int, entries: int, rounds: int, scale: int) -> tuple[list, list]:
    """Lloyd's rounds in Python's integers: (id, code, error) and the codebooks."""
    floor = lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)
    good = sorted(((i is None, i or 0, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1], r[2]))
    d = max(1, -(-max((len(v) for *_, v in good), default=0) // parts))
    whole = [[floor(x) for x in v] + [0] * (d * parts - len(v)) for *_, v in good]
    cut = lambda v, p: v[p * d : (p + 1) * d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    book = [[cut(v, p) for v in whole[:entries]] for p in range(parts)]
    near = lambda v, p: min(range(len(book[p])), key=lambda i: (far(cut(v, p), book[p][i]), i))
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for v in whole:
            for p in range(parts):
                groups[p][near(v, p)].append(cut(v, p))
        book = [[[sum(x) // len(g) for x in zip(*g, strict=True)] if (g := groups[p].get(i)) else e for i, e in enumerate(book[p])] for p in range(parts)]
    out = []
    for (missing, i, _), v in zip(good, whole, strict=True):
        found = [near(v, p) for p in range(parts)]
        error = sum(far(cut(v, p), book[p][e]) for p, e in enumerate(found))
        out.append((None if missing else i, bytes(found).hex(), error if error < 1 << 63 else None))
    return out, book


VECTORS = "vec_id bigint, embedding array<double>, label int, code string, error string"


def awkward_vectors() -> list[tuple]:
    rng = random.Random(4)
    rows: list[tuple] = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3 if i % 5 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] + [0.0] * 5, 1)]
    rows += [(7, [0.5] * 6, 2), (7, [0.5] * 6, 2), (None, [0.25] * 6, None), (204, [1.0, 2.0], 0), (205, [], 0)]
    return rows


@pytest.mark.parametrize("odd", [[], [(206, [1e160, 0.0, 0.0, -1e308, 3.0, 1.0], 9)], [(-1, [3e6] * 6, 8), (-2, [-7e9, 1.0, 1.0, 1.0, 2.0**60, 0.0], 9)]])
def test_codes(spark, odd):
    rows = awkward_vectors() + odd
    frame = spark.createDataFrame([(*r, "c", "e") for r in rows], VECTORS).repartition(3)
    codec = codes.train(frame, parts=3, entries=5, rounds=4, scale=64, block_rows=40, leaf=4)
    out = codes.with_group_error(codec.encoded())
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    want, book = plain_codes([r[:2] for r in rows], 3, 5, 4, 64)
    got = out.collect()
    key = lambda r: tuple(map(str, r))
    assert codec.book == book and sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    sums = defaultdict(list)
    for r in got:
        sums[r["label"]].append(r["error"])
    for r in got:
        errors = sums[r["label"]]
        assert r["label_error"] == (None if None in errors or sum(errors) >= 1 << 63 else sum(errors))
    if not odd:
        vectors = {r["vec_id"]: r["vector"] for r in codec.decoded(codec.encoded()).collect()}
        code = dict(want_[:2] for want_ in want)
        assert vectors[3] == [x / 64 for p, e in enumerate(bytes.fromhex(code[3])) for x in book[p][e]]


def test_codes_of_little(spark):
    none = codes.train(spark.createDataFrame([], VECTORS))
    assert none.book == [] and none.encoded().count() == 0
    few = codes.train(spark.createDataFrame([(1, [1.0, 2.0], 1, "", ""), (2, [1.0, 2.0], 1, "", "")], VECTORS), parts=2, entries=16)
    assert few.book == [[[4096], [4096]], [[8192], [8192]]] and {r["code"] for r in few.encoded().collect()} == {"0000"}


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_filter_against_every_entry(leaf):
    rng = np.random.default_rng(leaf)
    for _ in range(30):
        n, d, k, w = int(rng.integers(1, 200)), int(rng.integers(1, 5)), int(rng.integers(1, 9)), int(rng.choice([1, 5, 1000, 1 << 20]))
        points = rng.integers(-w, w + 1, (n, d)).astype(np.int32)
        book = [[int(x) for x in points[rng.integers(n)]] for _ in range(k)]
        if k > 2:
            book[0], book[-1] = [10**30] * d, [1 << 29] * d
        tree = codes.Tree(*codes.build(points, leaf), np.empty(0, int), [])
        found, errors = np.zeros(n, np.uint8), [0] * n
        counts, sums, single = tree.assign(book, leaf, found, errors)
        want = [codes._nearest(p, book) for p in points.tolist()]
        assert list(zip(found.tolist(), errors, strict=True)) == want
        for e, p in single:
            counts[e] += 1
            sums[e] += np.array(p)
        for e in range(k):
            mine = points[[w_ == e for w_, _ in want]].astype(np.int64)
            assert counts[e] == len(mine) and sums[e].tolist() == mine.sum(axis=0).tolist()


def plain_fim(key: str, text: str, unit: str) -> tuple:
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if unit == "word" else list(text)
    n, h = len(tokens), hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(spark, docs, texts, unit):  # noqa: F811
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "é", "日", "😀", " ", "\n", " ", "\x1c", "<", "P", ">", "<S", "M>"]) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    rows = [*texts, *((1000 + i, t) for i, t in enumerate(odd)), (5000, "word " * 200_000), (5001, "<M> in it"), (5003, "<" * 50 + "S>")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA).withColumn("form", F.lit("clash"))
    out = fim.restore(fim.fill_in_middle(frame, unit))
    assert out.columns == [*[c for c in frame.columns if c != "form"], *fim.ADDED, "restored_text"]
    got = out.collect()
    want = [("" if i is None else str(i), *plain_fim("" if i is None else str(i), t or "", unit)) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str(("" if r["doc_id"] is None else str(r["doc_id"]), *(r[c] for c in fim.ADDED))) for r in got)
    assert all(r["restored_text"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(empty):  # noqa: F811
    assert fim.restore(fim.fill_in_middle(empty)).count() == 0
    assert fim.restored(None, "psm") is None and fim.restored("x", None) == "x"


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "", "c", "d" * 50])], names=["i", "t"])
    parts = list(common.by_bytes(batch, 1, most=20, rows=3))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5]]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, lost in ((10, 2), (300, 40), (3000, 900)):
        one = rng.integers(0, 1 << 63, n, np.uint64)
        other = np.concatenate((one[lost:], rng.integers(0, 1 << 63, lost, np.uint64)))
        a, b = minhash.parities(one, jaccard.most_apart(n, n, 85)), minhash.parities(other, 5)
        assert minhash._apart_at_least(a, b) <= 2 * lost
        assert minhash._apart_at_least(a, minhash.parities(one, 3)) == 0
