"""WARC, searches and the classifier, against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclock.llm import ann, quality, topk, vectors, warc


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "é" * 90
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (3, "http://a/3", long), (1, "http://b", "short"), (2, "http://c", "short"), (4, "http://d\r\nx", None), (6, "http://e", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (None, "n", long), (12, "big", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload_digest string").repartition(3), rows


def test_warc(spark, pages, tmp_path):
    df, rows = pages
    index = warc.write_archives(df, f"file://{tmp_path}/w", roll_bytes=200)
    got = warc.read_records(index).collect()
    first: dict[str, int] = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html in first and i != first[html]
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(first[html] if revisit else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 3 and sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows) + len(files)
    some = warc.read_records(index.where("page_id IN (5, 12)"), with_payload=True, read_bytes=100).collect()
    assert sorted(r["page_id"] for r in some) == [5, 12]
    nothing = warc.write_archives(df.limit(0))
    assert nothing.count() == 0 and warc.read_records(nothing).count() == 0


def test_warc_finds_damage(spark, tmp_path):
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, warc.DATE)
    assert warc.parse(good)[4] == 7
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"payl0ad\r\n"))
    shutil.rmtree(tmp_path, ignore_errors=True)


def brute(rows, step, k, value, score):
    out = []
    for q, x in rows:
        if q % step == 0:
            found = sorted(((-score(value(x), value(y)), c) for c, y in rows if c != q))[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 16)) * rng.uniform(0.2, 2, (700, 1))
    x[300:420] = x[7]  # a common vector
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1002, [math.nan] * 16), (1003, [math.inf] + [0.0] * 15), (None, [1.0] * 16), (1020, [0.0] * 16), (1040, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id bigint, embedding array<float>, rank string").repartition(4)
    kept = rows + [(1020, [0.0] * 16), (1040, [0.5, 0.25] + [0.0] * 14)]
    return df, kept


def test_exact_top_k(spark, embeddings, monkeypatch):
    df, rows = embeddings
    whole = lambda v: [math.floor(64 * x) for x in v]
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = brute(rows, 20, 20, whole, product)
    for block_rows, chunk in ((topk.BLOCK_ROWS, topk.CHUNK), (100, 30)):
        monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(topk, "CHUNK", chunk)
        got = topk.top_products(df, df.where("vec_id % 20 = 0"))
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == want
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.top_products(few, few.where("vec_id = 0")).count() == 2
    none = df.limit(0)
    assert topk.top_products(none, none).count() == 0
    assert topk.top_products(df, none).count() == 0


def test_top_of_settles_ties():
    rng = np.random.default_rng(0)
    scores, ids = rng.integers(0, 4, (50, 40)), rng.permutation(40)
    best, who = vectors.top_of(scores, ids, 7)
    for s, b, w in zip(scores, best, who, strict=True):
        assert [(int(x), int(y)) for x, y in zip(b, w, strict=True)] == [(-x, y) for x, y in sorted((-int(x), int(i)) for x, i in zip(s, ids, strict=True))[:7]]


def test_nearest(spark, embeddings):
    df, rows = embeddings
    rows = [(i, v) for i, v in rows if any(v)]
    want = brute(rows, 20, 20, np.array, lambda a, b: float(a @ b))
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    truth = {(q, c) for q, _, c, _ in want}
    assert len(got) == len(want)
    assert len(truth & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(truth)
    by = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(float(np.array(by[r["query_id"]]) @ np.array(by[r["vec_id"]])), abs=1e-12)
        assert r["query_id"] != r["vec_id"]
    few = df.where("vec_id IN (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


#: Finite rows that dwarf the others, or are dwarfed by them.
HUGE = [[(2000, [1e160] + [0.0] * 15)], [(2000, [3e6] * 16), (2001, [-3e6] * 15 + [1.0])], [(2000, [1e160, -1e160] + [1.0] * 14), (2020, [1e-200] * 16), (2040, [1e150] * 16)], [(2000 + i, [10.0 ** (i - 20)] * 8 + [0.5] * 8) for i in range(40)]]


def with_huge(spark, embeddings, huge):
    rows = embeddings[1] + huge
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), rows


@pytest.mark.parametrize("huge", HUGE)
def test_exact_top_k_of_huge_vectors(spark, embeddings, huge, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    df, rows = with_huge(spark, embeddings, huge)
    whole = lambda v: [math.floor(64 * x) for x in v]
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), 2 - 2**63), 2**63 - 1)
    got = topk.top_products(df, df.where("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 20, whole, product)


@pytest.mark.parametrize("block_rows", [4096, 150])
@pytest.mark.parametrize("huge", HUGE)
def test_nearest_of_huge_vectors(spark, embeddings, huge, block_rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
    df, rows = with_huge(spark, embeddings, huge)
    rows = [(i, v) for i, v in rows if any(v)]
    want = brute(rows, 20, 20, np.array, lambda a, b: float(a @ b))
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert len(got) == len(want)
    for lo, hi in ((0, 2000), (2000, 3000)):
        truth = {(q, c) for q, _, c, _ in want if lo <= q < hi}
        assert len(truth & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(truth)
    by = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(float(np.array(by[r["query_id"]]) @ np.array(by[r["vec_id"]])), rel=1e-9, abs=1e-12)


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-9)


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("etaoin", k=rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.8
        rows.append((i, " ".join(word() if good else word() + "$$$ |" for _ in range(rng.randrange(3, 60)))))
        if i % 2:
            labels.append((i, int(good)))
    odd = [(900, None), (901, ""), (None, "text without id"), (902, "z" * 100_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id bigint, text string, score double")
    marked = spark.createDataFrame([*labels, (None, 1), (5, None), (900, 1), labels[0], labels[0]], "doc_id bigint, quality int")
    model = quality.learn(docs, marked, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == ("$" not in t) for i, t in rows) >= 0.97 * len(rows)
    again = quality.learn(docs.repartition(5), marked.repartition(2), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert all(np.allclose(a, b) for a, b in zip(model, again, strict=True))
    assert quality.learn(docs, marked.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_risk_is_least():
    """No weights of a fine grid have less risk than those found, where the second part of the risk binds and where not."""
    rng = np.random.default_rng(5)
    for prior, gap in ((0.7, 1.0), (0.85, 3.0), (0.3, 1.5)):
        side = rng.random(800) < prior
        u = np.column_stack((rng.standard_normal(800) + gap * np.where(side, 1, -1), np.ones(800)))
        p = np.column_stack((rng.standard_normal(300) + gap, np.ones(300)))
        loss = lambda z: math.log1p(math.exp(-z))

        def plain(w: tuple[float, float], p=p, u=u, prior=prior) -> float:
            z = [w[0] * a + w[1] for a, _ in p], [w[0] * a + w[1] for a, _ in u]
            mean = lambda values: sum(values) / len(values)
            rest = mean([loss(-v) for v in z[1]]) - prior * mean([loss(-v) for v in z[0]])
            return prior * mean([loss(v) for v in z[0]]) + max(0.0, rest)

        found = quality.minimise(p, u, prior, steps=1500, decay=0.0)
        assert quality.risk(p, u, found, prior) == pytest.approx(plain(tuple(found)), abs=1e-9)
        grid = [(a, b) for a in np.linspace(0, 6, 25) for b in np.linspace(-4, 6, 21)]
        assert quality.risk(p, u, found, prior) <= min(map(plain, grid)) + 0.01


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_quality_prior_is_estimated(prior):
    rng = np.random.default_rng(9)
    side = rng.random(3000) < prior
    rows = lambda n, up: np.column_stack((rng.standard_normal((n, 3)) + np.where(up, 2.0, -2.0)[:, None], np.ones(n)))
    assert quality.class_prior(rows(1500, np.ones(1500, bool)), rows(3000, side)) == pytest.approx(prior, abs=0.05)


@pytest.mark.parametrize("search", [topk.top_products, ann.nearest])
def test_all_vectors_of_a_query_id_are_searched(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    found = search(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()
    unit = 64 * 64 if search is topk.top_products else 1
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 3 * unit), (0, 2, 2, 2 * unit), (0, 3, 1, 0)]
