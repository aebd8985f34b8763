"""Whole queries: against DuckDB where SQL can express them, else against plain Python or held-out truth."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from duoclock.llm import queries
from duoclock.llm.langid import DIM, SEED

from .test_text_operators import brute_components

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_language(spark):
    truth = dict(rows(spark, MEDIUM, "documents", "doc_id", "lang"))
    got = queries.QUERIES["op3_language_id"](spark, MEDIUM).collect()
    assert {r["doc_id"] for r in got} == set(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def plain_language(taught: list[tuple[str, str]], texts: list[str]) -> list[tuple[str, float]]:
    """Profiles made letter by letter."""
    known: dict[str, np.ndarray] = {}

    def letter(c: str) -> np.ndarray:
        code = 0 if c == " " else ord(c)
        if c not in known:
            known[c] = np.random.default_rng([SEED, code]).integers(0, 2, DIM, np.int8) * 2 - 1
        return known[c].astype(int)

    def profile(text: str) -> np.ndarray:
        clean = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
        while "  " in clean:
            clean = clean.replace("  ", " ")
        out, grams = np.zeros(DIM), defaultdict(int)
        for i in range(len(clean) - 2):
            grams[clean[i : i + 3]] += 1
        for g, n in grams.items():
            out += n * (np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2]))
        return out

    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIM))
    for text, lang in taught:
        sums[lang] += profile(text)
    names, out = sorted(sums), []
    for text in texts:
        p = profile(text)
        cosines = [p @ sums[k] / (np.linalg.norm(p) * np.linalg.norm(sums[k])) for k in names] if any(c.isalpha() for c in text) else []
        out.append((names[int(np.argmax(cosines))], max(cosines)) if cosines else ("und", 0.0))
    return out


def test_language_by_letters(spark):
    docs = rows(spark, SMALL, "documents", "doc_id", "text", "lang")[:60]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").createOrReplaceTempView("some_documents")
    from pyspark.sql import functions as F

    from duoclock.llm import langid

    frame = spark.table("some_documents")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame, langid.learn(frame, F.col("doc_id") % 3 > 0)).collect()}
    want = plain_language([(t, lang) for i, t, lang in docs if i % 3], [t for _, t, _ in docs])
    for (i, _, _), (lang, score) in zip(docs, want, strict=True):
        assert got[i][0] == lang and got[i][1] == pytest.approx(max(0.0, score), abs=1e-6)


def test_quality(spark):
    truth = dict(rows(spark, MEDIUM, "labels", "doc_id", "quality"))
    got = queries.QUERIES["op5_quality"](spark, MEDIUM).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[p > q for q in bad] for p in good]) > 0.95
    assert np.mean([p == y for _, p, y in held]) > 0.93


def test_nearest(spark):
    data = [(i, np.array(v, float)) for i, v in rows(spark, MEDIUM, "embeddings", "vec_id", "embedding")]
    got = defaultdict(set)
    for r in queries.QUERIES["op8_ann"](spark, MEDIUM).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q, x in data:
        if q % 20 == 0:
            best = {c for _, c in sorted((-float(x @ y), c) for c, y in data if c != q)[:20]}
            hit, total = hit + len(best & got[q]), total + 20
    assert hit >= 0.9 * total


def test_tokens(spark):
    machine = Tokenizer.from_file(queries.TOKENIZER)
    docs = dict(rows(spark, SMALL, "documents", "doc_id", "text"))
    ids = {i: machine.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}
    for r in queries.QUERIES["op9_bpe"](spark, SMALL).collect():
        x = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(machine.decode(x, skip_special_tokens=False).encode()).hexdigest()
    seen = defaultdict(int)
    for r in queries.QUERIES["op7_packing"](spark, SMALL).collect():
        x = [*ids[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in x))
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) + 1 for i, x in ids.items()}


def test_pipeline_by_hand(spark):
    """The stages' decisions, worked out in plain Python from what each was given."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.staged(stage(spark, frame, SMALL), "step")
        steps.append({r["doc_id"]: r["text"] for r in frame.collect()})
    first, second, third, fourth = steps
    assert all(docs[i] == t for i, t in first.items()) and all(not any(c.isalpha() for c in docs[i] or "") for i in set(docs) - set(first))

    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    held = defaultdict(set)
    for i, t in first.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    assert second == {i: "\n".join(x for x in t.split("\n") if not (len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]))) for i, t in first.items()}

    parts = brute_components(sorted(second.items()), 5, 80)
    assert set(third) == {i for i, _, c in parts if i == c} and all(third[i] == second[i] for i in third)

    windows: dict[tuple, int] = {}
    split = {i: t.encode().split() for i, t in third.items()}
    for i in sorted(split):
        for p in range(len(split[i]) - 49):
            windows.setdefault(tuple(split[i][p : p + 50]), i)
    for i, w in split.items():
        gone = {p + j for p in range(len(w) - 49) if windows[tuple(w[p : p + 50])] < i for j in range(50)}
        assert fourth[i] == (b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else third[i])
