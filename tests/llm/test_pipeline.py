"""The pipeline's stages on awkward rows."""

from __future__ import annotations

import base64
import random
import zlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "stage")
        assert docs.columns == DOCUMENTS, name
        assert 0 < docs.count() <= n
        n = docs.count()
        assert docs.where("n_chars <> length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_stages_keep_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, "1234", "en", "s", 4), (4, "plain words stay here", "en", None, 21), (4, "plain words stay here", "en", None, 21), (None, "plain words without id", "en", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in first.collect()) == ["4", "4", "None"]
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == DOCUMENTS and out.count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_tells_strange_texts(spark):
    """Long texts of no learned language go, short clean texts stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENTS).where("text rlike '[A-Za-z]'")
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(3000))
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."
    odd = [letters, base64.b64encode(rng.randbytes(2000)).decode(), russian]
    rows = [(1_000_000 + i, text, lang, "odd", len(text)) for i, (text, lang) in enumerate([*((t, None) for t in odd), (letters[::-1], "en"), ("A.", "en"), ("Des enberge die enver.", "de"), ("ж", None)])]
    kept = corpus_pipeline.STAGES[0][1](spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF)
    assert sorted(r["text"] for r in kept.where("source = 'odd'").collect()) == sorted(["A.", "Des enberge die enver.", "ж"])
    assert kept.where("source <> 'odd'").count() == docs.where("source <> 'odd'").count()


def test_language_stage_judges_by_well_taught_languages_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENTS).where("lang = 'es' AND text rlike '[A-Za-z]'")
    thin = [(3, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "thin", 63), (5, "Falsches Üben von Xylophonmusik quält jeden größeren Zwerg, sagt der müde Nachbar im Hof", "de", "thin", 88)]
    few = spark.createDataFrame(thin, docs.schema)
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(3).union(few), SF).count() == 5
    assert corpus_pipeline.STAGES[0][1](spark, docs.union(few), SF).where("source = 'thin'").count() == 2


def test_language_stage_without_a_learned_language(spark):
    """An unlabelled corpus, and one whose labelled rows are all held out, lose only what has no letter."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = ["plain words stay here", "другие слова " * 40, "A.", "1234", "", None]
    unlabelled = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], schema)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    held_out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(held, texts, strict=False)], schema)
    for docs in (unlabelled, held_out):
        assert sorted(r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()) == sorted(texts[:3])


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(200)]
    first, near, other = " ".join(words), " ".join([*words[:-2], "x", "y"]), " ".join(f"v{i}" for i in range(200))
    rows = [(1, first), (5, near), (5, other), (5, first), (9, other), (None, first), (7, None), (7, "1"), (8, other), (8, other), (3, " ".join(f"u{i}" for i in range(50)))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str(rows[i]) for i in (0, 2, 5, 6, 7, 10))


def test_stages_with_long_texts_ties_and_clashing_columns(spark):
    """Columns that stages make themselves, a text of a megabyte, and equal texts under different ids."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9)))
    long = " ".join(word() for _ in range(150_000))
    tie = "The same text stands under two ids. " + " ".join(word() for _ in range(80))
    rows = [(1, long, 0.5, "x", True, 7), (2, tie, 0.1, "y", False, 8), (3, tie, 0.2, "z", True, 9), (3, tie, 0.2, "z", True, 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *more) for i, t, *more in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept_text string, kept boolean, n_words int")
    ids = {"language ID": [1, 2, 3, 3], "line dedup": [1, 2, 3, 3], "MinHash near-dedup": [1, 2], "substring dedup": [1, 2, 3, 3]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == DOCUMENTS, name
        rows_out = out.collect()
        assert sorted(r["doc_id"] for r in rows_out) == ids[name]
        assert next(r["text"] for r in rows_out if r["doc_id"] == 1) == long
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("doc_id = 1").agg({"length": "sum"}).first()[0] == pieces.where("doc_id = 1").first()["doc_tokens"]
