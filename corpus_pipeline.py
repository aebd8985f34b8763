"""A corpus pipeline: language ID, line dedup, near-dedup, substring dedup and packing, each on what the last one kept.

Of a stage's input only the columns of documents count: others, whatever their names, are left out. Texts are worked on
whole, however long. An empty table gives an empty one. What nulls, ties and repeated rows mean is said with each stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclock.llm import langid, lines, minhash, packing, substring
from duoclock.llm.common import crc_remainder, staged
from duoclock.llm.queries import TOKENIZER
from duoclock.shipping import ship

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of so many different trigrams is in no learned language if its best cosine is under three standard deviations of a random text's.
LEAST_TRIGRAMS, LEAST_SCORE = 64, 3 / langid.DIM**0.5
#: A language is well taught by so many different texts of so many characters; with fewer, its own texts can score as low.
LEAST_TEXTS, LEAST_CHARS = 20, 200


def _documents(kept: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with a new text."""
    return kept.select("doc_id", F.col(text).alias("text"), "lang", "source", F.when(F.col(text).isNotNull(), F.length(text)).cast("bigint").alias("n_chars"))


def _well_taught(docs: DataFrame) -> list[str]:
    """Languages whose prototype can tell its own texts from others."""
    long = docs.where(F.col("lang").isNotNull() & (F.length("text") >= LEAST_CHARS))
    counts = long.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    return [r["lang"] for r in counts.where(F.col("n") >= LEAST_TEXTS).collect()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those with enough trigrams to tell that are like no learned language.

    Short texts stay, as the shortest clean ones are like no language. Nothing is told without a well taught
    language, nor of documents labelled with one that is not: if no language could be learned, only the letters count.
    Null and empty texts have no letter and go. Repeated rows are judged each for itself; ties between languages don't
    matter, as only the best score does. A null id teaches nothing and is judged like others.
    """
    docs = docs.select(*DOCUMENTS)
    taught = crc_remainder("doc_id", 4) != 2
    prototypes, good = langid.learn(docs, taught), _well_taught(docs.where(taught))
    poor = [k for k in prototypes if k not in good]
    found = langid.predict(docs, prototypes, grams_col="n_trigrams")
    strange = (F.col("n_trigrams") >= LEAST_TRIGRAMS) & (F.col("score") < LEAST_SCORE) & F.lit(bool(good)) & ~F.coalesce(F.col("lang").cast("string").isin(poor), F.lit(False))
    return found.where((F.col("n_trigrams") > 0) & ~strange).select(*DOCUMENTS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents hold, in all but the document with the largest id.

    Null text becomes an empty one; a null id counts as the smallest. Rows of one id are one document: each keeps or
    loses the line. No row goes.
    """
    return _documents(lines.dedup_lines(docs.select(*DOCUMENTS)), "kept_text")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each id and text, in the order of ids; null without an id."""
    pairs = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tag")).distinct()
    ordered = staged(pairs, "pairs").repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    numbers = staged(ordered.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return docs.withColumn("tag", F.xxhash64("text")).join(numbers, ["doc_id", "tag"], "left")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id.

    Texts that share an id are told apart, by their hashes. Repeated rows, alike in id and text, are one document and
    stay or go together. Null and empty texts and null ids are like nothing and stay.
    """
    docs = docs.select(*DOCUMENTS)
    tags = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    key = "doc_id"
    if not tags.where("lo < hi").isEmpty():
        docs, key = staged(_numbered(docs), "numbered"), "number"
    going = minhash.near_duplicates(docs, id_col=key).where(~F.col("kept")).select(key).distinct()
    return docs.join(going, key, "left_anti").select(*DOCUMENTS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that documents with smaller ids hold too; the others stay as they are.

    Rows that share an id take nothing from each other. Null text and a null id lose nothing. A text that loses all its
    words stays, empty. No row goes.
    """
    found = substring.dedup_substrings(docs.select(*DOCUMENTS))
    return _documents(found.withColumn("left", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), "left")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null text counts as empty; each row, repeated or without an id, is packed for itself."""
    return packing.pack(docs, TOKENIZER)


def _shipped(stage: Callable) -> Callable:
    """The stage, with the package on its workers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", _shipped(identify_language)),
    ("line dedup", _shipped(drop_common_lines)),
    ("MinHash near-dedup", _shipped(drop_near_duplicates)),
    ("substring dedup", _shipped(drop_repeats)),
    ("packing", _shipped(pack)),
]

#: SQL can't express the learned first stage and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
