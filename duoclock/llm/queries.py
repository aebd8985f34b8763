"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import ann, bpe, codes, fim, jaccard, langid, lines, minhash, packing, quality, substring, topk, warc
from .common import crc_remainder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha256("kept_text").alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = crc_remainder("doc_id", 4) == 2
    prototypes = langid.learn(docs, ~held)
    marked = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return langid.predict(marked, prototypes).drop("text")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_products(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    held = crc_remainder("doc_id", 5) == 0
    model = quality.learn(docs, labels, ~held)
    scored = quality.score(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), k=2)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = codes.train(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    entries = ",".join(str(x) for part in codec.book for entry in part for x in entry)
    out = codes.with_group_error(codec.encoded(), "label")
    return out.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(entries).cast("binary"), 256).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.fill_in_middle(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256("fim_text").alias("output_sha256"), _sha256("restored_text").alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_line_dedup, op3_language_id, op4_topk, op5_quality, op6_substring_dedup, op7_packing, op8_ann, op9_bpe, op10_minhash,
        op11_jaccard, op12_codes, op13_fill_in_middle,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_P, _K = codes.PARTS, codes.ENTRIES


def _assigned(r: int) -> str:
    """Every part's distance to its nearest entry and the entry's number, as distance * entries + number."""
    return f"""a{r} AS MATERIALIZED (
  SELECT row, p, any_value(e) AS e, min(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {_K} + i) AS m FROM parts JOIN b{r} USING (p) GROUP BY row, p)"""


def _moved(r: int) -> str:
    """The entries after a round."""
    return f"""s{r} AS (SELECT p, m % {_K} AS i, u.place, sum(u.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, m, unnest(list_transform(e, lambda x, place: {{'place': place, 'x': x}})) AS u FROM a{r}) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(f, c) AS c FROM b{r} LEFT JOIN (SELECT p, i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS f FROM s{r} GROUP BY ALL) USING (p, i))"""


ORACLES = {
    "op11_jaccard": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.WORDS} THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - {jaccard.WORDS - 2}), lambda i: array_to_string(w[i : i + {jaccard.WORDS - 1}], ' ')) END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
    FROM sized x JOIN sized y ON x.s = y.s AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= {jaccard.PER_CENT} * greatest(x.n, y.n)
    GROUP BY 1, 2) WHERE 100 * c >= {jaccard.PER_CENT} * (n + m - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op12_codes": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p, e[p * (len(e) // {_P}) + 1 : (p + 1) * (len(e) // {_P})] AS e FROM v CROSS JOIN range(0, {_P}) g(p)
), b0 AS (SELECT p, row - 1 AS i, e AS c FROM parts WHERE row <= {_K}),
{", ".join(f"{_assigned(r)}, {_moved(r)}" for r in range(codes.ROUNDS))}, {_assigned(codes.ROUNDS)},
coded AS (SELECT row, string_agg(printf('%02x', (m % {_K})::INTEGER), '' ORDER BY p) AS code, sum(m // {_K})::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM b{codes.ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (row) CROSS JOIN book""",
    "op13_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || doc_id) AS h FROM documents
), tokens AS (
  SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i : i + 7])::BIGINT) AS k FROM d
), cuts AS (
  SELECT *, len(u) AS n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= {fim.RATE} THEN 'plain' WHEN k[4] % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM tokens
), pieces AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS suf FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces""",
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
           ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
    FROM sized x JOIN sized y ON x.s = y.s AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY 1, 2) WHERE 100 * c >= 80 * (n + m - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op6_substring_dedup": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS lo FROM windows GROUP BY h
), hits AS (
  SELECT doc_id, p FROM windows JOIN firsts USING (h) WHERE doc_id > lo
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hits
), lost AS (
  SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(coalesce(i, [])) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, n: NOT list_contains(coalesce(i, []), n)), ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 20""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
}
