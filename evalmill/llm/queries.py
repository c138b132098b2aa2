"""One query for each operator, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import bpe, decontam, langid, minhash, pitman_yor, quality, secret_scan, suffix_repeats, toxicity, warc
from evalmill.llm.common import crc_mod, read_table
from evalmill.sources.tables import spread


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", *cols))


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every text and the verdict by divergence from the language references."""
    return quality.assess(_docs(spark, sf_dir, "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "char_distance", "word_distance")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by the byte network, trained on the folds that are not held out."""
    docs = _docs(spark, sf_dir, "lang")
    net = langid.train(docs.filter(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as monolithic gzip archives, rewritten member by member, and read back by the index."""
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 400 bytes that start elsewhere too, removed."""
    found = suffix_repeats.removal(_docs(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by the weighted lexicon, learned on the folds that are not held out."""
    docs = _docs(spark, sf_dir)
    lexicon = toxicity.train(docs, read_table(spark, sf_dir, "labels"), lambda i: crc_mod(i, 5) != 0)
    return toxicity.score(docs, lexicon).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("em_toxicity").alias("score"), (F.col("em_toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text."""
    return bpe.digests(_docs(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text, learned on the folds that are not held out."""
    docs = _docs(spark, sf_dir).withColumn("held_out", crc_mod("doc_id", 7) == 2)
    return pitman_yor.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lexed spans of secrets of every text."""
    return secret_scan.scan(_docs(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every text."""
    return decontam.digests(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_minhash_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are similar by 0.85 or more."""
    return minhash.near_duplicates(_docs(spark, sf_dir), num=85, den=100)


QUERIES = {f.__name__: f for f in (op1_quality_divergence, op2_language_id, op3_warc_members, op4_suffix_repeats, op5_toxicity_lexicon, op6_byte_bpe, op7_pitman_yor, op8_secret_lexing, op9_decontaminate, op10_minhash_circulant)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_warc_members": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_minhash_circulant": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
}
