"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  The first three filter, the fourth rewrites texts, the last
encodes what is left.  Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import bpe, decontam, minhash, secret_scan, toxicity
from evalmill.llm.common import crc_mod, read_table, scratch
from evalmill.sources.tables import spread


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned on the folds that aren't held out, scores below 0.5.

    Null and empty texts have no hits and stay; equal rows are judged alike.
    """
    lexicon = toxicity.train(docs, read_table(spark, sf_dir, "labels"), lambda i: crc_mod(i, 5) != 0)
    return toxicity.score(docs, lexicon).filter("em_toxicity < 0.5").drop("em_toxicity")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles, that of the least id.

    A document without words is its own group.  Rows are documents: those with a
    null id come after all others, and of rows that repeat an id in one group one
    stays; in different groups each stays.
    """
    return minhash.distinct_documents(docs, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null texts have none and stay, equal rows are judged alike."""
    return decontam.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mask; n_chars, where there is one, follows the text.  Null texts stay null."""
    out, new = secret_scan.redact(docs, out_col="em_redacted"), {"text": F.col("em_redacted")}
    if "n_chars" in docs.columns:
        changed = ~F.col("em_redacted").eqNullSafe(F.col("text"))
        new["n_chars"] = F.when(changed, F.length("em_redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded bytes of every document that is left; a null text is an empty one."""
    return bpe.digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity_filter), ("near duplicates", near_duplicate_filter), ("decontamination", decontaminate), ("secrets", redact_secrets), ("byte BPE", encode)]

#: Learned and probabilistic stages have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, f"stage-{name.replace(' ', '-')}")
    return docs
