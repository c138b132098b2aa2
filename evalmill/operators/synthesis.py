"""Retrieval-augmented training rows: chunks, distractors, instructions, output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.text import final_answer, fixed_chunks, without_last_line


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, chunk)."""
    return docs.select("doc_id", F.posexplode(fixed_chunks(F.col("text"), size)).alias("pos", "chunk"))


def hash_bucket(c, seed: str, buckets: int):
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def first_by_hash(drawn: DataFrame, k: int, seed: str) -> DataFrame:
    """(qid, pos, cid): the ``k`` passages of each question with the least hash."""
    key = F.md5(F.concat(F.lit(seed), F.col("qid").cast("string"), F.lit("/"), F.col("cid").cast("string")))
    got = drawn.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct(key.alias("key"), "cid"))), 1, k).alias("m"))
    return got.select("qid", F.posexplode("m").alias("pos", "m")).select("qid", "pos", F.col("m.cid").alias("cid"))


def distractors(questions: DataFrame, pool: DataFrame, k: int, seed: str) -> DataFrame:
    """(qid, pos, cid) of k passages for each question, sampled by hash, its own (oracle) left out; fewer only if the pool holds fewer.

    A question draws from the pool's bucket that its hash names and the ones
    after, twice as many each time until they hold k, so that only in a small
    pool it meets all.  A bucket holds a few times k.  Hashes depend on ids and
    seed only, not on partitions.
    """
    from evalmill.sources.tables import stored

    buckets = max(1, pool.count() // (4 * (k + 1)))
    dealt = stored(pool.select("cid", hash_bucket(F.col("cid"), seed, buckets).alias("bucket")), "pool")
    open_, found, span = stored(questions.select("qid", "oracle"), "questions"), [], 1
    while True:
        q = open_.select("qid", "oracle", F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(span, buckets) - 1)), lambda i: F.pmod(hash_bucket(F.col("qid"), seed, buckets) + i, F.lit(buckets)))).alias("bucket"))
        got = stored(first_by_hash(q.join(dealt, "bucket").filter(~F.col("cid").eqNullSafe(F.col("oracle"))), k, seed), "distractors")
        full = got.groupBy("qid").count().filter((F.col("count") >= k) | F.lit(span >= buckets)).select("qid")
        found.append(got.join(full, "qid", "left_semi"))
        if span >= buckets:
            break
        open_, span = stored(open_.join(full, "qid", "left_anti"), "questions"), 2 * span
        if open_.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def contexts(questions: DataFrame, pool: DataFrame, k: int, seed: str, p: float = 0.8) -> DataFrame:
    """(qid, passages): the oracle's passage with probability ``p``, else one more drawn in its place, and k distractors, shuffled.

    Draw and order are by hash of ids and seed.  The replacement is none of the
    distractors.  A question whose oracle isn't in the pool gets the replacement.
    """
    drawn = distractors(questions, pool.select("cid"), k + 1, seed)
    part = lambda what, *more: F.md5(F.concat_ws("/", F.lit(f"{seed}{what}"), F.col("qid").cast("string"), *more))
    u = F.conv(F.substring(part("p"), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    own = questions.filter(u < p).join(pool.select(F.col("cid").alias("oracle")).distinct(), "oracle", "left_semi").select("qid", F.lit(k).alias("pos"), F.col("oracle").alias("cid"))
    rest = drawn.filter(F.col("pos") < k).union(drawn.filter(F.col("pos") == k).join(own.select("qid"), "qid", "left_anti"))
    chosen = rest.union(own).join(pool.dropDuplicates(["cid"]), "cid")
    return chosen.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(part("o", F.col("cid").cast("string")).alias("key"), "cid", "passage"))), lambda x: x["passage"]).alias("passages"))


def instruction(passages, question):
    """Passages in tags, a line each, then the question."""
    return F.concat(F.array_join(F.transform(passages, lambda d: F.concat(F.lit("<DOCUMENT>"), d, F.lit("</DOCUMENT>\n"))), ""), question)


def completion(rows: DataFrame) -> DataFrame:
    """prompt and completion of rows with both parts."""
    return rows.filter((F.length("instruction") > 0) & (F.length("cot_answer") > 0)).select("id", F.col("instruction").alias("prompt"), F.col("cot_answer").alias("completion"))


def chat(rows: DataFrame, system: str | None = None) -> DataFrame:
    """messages of system (if any), user and assistant."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = ([message("system", F.lit(system))] if system else []) + [message("user", F.col("instruction")), message("assistant", F.col("cot_answer"))]
    return rows.select("id", F.array(*parts).alias("messages"))


def evaluation(rows: DataFrame) -> DataFrame:
    """question, gold_final_answer and context."""
    return rows.select("id", "question", final_answer(F.col("cot_answer")).alias("gold_final_answer"), without_last_line(F.col("instruction")).alias("context"))
