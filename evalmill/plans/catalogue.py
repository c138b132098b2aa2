"""Registered queries over the driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.functions import calls as C
from evalmill.functions import schemas, source_calls
from evalmill.functions import text as X
from evalmill.functions.checking import check_calls
from evalmill.operators import actions, battles, conversation, relational, retrieval, scoring, services, similarity, synthesis
from evalmill.functions import pages as P
from evalmill.plans.registry import ORACLE, QUERIES, query
from evalmill.sources.tables import shared_folder, spread, stored, table
from evalmill.streaming import rates

#: Weights of the categories in the overall score.
WEIGHTS = {"en": 40, "de": 30, "fr": 20, "es": 10}


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Validity of rows: a source stands for a model, a language for a category."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), F.col("lang").alias("category"), "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("valid")), "doc_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.category_accuracy(_results(spark, d), "model", "category")


def _members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "category string, weight int")


_SCORES = """r AS (SELECT source AS model, lang AS category, quality AS valid FROM documents JOIN labels USING (doc_id)),
s AS (SELECT model, category, avg(valid) AS accuracy, count(*) AS n FROM r GROUP BY 1, 2)"""
_FULL = _SCORES + """,
m AS (SELECT * FROM (VALUES ('en', 40), ('de', 30), ('fr', 20), ('es', 10)) t(category, weight)),
f AS (SELECT k.model, m.category, m.weight, coalesce(s.accuracy, 0) AS accuracy, coalesce(s.n, 0) AS n, s.n IS NULL AS missing
      FROM (SELECT DISTINCT model FROM s) k CROSS JOIN m LEFT JOIN s ON s.model = k.model AND s.category = m.category)"""


@query(f"""WITH {_FULL},
o AS (SELECT model, sum(accuracy * weight) / sum(weight) AS overall, avg(accuracy) AS mean_accuracy, CAST(sum(n) AS BIGINT) AS total_count, bool_or(missing) AS x FROM f GROUP BY 1)
SELECT model, round(overall, 6) AS overall, round(mean_accuracy, 6) AS mean_accuracy, total_count, CASE WHEN NOT x THEN round(overall, 6) END AS shown,
       row_number() OVER (ORDER BY round(overall, 6) DESC, model) AS rank FROM o""")
def category_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Ranked models by weighted and plain means over fixed categories."""
    full = scoring.with_members(_scores(spark, d), _members(spark), "model", "category")
    o = full.groupBy("model").agg(F.round(F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight"), 6).alias("overall"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), F.sum("total_count").alias("total_count"), F.max("missing").alias("x"))
    return scoring.ranked(o.withColumn("shown", F.when(~F.col("x"), F.col("overall"))).drop("x"), "overall", "model")


@query(f"WITH {_SCORES} SELECT model, round(sum(accuracy * n) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS total_count FROM s GROUP BY 1")
def weighted_accuracy(spark, d):
    return scoring.weighted(_scores(spark, d), "model").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_FULL} SELECT model, round(avg(accuracy), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS total_count, CASE WHEN NOT bool_or(missing) THEN round(avg(accuracy), 6) END AS display_accuracy FROM f GROUP BY 1")
def unweighted_accuracy(spark, d):
    full = scoring.with_members(_scores(spark, d), _members(spark), "model", "category")
    return scoring.unweighted(full, "model").withColumns({c: F.round(c, 6) for c in ("accuracy", "display_accuracy")}).drop("any_missing")


@query(f"WITH {_FULL} SELECT model, round(sum(accuracy * weight) / sum(weight), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS total_count FROM f GROUP BY 1")
def percentage_weighted_accuracy(spark, d):
    full = scoring.with_members(_scores(spark, d), _members(spark), "model", "category")
    return scoring.percentage_weighted(full, "model").withColumn("accuracy", F.round("accuracy", 6))


@query("WITH a AS (SELECT source, avg(quality) AS v FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT source, round(v, 6) AS v, row_number() OVER (ORDER BY round(v, 6) DESC NULLS LAST, source) AS rank FROM a")
def rank_nulls_last(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return scoring.ranked(j.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("v")), "v", "source")


@query(f"WITH {_SCORES} SELECT category, count(*) AS n_configs, CASE WHEN count(*) <= 1 THEN 0 ELSE round(var_samp(accuracy) * 10000, 6) END AS variance, CASE WHEN count(*) <= 1 THEN 0 ELSE round(stddev_samp(accuracy) * 100, 6) END AS deviation, CASE WHEN count(*) <= 1 THEN 0 ELSE round((max(accuracy) - min(accuracy)) * 100, 6) END AS max_delta FROM s GROUP BY 1")
def config_sensitivity(spark, d):
    return scoring.config_sensitivity(_results(spark, d), "category", "model").withColumns({c: F.round(c, 6) for c in ("variance", "deviation", "max_delta")})


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value <> 0 GROUP BY 1")
def latency_stats(spark, d):
    return scoring.latency_stats(table(spark, d, "events"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "p95")})


@query("SELECT l_suppkey % 10 AS model, round(sum(l_quantity) * 3.0 / 1e6 + sum(l_extendedprice) * 15.0 / 1e6, 4) AS cost, round(sum(l_quantity) / 3600 * 23.92 / 100, 4) AS gpu FROM lineitem GROUP BY 1")
def token_cost(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("model")).agg(F.sum("l_quantity").alias("i"), F.sum("l_extendedprice").alias("o"))
    return g.select("model", F.round(scoring.token_cost(F.col("i"), F.col("o"), F.lit(3.0), F.lit(15.0)), 4).alias("cost"), F.round(scoring.gpu_cost(F.col("i")), 4).alias("gpu"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, -1 AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_union(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("v"))
    return relational.upsert(old, table(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id")


@query("SELECT item_id, c.config, item_id * 26 + c.config AS pos FROM benchmark CROSS JOIN (SELECT unnest(range(26)) AS config) c")
def config_grid_cross_join(spark, d):
    grid = spark.range(26).select(F.col("id").alias("config"))  # 4 x 2 x 3 configurations and 2 more
    return table(spark, d, "benchmark").select("item_id").crossJoin(F.broadcast(grid)).withColumn("pos", F.col("item_id") * 26 + F.col("config"))


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS position FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders) SELECT position, c_custkey, o_orderkey FROM a JOIN b USING (position)")
def positional_join(spark, d):
    left = table(spark, d, "customer").select("c_custkey", "c_name")
    return relational.positional_join(left, table(spark, d, "orders").select("o_orderkey"), ["c_name", "c_custkey"], ["o_orderkey"]).select("position", "c_custkey", "o_orderkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def ordered_pair_theta_join(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.n_nationkey") != F.col("b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""WITH h AS (SELECT l_suppkey AS k, l_returnflag AS i, count(*) AS c FROM lineitem GROUP BY 1, 2),
n AS (SELECT s_suppkey AS k, 'R' AS i, count(*) * 140 AS c FROM supplier GROUP BY 1)
SELECT n.k, min(CAST(coalesce(h.c, 0) >= n.c AS INT)) = 1 AS contained FROM n LEFT JOIN h ON h.k = n.k AND h.i = n.i GROUP BY 1""")
def multiset_containment(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("i"))
    need = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array_repeat(F.lit("R"), 140)).alias("i"))
    return relational.multiset_contains(have, need, "k", "i")


@query("SELECT doc_id, list_has_any(string_split(lower(text), ' '), ['the', 'der', 'que']) AS hit FROM documents")
def array_overlap_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.arrays_overlap(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "der", "que")))).alias("hit"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


_BATTLES = """battles AS (SELECT event_id AS ord, 'agent' || (user_id % 12) AS a, 'agent' || ((user_id % 12 + 1 + event_id % 11) % 12) AS b, event_type AS category,
CASE event_id % 7 WHEN 0 THEN 'Tie' WHEN 1 THEN 'Both are bad' WHEN 2 THEN 'B is better' WHEN 3 THEN 'B is better' ELSE 'A is better' END AS rating FROM events)"""


def _battles(spark, d):
    e = table(spark, d, "events")
    name = lambda c: F.concat(F.lit("agent"), c.cast("string"))
    m = F.col("event_id") % 7
    return e.select(F.col("event_id").alias("ord"), name(F.col("user_id") % 12).alias("a"), name((F.col("user_id") % 12 + 1 + F.col("event_id") % 11) % 12).alias("b"), F.col("event_type").alias("category"), F.when(m == 0, "Tie").when(m == 1, "Both are bad").when(m.isin(2, 3), "B is better").otherwise("A is better").alias("rating"))


@query(f"WITH {_BATTLES} SELECT a, b, count(*) AS n FROM (SELECT a, b FROM battles UNION ALL SELECT b, a FROM battles) GROUP BY 1, 2")
def symmetric_pair_counts(spark, d):
    return relational.symmetric_counts(_battles(spark, d), "a", "b")


@query(f"WITH {_BATTLES} SELECT name, count(*) AS n FROM (SELECT a AS name FROM battles UNION ALL SELECT b FROM battles) GROUP BY 1")
def battle_counts(spark, d):
    return battles.counts(_battles(spark, d))


@query(f"""WITH {_BATTLES} SELECT a, b, CAST(sum(p) AS BIGINT) AS points FROM (
SELECT a, b, CASE WHEN rating = 'A is better' THEN 2 WHEN rating = 'B is better' THEN 0 ELSE 1 END AS p FROM battles UNION ALL
SELECT b, a, CASE WHEN rating = 'B is better' THEN 2 WHEN rating = 'A is better' THEN 0 ELSE 1 END FROM battles) GROUP BY 1, 2""")
def win_matrix(spark, d):
    return battles.win_matrix(_battles(spark, d))


_ELO = """WITH RECURSIVE o AS (SELECT event_type AS category, row_number() OVER (PARTITION BY event_type ORDER BY event_id ORDERING) AS n, user_id % 12 AS a, (user_id % 12 + 1 + event_id % 11) % 12 AS b,
  CASE event_id % 7 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0::DOUBLE WHEN 3 THEN 0::DOUBLE ELSE 1::DOUBLE END AS s FROM events),
f(category, n, r, seen) AS (SELECT DISTINCT category, 0::BIGINT, list_transform(range(12), lambda i: 1000::DOUBLE), list_transform(range(12), lambda i: false) FROM o
  UNION ALL SELECT o.category, o.n, list_transform(range(1, 13), lambda i: CASE WHEN i = a + 1 THEN r[i] + 4 * (s - 1 / (1 + 10 ** ((r[b + 1] - r[a + 1]) / 400))) WHEN i = b + 1 THEN r[i] - 4 * (s - 1 / (1 + 10 ** ((r[b + 1] - r[a + 1]) / 400))) ELSE r[i] END),
  list_transform(range(1, 13), lambda i: seen[i] OR i = a + 1 OR i = b + 1) FROM f JOIN o ON o.category = f.category AND o.n = f.n + 1),
l AS (SELECT category, arg_max(r, n) AS r, arg_max(seen, n) AS seen FROM f GROUP BY 1)
SELECT category, 'agent' || i AS name, round(r[i + 1], 6) AS rating FROM (SELECT category, r, seen, unnest(range(12)) AS i FROM l) WHERE seen[i + 1]"""


@query(_ELO.replace("ORDERING", ""))
def online_elo(spark, d):
    return battles.online_elo(_battles(spark, d), "category").withColumn("rating", F.round("rating", 6))


@query(_ELO.replace("ORDERING", "DESC"))
def online_elo_reverse(spark, d):
    return battles.online_elo(_battles(spark, d), "category", reverse=True).withColumn("rating", F.round("rating", 6))


@query()
def bradley_terry(spark, d):
    return battles.bradley_terry(battles.win_matrix(_battles(spark, d)))


@query(f"WITH {_BATTLES} SELECT rating, count(*) AS n FROM battles WHERE NOT contains(rating, 'Tie') GROUP BY 1")
def no_tie_value_counts(spark, d):
    return _battles(spark, d).filter(~F.col("rating").contains("Tie")).groupBy("rating").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, d):
    return relational.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("SELECT doc_id, md5(replace(lower(regexp_replace(text, '[ ,./\\-_*^]', '', 'g')), '''', '\"')) AS call_md5, md5(replace(lower(regexp_replace(text, '[,./\\-_*^()]', '', 'g')), '''', '\"')) AS answer_md5 FROM documents")
def standardize_string(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.standardize_call_string(t)).alias("call_md5"), F.md5(X.standardize_answer(t)).alias("answer_md5"))


@query(r"SELECT doc_id, regexp_matches(lower(regexp_replace(text, '[,./\-_*^()]', '', 'g')), '\bthe\b') AS found FROM documents WHERE lang = 'en'")
def agentic_contains(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'")
    return docs.select("doc_id", X.contains_answer(F.col("text"), F.lit("The")).alias("found"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))) AS n_lines FROM documents")
def grep_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.grep(F.col("text"), "the")).cast("long").alias("n_lines"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def word_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.split(t, "\n")).cast("long").alias("n_lines"), F.size(F.filter(F.split(t, r"[ \n\t\r]+"), lambda x: x != "")).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"))


@query("SELECT doc_id, i AS pos, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, d):
    return synthesis.chunks(table(spark, d, "documents"), 500).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT conv_id, turn, string_split('x<ANSWER>: ' || text, '<ANSWER>: ')[-1] AS answer FROM conversations")
def answer_extract(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.final_answer(F.concat(F.lit("x<ANSWER>: "), F.col("text"))).alias("answer"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("SELECT page_id, repeat('.', greatest(length(url) - 4, 0)) || right(url, 4) AS masked FROM pages")
def secret_mask(spark, d):
    return table(spark, d, "pages").select("page_id", X.secret_mask(F.col("url")).alias("masked"))


@query("SELECT page_id, CASE WHEN strlen(html) >= 1048576 THEN format('{:.2f} MB', strlen(html) / 1048576.0::DOUBLE) WHEN strlen(html) >= 1024 THEN format('{:.2f} KB', strlen(html) / 1024.0::DOUBLE) ELSE format('{:.2f} B', strlen(html)::DOUBLE) END AS size FROM pages")
def human_size(spark, d):
    return table(spark, d, "pages").select("page_id", X.human_size(F.octet_length("html")).alias("size"))


@query("SELECT doc_id, md5(array_to_string(list_sort(string_split(text, chr(10))), chr(10))) AS sorted_md5 FROM documents")
def line_sort(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.sorted_lines(F.col("text"))).alias("sorted_md5"))


@query("SELECT doc_id, regexp_replace(replace(string_split(source || '_prereq_' || doc_id || ':cfg', ':')[1], '_prereq', ''), '_[^_]*$', '') AS category FROM documents")
def category_from_id(spark, d):
    row_id = F.concat("source", F.lit("_prereq_"), F.col("doc_id").cast("string"), F.lit(":cfg"))
    return table(spark, d, "documents").select("doc_id", X.category_of(row_id).alias("category"))


_BM25 = """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM d),
tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
t AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(string_split(text, ' ')) AS term FROM benchmark) GROUP BY 1, 2),"""


@query(_BM25 + """raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, t), fl AS (SELECT avg(raw) * 0.25 AS fl FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN fl ELSE raw END AS idf FROM raw, fl),
s AS (SELECT item_id AS query, doc_id AS doc, round(sum(qf * idf * f * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + f)), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), t GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return retrieval.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "item_id", lambda c: F.split(c, " "))


@query(_BM25 + """idf AS (SELECT term, ln((n + 1) / df::DOUBLE) AS idf FROM df, t),
s AS (SELECT item_id AS query, doc_id AS doc, round(sum(qf * idf * (f * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + f) + 1)), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), t GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def bm25plus_topk(spark, d):
    return retrieval.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "item_id", lambda c: F.split(c, " "), plus=True)


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_top_k(e, e.filter("vec_id % 100 = 0"), "vec_id")


@query("""WITH g AS (SELECT array_to_string(w[k:k + 2], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 1)) AS k FROM (SELECT string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 3)) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ngram_counts(spark, d):
    return table(spark, d, "benchmark").select(F.explode(X.ngrams(F.split("text", " "), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def _pairs(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("ref"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("hyp")).join(b, "id")


_CLIP = """p AS (SELECT item_id AS id, string_split(b.text, ' ') AS r, string_split(d.text, ' ') AS h FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
o AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, n, array_to_string(h[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, n, h, unnest(range(1, len(h) - n + 2)) AS k FROM p, o WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT id, n, array_to_string(r[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, n, r, unnest(range(1, len(r) - n + 2)) AS k FROM p, o WHERE len(r) >= n) GROUP BY ALL),
c AS (SELECT hg.id, hg.n, CAST(sum(least(hg.c, coalesce(rg.c, 0))) AS BIGINT) AS hits, CAST(sum(hg.c) AS BIGINT) AS total FROM hg LEFT JOIN rg USING (id, n, g) GROUP BY 1, 2)"""


@query(f"WITH {_CLIP} SELECT id, hits, total FROM c WHERE n = 1")
def modified_precision(spark, d):
    return similarity.clipped(_pairs(spark, d), "id", 1)


@query(f"""WITH {_CLIP}, t AS (SELECT n, sum(hits) AS h, greatest(sum(total), 1) AS t FROM c GROUP BY 1), l AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM p)
SELECT round(CASE WHEN hl > rl THEN 1 ELSE exp(1 - rl / hl) END * exp((SELECT sum(ln(CASE WHEN h = 0 THEN 0.1::DOUBLE ELSE h END / t)) / 4 FROM t)), 8) AS bleu FROM l""")
def corpus_bleu(spark, d):
    return similarity.corpus_bleu(_pairs(spark, d), "id").select(F.round("bleu", 8).alias("bleu"))


@query("""WITH x AS (SELECT *, CASE WHEN role = 'user' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM x)
SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM y GROUP BY conv_id, run""")
def merge_consecutive_turns(spark, d):
    return conversation.merge_runs(table(spark, d, "conversations"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), 'none') AS text FROM conversations GROUP BY 1")
def last_user_message(spark, d):
    return conversation.last_of(table(spark, d, "conversations"), "user", "none")


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1")
def first_system_message(spark, d):
    return conversation.first_of(table(spark, d, "conversations"), "system")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def prompt_fold(spark, d):
    return conversation.folded(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, count(*) OVER w AS n_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def cumulative_turns(spark, d):
    return conversation.cumulative(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, text, reply FROM (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND who = 'assistant'")
def reply_pairs(spark, d):
    return conversation.reply_pairs(table(spark, d, "conversations"))


def _synth(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("oracle"), F.col("text").alias("question"))
    pool = table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("passage"))
    return q, pool


def _drawn(k: int, seed: str = "s") -> str:
    """CTEs up to ``drawn`` (qid, pos, cid): k passages of the least hash in the first run of 1, 2, 4 ... buckets that holds as many."""
    return f"""pool AS (SELECT doc_id AS cid, ('0x' || substring(md5('{seed}' || doc_id), 1, 8))::BIGINT AS h FROM documents),
size AS (SELECT greatest(1, count(*) // {4 * (k + 1)}) AS n FROM pool),
q AS (SELECT item_id AS qid, ('0x' || substring(md5('{seed}' || item_id), 1, 8))::BIGINT % n AS b, n FROM benchmark, size),
near AS (SELECT qid, cid, n, (h % n - b + n) % n AS far FROM q, pool WHERE cid <> qid),
runs AS (SELECT qid, s, n, count(*) FILTER (far < s) AS c FROM near, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072]) AS s) GROUP BY ALL),
span AS (SELECT qid, min(s) AS s FROM runs WHERE c >= {k} OR s >= n GROUP BY 1),
drawn AS (SELECT qid, pos, cid FROM (SELECT near.qid, cid, row_number() OVER (PARTITION BY near.qid ORDER BY md5('{seed}' || near.qid || '/' || cid)) - 1 AS pos FROM near JOIN span USING (qid) WHERE far < s) WHERE pos < {k})"""


@query(f"WITH {_drawn(4)} SELECT qid, pos, cid FROM drawn")
def distractor_sample(spark, d):
    q, pool = _synth(spark, d)
    return synthesis.distractors(q.select("qid", "oracle"), pool.select("cid"), 4, "s").withColumn("pos", F.col("pos").cast("long"))


def _rows(spark, d):
    q, pool = _synth(spark, d)
    got = synthesis.contexts(q.select("qid", "oracle"), pool, 2, "s")
    return q.join(got, "qid", "left").select(F.col("qid").alias("id"), "question", synthesis.instruction(F.coalesce("passages", F.array().cast("array<string>")), F.col("question")).alias("instruction"), F.concat(F.lit("##Reason <ANSWER>: "), F.col("question")).alias("cot_answer"))


_ROWS = _drawn(3) + """,
own AS (SELECT item_id AS qid, 2 AS pos, item_id AS cid FROM benchmark WHERE ('0x' || substring(md5('sp/' || item_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 AND item_id IN (SELECT doc_id FROM documents)),
chosen AS (SELECT qid, cid FROM drawn WHERE pos < 2 OR qid NOT IN (SELECT qid FROM own) UNION ALL SELECT qid, cid FROM own),
found AS (SELECT qid, string_agg('<DOCUMENT>' || text || '</DOCUMENT>' || chr(10), '' ORDER BY md5('so/' || qid || '/' || cid), cid) AS passages FROM chosen JOIN documents ON doc_id = cid GROUP BY 1),
made AS (SELECT item_id AS id, text AS question, coalesce(passages, '') || text AS instruction, '##Reason <ANSWER>: ' || text AS cot_answer FROM benchmark LEFT JOIN found ON qid = item_id)"""


@query(f"WITH {_ROWS} SELECT id, instruction AS prompt, cot_answer AS completion FROM made WHERE length(instruction) > 0 AND length(cot_answer) > 0")
def synthesis_completion(spark, d):
    return synthesis.completion(_rows(spark, d))


@query(f"WITH {_ROWS} SELECT id, 'system,user,assistant' AS roles, 'You answer from the documents.' AS system, instruction AS asked, cot_answer AS answered FROM made")
def synthesis_chat(spark, d):
    said = lambda i: F.get("messages", i)["content"]
    return synthesis.chat(_rows(spark, d), "You answer from the documents.").select("id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), said(0).alias("system"), said(1).alias("asked"), said(2).alias("answered"))


@query(f"WITH {_ROWS} SELECT id, question, string_split(cot_answer, '<ANSWER>: ')[-1] AS gold_final_answer, regexp_replace(instruction, '\\n?[^\\n]*$', '') AS context FROM made")
def synthesis_eval(spark, d):
    return synthesis.evaluation(_rows(spark, d))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 901 AND 950")
def price_range_filter(spark, d):
    return table(spark, d, "part").filter(F.col("p_retailprice").between(901, 950)).select("p_partkey", "p_retailprice")


@query("SELECT event_id, user_id FROM events WHERE lower(event_type) = 'error' AND abs(value) >= 5")
def threshold_filter(spark, d):
    return table(spark, d, "events").filter((F.lower("event_type") == "error") & (F.abs("value") >= 5)).select("event_id", "user_id")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def action_history_last10(spark, d):
    return actions.history(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


_RATE = "SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(1 - count(*) FILTER (event_type = 'error') / count(*), 6) AS success_rate FROM events GROUP BY 1"


@query(_RATE)
def success_rate_30m(spark, d):
    return rates.success_rate(table(spark, d, "events"))


@query(_RATE)
def stream_success_rate_30m(spark, d):
    """The same as a stream: all files that are there, windows closed by the end of input."""
    name = f"{shared_folder(spark)}/evalmill/stream-{uuid.uuid4().hex}"
    events = rates.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rates.newest_windows(rates.success_rate(events), name).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


#: Scripts, styles, comments and tags part the texts; the references that the pages hold are named.
@query(r"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)\b[^>]*>.*?</(script|style)>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g'), '</?[A-Za-z!][^>]*>', chr(1), 'g') AS t FROM pages),
p AS (SELECT page_id, list_transform(string_split(t, chr(1)), lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')) AS p FROM m)
SELECT page_id, array_to_string(list_filter(p, lambda x: x <> ''), chr(10)) AS text FROM p""")
def html_to_text(spark, d):
    """Text of pages without scripts and styles, a node a line."""
    return P.converted(table(spark, d, "pages").select("page_id", "html"), "html", "truncate")


@query("""SELECT c_custkey, c_acctbal > 0 AS valid, CASE WHEN c_acctbal > 0 THEN NULL ELSE 'value_error:others' END AS error_type,
'[{"lookup": {"name": "' || c_name || '", "nation": ' || c_nationkey || ', "vip": ' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || '}}]' AS decoded FROM customer""")
def decode_and_check_calls(spark, d):
    """Calls written from customers, decoded and checked against their truth."""
    made = table(spark, d, "customer").select("c_custkey", F.format_string("[lookup(name='%s', nation=%d, vip=%s)]", "c_name", "c_nationkey", F.when(F.col("c_acctbal") > 0, "True").otherwise("False")).alias("output"), "c_name", "c_nationkey")

    def run(frames):
        doc = {"name": "lookup", "parameters": {"properties": {"name": {"type": "string"}, "nation": {"type": "integer"}, "vip": {"type": "boolean"}}, "required": ["name", "nation"]}}
        for pdf in frames:
            rows = []
            for k, out, name, nation in zip(pdf["c_custkey"], pdf["output"], pdf["c_name"], pdf["c_nationkey"], strict=True):
                calls = C.parse_python(out)
                ok, error = check_calls([doc], calls, [{"lookup": {"name": [name.lower()], "nation": [int(nation)], "vip": [True, ""]}}], "simple")
                rows.append((k, ok, error, C.canon(calls)))
            yield pd.DataFrame(rows, columns=["c_custkey", "valid", "error_type", "decoded"])

    return made.mapInPandas(run, "c_custkey long, valid boolean, error_type string, decoded string")


#: One call in each style; %1$s is a name, %2$d a number.
STYLES = {
    "python": "[lookup(name='%1$s', nation=%2$d)]", "json": '[{"name": "lookup", "arguments": {"name": "%1$s", "nation": %2$d}}]', "tagged": '<tool_call>{"name": "lookup", "arguments": {"name": "%1$s", "nation": %2$d}}</tool_call>',
    "two_lines": 'lookup\n{"name": "%1$s", "nation": %2$d}', "xml": '<functions><function name="lookup"><params><param name="name" value="%1$s" type="string"/><param name="nation" value="%2$d" type="integer"/></params></function></functions>',
    "java": 'lookup(name="%1$s", nation=%2$d)', "javascript": "lookup(name='%1$s', nation=%2$d);", "tail": '<|tool_call|>[{"name": "lookup", "arguments": {"name": "%1$s", "nation": %2$d}}]', "upper_tag": "<TOOLCALL>[lookup(name='%1$s', nation=%2$d)]</TOOLCALL>",
    "python_tag": '<|python_tag|>{"name": "lookup", "parameters": {"name": "%1$s", "nation": %2$d}}', "function_split": "<<function>>lookup(name='%1$s', nation=%2$d)", "braces": "<start_function_call>call:lookup{name:<escape>%1$s<escape>,nation:%2$d}<end_function_call>", "unknown": "%1$s %2$d",
}
_LOOKUP = [{"name": "lookup", "description": "Looks up.", "parameters": {"type": "dict", "properties": {"name": {"type": "String", "description": "Name."}, "nation": {"type": "integer", "description": "Nation."}}, "required": ["name"]}}]


@query(f"""SELECT c_custkey, style, CASE WHEN style <> 'unknown' THEN '[{{"lookup": {{"name": "' || c_name || '", "nation": ' || c_nationkey || '}}}}]' END AS decoded,
CASE WHEN style = 'unknown' THEN 'ast_decoder:decoder_failed' END AS error_type FROM customer, (VALUES {", ".join(f"('{s}')" for s in STYLES)}) v(style)""")
def decode_styles(spark, d):
    """A call of each customer written in every style and decoded again."""
    texts = F.array(*[F.struct(F.lit(s).alias("style"), F.format_string(t, "c_name", "c_nationkey").alias("text")) for s, t in STYLES.items()])
    made = table(spark, d, "customer").select("c_custkey", F.explode(texts).alias("x")).select("c_custkey", "x.style", "x.text")

    def run(frames):
        for pdf in frames:
            rows = []
            for key, style, text in pdf.itertuples(index=False, name=None):
                calls, error = source_calls.decode(style, text)
                if calls and style in ("java", "javascript"):
                    calls = source_calls.typed_source(calls, _LOOKUP, style)
                rows.append((key, style, C.canon(calls) if calls is not None else None, error))
            yield pd.DataFrame(rows, columns=["c_custkey", "style", "decoded", "error_type"])

    return made.mapInPandas(run, "c_custkey long, style string, decoded string, error_type string")


@query("""SELECT p_partkey, '<function name="part.' || p_partkey || '">' || chr(10) || '  <desc>' || p_name || '</desc>' || chr(10) || '  <params>' || chr(10) || '    ' || '    <param name="size" type="integer" required="true">' || chr(10) || '          <desc>' || p_brand || '</desc>' || chr(10) || '        </param>' || chr(10) || '  </params>' || chr(10) || '</function>' || chr(10) AS xml,
'part_' || p_partkey AS tool_name, CAST(0 AS BIGINT) AS n_problems FROM part""")
def function_descriptions(spark, d):
    """A function a part: rendered, as a tool, and validated."""

    def run(frames):
        for pdf in frames:
            rows = []
            for key, name, brand in pdf.itertuples(index=False, name=None):
                fn = {"name": f"part.{key}", "description": name, "parameters": {"type": "dict", "properties": {"size": {"type": "integer", "description": brand}}, "required": ["size"]}}
                rows.append((key, schemas.as_xml([fn]), schemas.tools([fn], "completions")[0]["function"]["name"], len(schemas.problems(fn))))
            yield pd.DataFrame(rows, columns=["p_partkey", "xml", "tool_name", "n_problems"])

    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand").mapInPandas(run, "p_partkey long, xml string, tool_name string, n_problems long")


def _orders_as_calls(spark, d) -> DataFrame:
    """A session a customer: an open market, a log-in, and an order a row of orders."""
    o = table(spark, d, "orders")
    args = F.to_json(F.struct(F.lit("Buy").alias("order_type"), F.element_at(F.array(*[F.lit(x) for x in ("AAPL", "ZETA", "NONE")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("symbol"), F.round(F.col("o_totalprice") / 1000, 2).alias("price"), F.lit(10).alias("amount")))
    one = o.select(F.col("o_custkey").cast("string").alias("session"), F.lit("trading").alias("service"), F.lit("place_order").alias("method"), args.alias("args"), F.col("o_orderkey").alias("ord"))
    first = one.select("session", "service").distinct()
    load = first.select("*", F.lit("load").alias("method"), F.lit('{"market_status": "Open", "orders": {}, "order_counter": 1}').alias("args"), F.lit(-2).cast("long").alias("ord"))
    login = first.select("*", F.lit("trading_login").alias("method"), F.lit('{"username": "u", "password": "p"}').alias("args"), F.lit(-1).cast("long").alias("ord"))
    return one.union(load).union(login)


#: A call's result by hand: loading gives null, logging in a status, and an order its echo or the reason why not.
_REPLAYED = """SELECT CAST(o_custkey AS VARCHAR) AS session, o_orderkey AS ord, o_orderkey % 3 <> 2 AND round(o_totalprice / 1000, 2) > 0 AND round(o_totalprice / 1000, 2) * 10 <= 10000.0 AS placed FROM orders
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), CAST(x AS BIGINT), NULL FROM orders, (VALUES (-2), (-1)) v(x)"""


@query(_REPLAYED)
def replay_services(spark, d):
    """Orders replayed as calls of a simulated brokerage: whether each was placed."""
    done = actions.replay(_orders_as_calls(spark, d))
    return done.select("session", "ord", F.when(F.col("ord") >= 0, F.get_json_object("result", "$.status").eqNullSafe("Pending")).alias("placed"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS session, bool_and(o_orderkey % 5 <> 0) AS valid, CASE WHEN bool_and(o_orderkey % 5 <> 0) THEN NULL ELSE 'multi_turn:empty_turn_model_response' END AS error_type,
min(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END) AS turn FROM orders GROUP BY 1""")
def check_turns(spark, d):
    """Sessions of two sides that differ where the model leaves out every order whose key five divides."""
    calls = _orders_as_calls(spark, d)
    both = calls.select("*", F.col("ord").alias("turn"), F.when(F.col("ord") >= 0, F.lit("truth")).alias("side"))
    model = calls.filter("ord >= 0").select("session", "service", F.when(F.col("ord") % 5 != 0, F.col("method")).alias("method"), "args", "ord", F.col("ord").alias("turn"), F.lit("model").alias("side"))
    return actions.check_turns(both.unionByName(model))


@query("""WITH RECURSIVE l AS (SELECT conv_id * 1000 + turn AS id, 0 AS level FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id)
UNION ALL SELECT e.id, l.level + 1 FROM l JOIN (SELECT conv_id * 1000 + turn AS id, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) e ON e.p = l.id)
SELECT id, CAST(level AS BIGINT) AS level FROM l""")
def dependency_levels(spark, d):
    """Levels at which turns can run, each after the one before."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn")
    edges = stored(c.select("id", F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn")).alias("depends_on")).filter("depends_on is not null"), "edges")
    return relational.dag_levels(c.select("id"), edges).select("id", F.col("level").cast("long").alias("level"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion') OR lower(role) = 'tion'")
def search_posts(spark, d):
    posts = table(spark, d, "conversations").withColumn("tags", F.array("role"))
    return services.search(posts, "Tion", "text", "tags").select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'")
def date_range_filter(spark, d):
    return table(spark, d, "orders").filter(services.within(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))).select("o_orderkey")


#: Rates of the query below; names of no real currency.
RATES = [("aa", "bb", 2.0), ("bb", "cc", 4.0), ("cc", "aa", 0.25)]


@query("""WITH r AS (SELECT * FROM (VALUES ('aa', 'bb', 2.0::DOUBLE), ('bb', 'cc', 4.0::DOUBLE), ('cc', 'aa', 0.25::DOUBLE)) t(a, b, rate)),
x AS (SELECT c_custkey, ['aa', 'bb', 'cc'][c_nationkey % 3 + 1] AS source, ['aa', 'bb', 'cc', 'dd'][c_custkey % 4 + 1] AS target, c_acctbal FROM customer)
SELECT c_custkey, source, target, round(CASE WHEN source = target THEN c_acctbal WHEN s.rate IS NOT NULL THEN c_acctbal * s.rate ELSE c_acctbal / t.rate END, 4) AS converted
FROM x LEFT JOIN r s ON s.a = source AND s.b = target LEFT JOIN r t ON t.b = source AND t.a = target""")
def currency_exchange(spark, d):
    names = lambda *v: F.array(*map(F.lit, v))
    amounts = table(spark, d, "customer").select("c_custkey", F.get(names("aa", "bb", "cc"), F.col("c_nationkey") % 3).alias("source"), F.get(names("aa", "bb", "cc", "dd"), (F.col("c_custkey") % 4).cast("int")).alias("target"), "c_acctbal")
    return services.exchange(amounts, spark.createDataFrame(RATES, "base string, quote string, rate double"), "source", "target", "c_acctbal").select("c_custkey", "source", "target", F.round("converted", 4).alias("converted"))


@query("SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem GROUP BY 1")
def population_stats(spark, d):
    return services.population_stats(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("SELECT event_type, count(*) AS n_received, count(DISTINCT user_id) AS n_contacts FROM events GROUP BY 1")
def contact_stats(spark, d):
    return services.contact_stats(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT user_id, min(ts) AS first_start, max(ts) AS last_end, count(*) AS n_calls, round(sum(value), 4) AS total_value FROM events GROUP BY 1")
def usage_totals(spark, d):
    return services.usage(table(spark, d, "events"), "user_id", "ts", "ts", "value").withColumn("total_value", F.round("total_value", 4))


@query("""SELECT array_to_string(p[1:i], '/') AS folder, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS n_files
FROM (SELECT n, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT strlen(html) AS n, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages)) GROUP BY 1""")
def folder_sizes(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("n"))
    return services.folder_sizes(pages, "path", F.col("n"))


@query("SELECT doc_id, CAST(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS BIGINT) AS n_differences FROM (SELECT doc_id, string_split(text, chr(10)) AS a, list_sort(string_split(text, chr(10))) AS b FROM documents)")
def line_differences(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(services.line_differences(lines, F.array_sort(lines))).cast("long").alias("n_differences"))


@query("SELECT o_orderkey, CAST(list_sum(list_transform(regexp_extract_all(strftime(o_orderdate, '%Y-%m-%d'), '[0-9]'), lambda x: CAST(x AS INT))) AS BIGINT) AS digit_sum FROM orders")
def digit_sum_of_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", services.digit_sum(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("long").alias("digit_sum"))


@query("SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '_'), '[a-z]+(_[a-z0-9]+)*') AS valid_name, regexp_full_match(lower(p_brand), '[a-z]+(_[a-z0-9]+)*') AS valid_brand FROM part")
def memory_key_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", services.is_memory_key(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("valid_name"), services.is_memory_key(F.lower("p_brand")).alias("valid_brand"))


#: The share as the double it is: its parts of 2^-60 are whole, halves of a hundredth go up.
_SHARE = """WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type IN ('error', 'purchase')) AS n FROM events GROUP BY 1),
x AS (SELECT user_id, n, CASE WHEN n > 0 THEN CAST(floor(p / n * 1152921504606846976::DOUBLE) AS HUGEINT) * 200 ELSE 0 END AS s FROM n),
c AS (SELECT user_id, n, CAST((s + 1152921504606846976::HUGEINT) // (2 * 1152921504606846976::HUGEINT) AS BIGINT) AS c FROM x)
SELECT user_id, CASE WHEN n > 0 THEN format('{}.{:02d}', c // 100, c % 100) ELSE 'N/A' END AS share FROM c"""


@query(_SHARE)
def success_share(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("f"))
    return n.select("user_id", services.success_share(F.col("p"), F.col("f")).alias("share"))


@query("SELECT range AS doc_id FROM range((SELECT coalesce(max(doc_id) + 1, 0) FROM documents)) WHERE range NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_parts(spark, d):
    n = table(spark, d, "documents").agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    return services.missing_numbers(spark, n, table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def newest_snapshot(spark, d):
    return services.newest(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@query("SELECT c_custkey, [a.n_name, b.n_name] AS names FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + 7) % 25")
def lookup_expand(spark, d):
    lists = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 25).alias("keys"))
    return services.expand(lists, "c_custkey", "keys", table(spark, d, "nation"), "n_nationkey", "n_name").withColumnRenamed("values", "names")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20")
def page_of_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(20).limit(10)


@query("SELECT c_custkey, n_orders, c_acctbal FROM (SELECT c_custkey, coalesce(n, 0) AS n_orders, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) ORDER BY n_orders DESC, c_acctbal DESC, c_custkey LIMIT 25")
def top_with_tie_break(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "c_acctbal").orderBy(F.desc("n_orders"), F.desc("c_acctbal"), "c_custkey").limit(25)


__all__ = ["ORACLE", "QUERIES"]
