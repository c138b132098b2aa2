"""Registered queries of evaluation, prompts, ratings, sources and code texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions import code_text, prompts, source_calls
from evalmill.functions import pages as pages_of
from evalmill.functions.checking import check_call
from evalmill.functions.text import category_predicates
from evalmill.operators import battles, evaluation, relational, retrieval, similarity
from evalmill.plans.catalogue import STYLES, _BATTLES, _battles, _results, _scores, _SCORES
from evalmill.plans.registry import query
from evalmill.sources import datasets
from evalmill.sources import tables as S
from evalmill.sources.tables import shared_folder, stored, table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/evalmill/{name}-{uuid.uuid4().hex}"


# Evaluation -----------------------------------------------------------------------------------------

_CASES = """c AS (SELECT c_custkey, c_name, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'json' WHEN 2 THEN 'unknown' ELSE 'empty' END AS style,
CASE WHEN c_nationkey % 2 = 0 THEN 'live_relevance' ELSE 'live_irrelevance' END AS category FROM customer)"""


def _cases(spark, d):
    form = lambda s: F.format_string(STYLES[s], "c_name", "c_nationkey")
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(k == 0, form("python")).when(k == 1, form("json")).when(k == 2, form("unknown")).otherwise("[]").alias("result"), F.when(k == 1, "json").otherwise("python").alias("style"), F.when(F.col("c_nationkey") % 2 == 0, "live_relevance").otherwise("live_irrelevance").alias("category"))


@query(f"""WITH {_CASES} SELECT c_custkey, category, CASE category WHEN 'live_relevance' THEN style IN ('python', 'json') ELSE style NOT IN ('python', 'json') END AS valid,
CASE WHEN (category = 'live_relevance') = (style IN ('python', 'json')) THEN NULL WHEN category = 'live_relevance' THEN 'relevance_error:decoder_failed' ELSE 'irrelevance_error:decoder_success' END AS error_type FROM c""")
def relevance_entries(spark, d):
    """Whether outputs hold a call where one is wanted, and none where not."""
    return evaluation.relevance(evaluation.decode_results(_cases(spark, d))).select("c_custkey", "category", "valid", "error_type")


_DOCS = '[{"name": "lookup", "parameters": {"type": "dict", "properties": {"name": {"type": "string"}, "nation": {"type": "integer"}}, "required": ["name"]}}]'


@query(f"""WITH {_CASES} SELECT c_custkey, style IN ('python', 'json') AND c_nationkey < 20 AS valid, CASE WHEN style = 'unknown' THEN 'ast_decoder:decoder_failed' WHEN style = 'empty' THEN 'simple_function_checker:wrong_count' WHEN c_nationkey >= 20 THEN 'value_error:others' END AS error_type FROM c""")
def call_entries(spark, d):
    """Outputs decoded and checked against truths that know the first twenty nations."""
    truth = F.concat(F.lit('[{"lookup": {"name": ["'), F.col("name"), F.lit('"], "nation": ['), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(-1).cast("string"), F.lit("]}}]"))
    rows = _cases(spark, d).join(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey").select("c_custkey", "result", "style", F.lit("simple_python").alias("category"), F.lit(_DOCS).alias("docs"), truth.alias("truth"))
    return evaluation.call_entries(rows).select("c_custkey", "valid", "error_type")


_CONFIGS = "(SELECT f, t FROM (VALUES ('python'), ('json'), ('verbose_xml'), ('yaml')) a(f), (VALUES ('True'), ('False')) b(t))"


def _configs(spark, d):
    grid = spark.createDataFrame([(f, t) for f in ("python", "json", "verbose_xml", "yaml") for t in ("True", "False")], "f string, t string")
    row = F.concat(F.lit("format_sensitivity_"), F.col("item_id").cast("string"), F.lit(":ret_fmt="), "f", F.lit("&tool_call_tag="), "t", F.lit("&func_doc_fmt=xml&prompt_fmt=markdown&style=classic:live_simple_"), F.col("item_id").cast("string"))
    return table(spark, d, "benchmark").select("item_id", "text").crossJoin(F.broadcast(grid)).withColumn("row_id", row)


@query(f"SELECT item_id, f, t, 'live_simple' AS category, CASE WHEN f <> 'yaml' THEN f END AS return_format, CASE WHEN f <> 'yaml' THEN t = 'True' END AS has_tag, CASE WHEN f <> 'yaml' THEN 'markdown' END AS prompt_format FROM benchmark, {_CONFIGS}")
def format_configurations(spark, d):
    """Category and configuration of the ids of a format test; unknown forms have none."""
    x = prompts.category_and_format(F.col("row_id"))
    fields = prompts.config_fields(F.col("x.config"))
    return _configs(spark, d).withColumn("x", x).select("item_id", "f", "t", "x.category", fields["return_format"].alias("return_format"), fields["has_tag"].alias("has_tag"), fields["prompt_format"].alias("prompt_format"))


@query(f"""SELECT item_id, f || '/' || t AS config, f <> 'json' AND f <> 'yaml' OR item_id % 3 <> 0 AND f <> 'yaml' AS valid FROM benchmark, {_CONFIGS}""")
def format_sensitivity_entries(spark, d):
    """Calls written in the form their configuration asks for, but for every third in JSON, where it is Python's."""
    name, nation = F.concat(F.lit("n"), F.col("item_id").cast("string")), F.col("item_id")
    wrong = (F.col("f") == "json") & (F.col("item_id") % 3 == 0)
    text = F.when(wrong | (F.col("f") == "python"), F.format_string(STYLES["python"], name, nation)).when(F.col("f") == "json", F.format_string(STYLES["json"], name, nation)).when(F.col("f") == "verbose_xml", F.format_string(STYLES["xml"], name, nation)).otherwise("yaml: no")
    style = F.when(F.col("f") == "verbose_xml", "xml").otherwise(F.col("f"))
    truth = F.format_string('[{"lookup": {"name": ["%s"], "nation": [%d]}}]', name, nation)
    rows = _configs(spark, d).select("item_id", F.concat_ws("/", "f", "t").alias("config"), text.alias("result"), style.alias("style"), F.lit("live_simple").alias("category"), F.lit(_DOCS).alias("docs"), truth.alias("truth"))
    return evaluation.call_entries(rows).select("item_id", "config", "valid")


@query("""WITH s AS (SELECT conv_id, turn, text, role = 'assistant' AND turn % 2 = 1 AS called FROM conversations),
m AS (SELECT conv_id, arg_max(text, turn) FILTER (NOT called AND text IS NOT NULL) AS message FROM s GROUP BY 1)
SELECT conv_id, coalesce(message, '') <> '' AND regexp_matches(lower(regexp_replace(message, '[,./\\-_*^()]', '', 'g')), '\\b(the|and)\\b') AS valid FROM m""")
def agentic_entries(spark, d):
    """The last step without a call, and whether it has one of the answers as words."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), "[noted(n=1)]").otherwise(F.col("text")).alias("result"), F.lit("python").alias("style"))
    last = evaluation.last_message(evaluation.decode_results(c), "conv_id", "turn")
    return evaluation.agentic(last.withColumn("answers", F.array(F.lit("The"), F.lit("and")))).select("conv_id", "valid")


@query("""WITH r AS (SELECT source AS model, lang AS category, doc_id, quality = 1 AS valid FROM documents JOIN labels USING (doc_id))
SELECT model, category, 0 AS pos, '' AS id, CAST(count(*) FILTER (valid) AS VARCHAR) AS correct, CAST(count(*) AS VARCHAR) AS total FROM r GROUP BY 1, 2
UNION ALL SELECT model, category, 1, CAST(doc_id AS VARCHAR), NULL, NULL FROM r WHERE NOT valid""")
def score_file_lines(spark, d):
    """A header of counts for each file and its failed rows."""
    rows = _results(spark, d).select("model", "category", F.col("doc_id").alias("id"), (F.col("valid") == 1).alias("valid"))
    lines = evaluation.score_lines(rows, ["model", "category"])
    return lines.select("model", "category", "pos", "id", F.get_json_object("line", "$.correct_count").alias("correct"), F.get_json_object("line", "$.total_count").alias("total"))


_AS_TESTS = "CASE category WHEN 'en' THEN 'simple_python' WHEN 'de' THEN 'live_simple' WHEN 'fr' THEN 'multi_turn_base' WHEN 'es' THEN 'memory_kv' END"


def _as_tests(spark, d):
    names = {"en": "simple_python", "de": "live_simple", "fr": "multi_turn_base", "es": "memory_kv"}
    return _scores(spark, d).withColumn("category", F.coalesce(*[F.when(F.col("category") == k, v) for k, v in names.items()])).filter("category is not null")


@query(f"""WITH {_SCORES}, t AS (SELECT model, {_AS_TESTS} AS category, accuracy FROM s), p AS (SELECT model, sum(accuracy * CASE category WHEN 'simple_python' THEN 10 WHEN 'live_simple' THEN 10 WHEN 'multi_turn_base' THEN 30 ELSE 40 END) / 100 AS accuracy FROM t WHERE category IS NOT NULL GROUP BY 1)
SELECT model, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, model) AS rank FROM p""")
def overall_board(spark, d):
    return evaluation.leaderboards(_as_tests(spark, d))["overall"].withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_SCORES}, t AS (SELECT model, {_AS_TESTS} AS category, accuracy FROM s),
g AS (SELECT CASE category WHEN 'simple_python' THEN 'non_live' WHEN 'live_simple' THEN 'live' WHEN 'multi_turn_base' THEN 'multi_turn' ELSE 'agentic' END AS board, * FROM t WHERE category IS NOT NULL)
SELECT board, model, round(accuracy, 6) AS accuracy, category, row_number() OVER (PARTITION BY board ORDER BY accuracy DESC, model) AS rank FROM g""")
def group_boards(spark, d):
    """The boards of all groups of tests in one table."""
    boards, out = evaluation.leaderboards(_as_tests(spark, d)), None
    for name in ("non_live", "live", "multi_turn", "agentic"):
        one = boards[name].select(F.lit(name).alias("board"), "model", F.round("accuracy", 6).alias("accuracy"), F.map_keys("categories")[0].alias("category"), "rank")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT c_custkey, list_filter(['f0', 'f1', 'f2', 'f3', 'f1'], lambda x, i: NOT (x = 'f' || (c_custkey % 4) AND i = list_position(['f0', 'f1', 'f2', 'f3', 'f1'], x)) AND NOT (x = 'f0' AND i = 1)) AS kept,
['f' || (c_custkey % 4)] AS first_turn, ['f0'] AS later FROM customer""")
def held_out_functions(spark, d):
    """Functions without those that a turn is to miss, and the missed ones by turn."""
    docs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("n")) for i, n in enumerate(("f0", "f1", "f2", "f3", "f1"))])
    name = F.concat(F.lit("f"), (F.col("c_custkey") % 4).cast("string"))
    missed = F.create_map(F.lit("1"), F.array(name), F.lit("2"), F.array(F.lit("f0"), F.lit("none")))
    x = evaluation.held_out(docs, missed)
    of = lambda c: F.transform(c, lambda s: s["name"])
    return table(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", of(F.col("x.functions")).alias("kept"), of(F.col("x.missed")["1"]).alias("first_turn"), of(F.col("x.missed")["2"]).alias("later"))


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS method, c_custkey % 5 = 0 AS denied, c_custkey % 2 = 0 AS in_order FROM customer")
def call_predicates(spark, d):
    """Calls that must not be run, and methods called in the right order."""
    c = table(spark, d, "customer")
    method = F.split("c_name", "#")[1]
    call = F.when(F.col("c_custkey") % 5 == 0, F.lit("os.remove('x')")).otherwise(F.concat(F.lit("api.m"), method, F.lit("(a='quit')")))
    found = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("x"), F.lit("a")))
    return c.select("c_custkey", method.alias("method"), evaluation.is_denied(call).alias("denied"), evaluation.in_same_order(F.array(F.lit("a"), F.lit("b")), found).alias("in_order"))


@query("SELECT conv_id, count(*) > 3 AS forced FROM conversations GROUP BY 1")
def step_budget(spark, d):
    c = table(spark, d, "conversations").withColumn("one", F.lit(0))
    return evaluation.over_budget(c, "conv_id", "one", "turn", 3).select("conv_id", "forced")


@query("SELECT conv_id, min(CASE WHEN role = 'user' AND turn % 3 = 0 THEN turn END) IS NULL AS valid, min(CASE WHEN role = 'user' AND turn % 3 = 0 THEN turn END) AS turn FROM conversations GROUP BY 1")
def irrelevant_turns(spark, d):
    """Turns without true calls in which the model calls something: users' at every third place."""
    none = F.array().cast("array<string>")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", none).otherwise(F.array(F.lit("f()"))).alias("truth"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("f()"))).otherwise(none).alias("model"))
    return evaluation.irrelevance_by_turn(c, "conv_id", "turn", "truth", "model")


@query("SELECT lang AS category, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def ids_by_category(spark, d):
    g = evaluation.by_category(table(spark, d, "documents").filter("lang is not null"), "lang", "doc_id")
    return g.select(F.col("lang").alias("category"), F.size("ids").cast("long").alias("n"), F.get("ids", 0).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("SELECT s_suppkey, 'org/' || n_name AS shown, n_regionkey AS price FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def scores_with_models(spark, d):
    """Results joined with their models' table, folders' underscores standing for slashes."""
    n = table(spark, d, "nation")
    models = n.select(F.concat(F.lit("org/"), F.replace("n_name", F.lit("_"), F.lit("/"))).alias("model"), F.col("n_regionkey").alias("price"), F.concat(F.lit("org/"), "n_name").alias("shown"))
    s = table(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("org_"), "n_name").alias("model")), "s_nationkey")
    return evaluation.with_model(s.select("s_suppkey", "model"), models).select("s_suppkey", "shown", "price")


@query("""WITH a AS (SELECT n_nationkey AS id, n_name AS arg, n_regionkey AS domain FROM nation), r AS (SELECT c_custkey AS id, 'f(' || list_string || ')' AS text FROM (SELECT c_custkey, c_nationkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) || ', ' || c_custkey AS list_string FROM customer)),
h AS (SELECT r.id, min(a.id) AS api FROM r LEFT JOIN a ON contains(r.text, a.arg) AND a.id < 20 GROUP BY 1)
SELECT round(avg(CASE WHEN d.domain = w.n_regionkey THEN 1.0::DOUBLE ELSE 0 END), 8) AS accuracy, round(avg(CASE WHEN api IS NULL THEN 1.0::DOUBLE ELSE 0 END), 8) AS hallucination, count(*) AS n
FROM h JOIN customer ON c_custkey = h.id LEFT JOIN a d ON d.id = h.api LEFT JOIN nation w ON w.n_nationkey = c_custkey % 25""")
def api_matches(spark, d):
    """The first api whose arguments a response holds, against the domain at the question's position."""
    n = table(spark, d, "nation")
    apis = n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.array(F.concat(F.lit("'"), "n_name", F.lit("'"))).alias("args"), F.col("n_regionkey").alias("domain"))
    responses = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("f("), "n_name", F.lit(", "), F.col("c_custkey").cast("string"), F.lit(")")).alias("text"))
    found = evaluation.first_api(responses, apis).withColumn("question", F.col("response") % 25 + 1)
    got = evaluation.functional_accuracy(found, apis, n.select((F.col("n_nationkey") + 1).alias("position"), F.col("n_regionkey").alias("domain")))
    return got.withColumns({c: F.round(c, 8) for c in ("accuracy", "hallucination")})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'plain ' || c_name || '(x)' ELSE 'load(' || c_name || ', n=(1))' END AS call FROM customer")
def api_call_slices(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("plain "), "c_name", F.lit("(x)"))).otherwise(F.concat(F.lit("domain: D, api_call: load("), "c_name", F.lit(", n=(1)), api_provider: P")))
    return table(spark, d, "customer").select("c_custkey", code_text.api_call_slice(t).alias("call"))


@query("""SELECT c AS category, c IN ('memory_kv', 'memory_vector', 'memory_rec_sum') AS memory, c LIKE 'live%' AS live, c IN ('simple_python', 'simple_java', 'simple_javascript', 'multiple', 'parallel', 'parallel_multiple', 'irrelevance') AS non_live,
c = 'simple_java' AS java, c = 'simple_javascript' AS javascript, c LIKE '%relevance' AS relevance, c IN ('multi_turn_miss_func', 'multi_turn_miss_param') AS multi_turn_irrelevance, c LIKE 'multi_turn%' OR c LIKE 'memory%' OR c LIKE 'web_search%' AS multi_turn_interaction
FROM (SELECT unnest(['simple_python', 'simple_java', 'simple_javascript', 'multiple', 'parallel', 'parallel_multiple', 'irrelevance', 'live_simple', 'live_multiple', 'live_parallel', 'live_parallel_multiple', 'live_irrelevance', 'live_relevance', 'multi_turn_base', 'multi_turn_miss_func', 'multi_turn_miss_param', 'multi_turn_long_context', 'memory_kv', 'memory_vector', 'memory_rec_sum', 'web_search_base', 'web_search_no_snippet', 'format_sensitivity']) AS c)""")
def category_kinds(spark, d):
    """What each test category is."""
    p = category_predicates(F.col("category"))
    return spark.createDataFrame([(n,) for n in prompts.expand_categories(["all"])], "category string").select("category", *[p[k].alias(k) for k in ("memory", "live", "non_live", "java", "javascript", "relevance", "multi_turn_irrelevance", "multi_turn_interaction")])


#: A value, what is allowed, its declared type and that of its items, and the error.
_CHECKED = [
    ('"New York"', '["new-york"]', "string", "", None), ('"x"', '["y"]', "string", "", "value_error:string"), ("1", '["y"]', "string", "", "type_error:simple"), ('"n"', '["n"]', "integer", "", None), ("[1, 2]", "[[1, 2]]", "array", "integer", None), ('[1, "2"]', "[[1, 2]]", "array", "integer", "type_error:nested"),
    ('["b"]', '[["ab"]]', "array", "string", "value_error:list/tuple"), ('{"k": "A"}', '[{"k": ["a"]}]', "dict", "", None), ('{"q": 1}', '[{"k": ["a", ""]}]', "dict", "", "value_error:dict_key"), ('{"k": "b"}', '[{"k": ["a"]}]', "dict", "", "value_error:dict_value"), ('[{"k": 1}, {"k": 2}]', '[[{"k": [1]}]]', "array", "dict", "value_error:list_dict_count"),
    ("2", "[1]", "integer", "", "value_error:others"), ("1", "[1.0]", "float", "", None),
]


@query("SELECT c_custkey, i, error FROM customer, (VALUES " + ", ".join(f"({i}, {'NULL' if c[4] is None else repr(c[4])})" for i, c in enumerate(_CHECKED)) + ") v(i, error)")
def checked_arguments(spark, d):
    """Arguments of every type held against allowed values, and the first error."""
    cases = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(_CHECKED)], "i int, value string, allowed string, kind string, items string")
    rows = table(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(cases))

    def one(key, i, value, allowed, kind, items):
        import json

        doc = {"name": f"f{key}", "parameters": {"properties": {"x": {"type": kind} | ({"items": {"type": items}} if items else {})}}}
        return key, i, check_call(doc, {f"f{key}": {"x": json.loads(value)}}, {f"f{key}": {"x": json.loads(allowed)}})

    return _python_rows(rows, one, "c_custkey long, i int, error string")


# Prompts and messages -------------------------------------------------------------------------------


def _system_sql(fmt: str, tag: bool, style: str) -> str:
    s, heads = prompts.STYLES[style], prompts.HEADINGS["markdown"]
    a, b, c = s["tagged" if tag else "bare"]
    text = s["persona"] + heads[0] + s["task"] + heads[1] + a + prompts.OUTPUT_FORMATS[fmt] + b + (prompts.XML_TYPES if "xml" in fmt else "") + c + heads[2] + s["turns"] + heads[3] + s["tools"][0] + "xml" + s["tools"][1]
    return "'" + text.replace("'", "''") + "'"


@query("SELECT item_id, f, t, md5(CASE " + " ".join(f"WHEN f = '{f}' AND t = '{t}' THEN {_system_sql(f, t, 'classic')}" for f in ("python", "json", "verbose_xml") for t in (True, False)) + f" END || text || chr(10)) AS prompt_md5 FROM benchmark, {_CONFIGS}")
def system_prompts(spark, d):
    """The system prompt of each configuration around a rendered list of functions."""
    config = F.split("row_id", ":")[1]
    return _configs(spark, d).select("item_id", "f", "t", F.md5(prompts.system_prompt(F.col("text"), config)).alias("prompt_md5"))


def _talks(spark, d):
    m = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


@query("""WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN role = 'system' THEN n ELSE n + 1 END AS n, 'user' AS first_role, CASE WHEN role = 'system' THEN 'Be brief.' || chr(10) || chr(10) || text ELSE 'Be brief.' END AS first_text FROM f""")
def system_messages(spark, d):
    """A system's message put before a conversation, or merged into its own, and said by the user."""
    m = prompts.system_as_user(prompts.with_system(F.col("m"), F.lit("Be brief.")))
    return _talks(spark, d).select("conv_id", m.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.get("m", 0)["role"].alias("first_role"), F.get("m", 0)["content"].alias("first_text"))


@query("SELECT conv_id, least(count(*), 2) AS n, 'tool' AS role, 'f1()' AS name, arg_min(text, turn) AS content FROM conversations GROUP BY 1")
def tool_result_messages(spark, d):
    texts = F.transform("m", lambda x: x["content"])
    t = prompts.tool_results(texts, F.array(F.lit("f1()"), F.lit("f2()")))
    return _talks(spark, d).select("conv_id", t.alias("t")).select("conv_id", F.size("t").cast("long").alias("n"), F.get("t", 0)["role"].alias("role"), F.get("t", 0)["name"].alias("name"), F.get("t", 0)["content"].alias("content"))


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN NULL ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, 'system' || coalesce(string_agg(CASE WHEN i % 2 = 0 THEN ',user' WHEN text IS NOT NULL THEN ',assistant' END, '' ORDER BY i), '') AS roles FROM x GROUP BY 1""")
def message_lists(spark, d):
    """Texts as user's and assistant's in turn; an assistant's null is left out."""
    order = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 4 != 1, F.col("text")).alias("text"))))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(order.alias("m"))
    return g.select("conv_id", F.array_join(F.transform(prompts.message_list(F.transform("m", lambda x: x["text"]), F.lit("s")), lambda x: x["role"]), ",").alias("roles"))


_FOLDS = {
    "colon_single": ("'S' || chr(10) || string_agg({r} || ': ' || {t} || chr(10), '' ORDER BY i)"),
    "colon_two": ("'S' || chr(10) || string_agg({r} || ': ' || {t} || CASE WHEN i % 2 = 0 THEN chr(10) ELSE '</s>' END, '' ORDER BY i)"),
    "no_colon": ("'S' || string_agg({r} || {t} || chr(10), '' ORDER BY i)"),
    "new_line": ("'S' || chr(10) || string_agg({r} || chr(10) || {t} || chr(10), '' ORDER BY i)"),
    "dolly": ("'S' || string_agg({r} || ':' || chr(10) || {t} || CASE WHEN i % 2 = 0 THEN chr(10) ELSE '</s>' || chr(10) || chr(10) END, '' ORDER BY i)"),
    "rwkv": ("'S' || string_agg({r} || ': ' || replace(replace({t}, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)) || chr(10) || chr(10), '' ORDER BY i)"),
    "phoenix": ("'S' || string_agg({r} || ': <s>' || {t} || '</s>', '' ORDER BY i)"),
}


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE text <> '') " + " UNION ALL ".join(f"SELECT conv_id, '{s}' AS style, md5({q.format(r='role', t='text')}) AS prompt_md5 FROM x GROUP BY conv_id" for s, q in _FOLDS.items()))
def chat_styles(spark, d):
    """Conversations as prompts in each style."""
    t = _talks(spark, d).select("conv_id", F.filter("m", lambda x: x["content"] != "").alias("m")).filter(F.size("m") > 0)
    styles = F.array(*[F.struct(F.lit(s).alias("style"), F.md5(prompts.chat_fold(F.col("m"), s, F.lit("S"))).alias("prompt_md5")) for s in _FOLDS])
    return t.select("conv_id", F.explode(styles).alias("x")).select("conv_id", "x.*")


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'S' || chr(10) || '### Instruction: <<question>> ' || text || chr(10) || '### Response: ' ELSE 'S' || chr(10) || '### Instruction: <<function>>[1]' || chr(10) || '<<question>>' || text || chr(10) || '### Response: ' END AS asked,
'C: c' || item_id || ' Q: ' || text || '.' AS filled FROM benchmark""")
def question_prompts(spark, d):
    """Questions with functions, and in a template."""
    functions = F.when(F.col("item_id") % 2 == 1, "[1]")
    filled = prompts.question_prompt("C: {context} Q: {question}.", F.col("text"), F.concat(F.lit("c"), F.col("item_id").cast("string")))
    return table(spark, d, "benchmark").select("item_id", prompts.function_prompt(F.col("text"), functions, "S").alias("asked"), filled.alias("filled"))


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'simple_python' WHEN 1 THEN 'memory_kv_prereq' WHEN 2 THEN 'web_search_base' WHEN 3 THEN 'multi_turn_base' WHEN 4 THEN 'memory_vector' ELSE 'live_simple' END AS category FROM documents)
SELECT doc_id, [1, 0, 1, 3, 4, 2][1] IS NOT NULL AS ok, CASE doc_id % 6 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 2 END AS priority, category, CAST(doc_id AS INTEGER) AS index FROM i""")
def test_order(spark, d):
    """Priority, category and number by which tests are run."""
    k = F.col("doc_id") % 6
    category = F.when(k == 0, "simple_python").when(k == 1, "memory_kv_prereq").when(k == 2, "web_search_base").when(k == 3, "multi_turn_base").when(k == 4, "memory_vector").otherwise("live_simple")
    row = F.concat_ws("_", category, F.concat(F.col("doc_id").cast("string"), F.when(k == 5, "-3-15").otherwise("")))
    return table(spark, d, "documents").select("doc_id", F.lit(True).alias("ok"), prompts.sort_key(row).alias("x")).select("doc_id", "ok", "x.*")


@query("SELECT * FROM (VALUES ('live_simple', 'live', NULL), ('memory_kv', 'agentic/memory/kv', 'kv'), ('memory_rec_sum', 'agentic/memory/rec_sum', 'rec_sum'), ('memory_vector', 'agentic/memory/vector', 'vector'), ('multi_turn_base', 'multi_turn', NULL), ('simple_python', 'non_live', NULL), ('web_search_base', 'agentic', NULL)) t(category, folder, backend)")
def category_folders(spark, d):
    """Folders and kinds of memory of a collection and some categories."""
    names = prompts.expand_categories(["memory", "live_simple", "multi_turn_base", "simple_python", "web_search_base", "memory_kv"])
    return spark.createDataFrame([(n,) for n in names], "category string").select("category", prompts.directory_key(F.col("category")).alias("folder"), prompts.memory_backend(F.col("category")).alias("backend"))


@query("SELECT c_custkey, ['SELECT ' || c_custkey, 'x = ''' || c_name || ''''] AS parts, CASE WHEN c_custkey % 2 = 0 THEN 'over' ELSE 'plain' END AS key, c_custkey % 3 = 0 AS has_other FROM customer")
def statements_and_settings(spark, d):
    """Statements between semicolons; settings with those of a prefix first."""
    sql = F.concat(F.lit(" SELECT "), F.col("c_custkey").cast("string"), F.lit(";; x = '"), "c_name", F.lit("' ; "))
    env = F.map_from_entries(F.filter(F.array(F.struct(F.lit("KEY").alias("k"), F.lit("plain").alias("v")), F.struct(F.when(F.col("c_custkey") % 2 == 0, "EVAL_KEY").otherwise("EVAL_NONE").alias("k"), F.lit("over").alias("v")), F.struct(F.when(F.col("c_custkey") % 3 == 0, "OTHER").otherwise("SECRET").alias("k"), F.lit("o").alias("v"))), lambda e: e["k"].isNotNull()))
    seen = prompts.with_overrides(env, "EVAL_", ["KEY", "OTHER"])
    return table(spark, d, "customer").select("c_custkey", prompts.statements(sql).alias("parts"), seen["KEY"].alias("key"), F.map_contains_key(seen, "OTHER").alias("has_other"))


@query("SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-02-29') AS INTEGER) AS age, CAST(o_custkey + CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM orders")
def ages_and_counters(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", prompts.age(F.col("o_orderdate").cast("date"), F.lit("2024-02-29").cast("date")).cast("int").alias("age"), prompts.bumped(F.col("o_custkey").cast("long"), F.col("o_orderkey") % 7, F.lit(3)).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'r' || turn ELSE '' END AS reasoning, text AS answer, CASE WHEN turn % 2 = 1 THEN '[1]' ELSE '' END AS block FROM (SELECT conv_id, turn, ltrim(text) AS text FROM conversations)")
def reasoning_and_blocks(spark, d):
    c = table(spark, d, "conversations")
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think> r"), F.col("turn").cast("string"), F.lit("\n</think>\n"), "text")).otherwise(F.col("text"))
    x = F.when(F.col("turn") % 2 == 1, F.lit("a <tool_calls>\n[1]\n</tool_calls> <tool_calls>\n[2]\n</tool_calls>")).otherwise("none")
    spaces = F.regexp_replace("x.answer", r"^\s+", "")
    return c.select("conv_id", "turn", prompts.reasoning_split(t).alias("x"), prompts.tool_calls_block(x).alias("block")).select("conv_id", "turn", F.regexp_replace("x.reasoning", r"\s+$", "").alias("reasoning"), spaces.alias("answer"), "block")


# Ratings --------------------------------------------------------------------------------------------


@query(f"WITH {_BATTLES}, n AS (SELECT DISTINCT name FROM (SELECT a AS name FROM battles UNION ALL SELECT b FROM battles)), m AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM battles UNION ALL SELECT b, a FROM battles) GROUP BY 1, 2) SELECT x.name AS a, y.name AS b, coalesce(m.n, 0) AS n FROM n x CROSS JOIN n y LEFT JOIN m ON m.a = x.name AND m.b = y.name")
def square_battle_counts(spark, d):
    return battles.square_counts(_battles(spark, d))


@query("SELECT s_suppkey, CAST(trunc(s_acctbal + 0.5::DOUBLE) AS INTEGER) AS rating FROM supplier")
def rounded_ratings(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", battles.rounded(F.col("s_acctbal").cast("double")).alias("rating"))


@query("""WITH n AS (SELECT n_regionkey AS g, n_name AS name, CAST(n_nationkey AS VARCHAR) || '.0' AS r, n_nationkey FROM nation)
SELECT g, 0 AS pos, 'ELO Ratings for ' || g || ' category:' AS line FROM (SELECT DISTINCT g FROM n) UNION ALL SELECT g, row_number() OVER (PARTITION BY g ORDER BY n_nationkey DESC), name || ': ' || r FROM n UNION ALL SELECT g, count(*) + 1, '' FROM n GROUP BY 1""")
def rating_file_lines(spark, d):
    """Ratings written as a text of sections."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("rating"))
    return battles.rating_lines(n, "g")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS category, n_name AS name, CAST(n_nationkey AS DOUBLE) AS rating FROM nation""")
def rating_file_round_trip(spark, d):
    """The same written and read again: a headline names the group of the ratings below it."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("rating"))
    path = _place(spark, "ratings")
    datasets.write_rating_files(battles.rating_lines(n, "g"), path, "g")
    lines = datasets.numbered_lines(spark, path).withColumnRenamed("position", "line_no")
    return S.rating_file(lines).select(F.regexp_extract("category", r"for (\d+)", 1).alias("category"), "name", "rating")


@query()
def component_ratings(spark, d):
    """Strengths of tools, models and frameworks together."""
    b = _battles(spark, d).withColumn("n", F.col("ord"))
    of = lambda p, c, k: F.concat(F.lit(p), F.pmod(F.xxhash64(c), F.lit(k)).cast("string"))
    rows = b.select("rating", of("t", "a", 5).alias("tool_a"), of("t", "b", 5).alias("tool_b"), of("m", "a", 3).alias("model_a"), of("m", "b", 3).alias("model_b"), of("f", "a", 2).alias("framework_a"), of("f", "b", 2).alias("framework_b"), F.array(of("c", "a", 2)).alias("tool_categories_a"), F.array(of("c", "b", 2)).alias("tool_categories_b"))
    return battles.components_mle(rows).withColumn("rating", F.round("rating", 4))


# Sources and sinks ----------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS file_category, lang AS category, md5(text) AS result_md5 FROM documents WHERE lang IS NOT NULL")
def json_lines_round_trip(spark, d):
    """Results written as JSON lines by group and category, and read by the names of their files."""
    path = _place(spark, "results")
    rows = table(spark, d, "documents").filter("lang is not null").select(F.col("source").alias("group"), F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("result"), F.lit(None).cast("string").alias("model"))
    S.write_results(rows, path)
    back = S.json_lines(spark, path, "result")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"category=([^/]+)/", 1)
    return back.select("id", folder.alias("file_category"), folder.alias("category"), F.md5("result").alias("result_md5"))


@query("SELECT o_orderkey, o_custkey, o_orderkey % 5 AS part FROM orders WHERE o_orderkey % 5 < 4")
def dataset_parts(spark, d):
    """A job whose second run makes only the parts that the first left out."""
    o, path = stored(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "orders"), _place(spark, "parts")
    make = lambda n: o.filter(F.col("o_orderkey") % 5 == n)
    datasets.save_part(make(1), path, 1)
    return datasets.resumed(spark, path, 4, make).select("o_orderkey", "o_custkey", F.col("part").cast("long").alias("part"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def index_round_trip(spark, d):
    path = _place(spark, "index")
    datasets.save_index(table(spark, d, "embeddings"), path, "vec_id")
    return datasets.load_index(spark, path).select("vec_id", F.round("norm", 6).alias("norm"), F.size("embedding").alias("size"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS position, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def numbered_file(spark, d):
    """Lines of a file with their numbers."""
    path = _place(spark, "lines")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("value"), "n_nationkey").repartition(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    return datasets.numbered_lines(spark, path)


@query("SELECT n_nationkey + 1 AS id, n_regionkey + 1 AS question, 'f(' || n_name || ')' AS text, 'D' || n_regionkey AS domain FROM nation")
def api_files(spark, d):
    """Reference calls, answers and responses read from their three files, joined by position."""
    n, path = table(spark, d, "nation"), _place(spark, "apis")
    one = lambda df: df.repartition(1).sortWithinPartitions("o").select("value")
    call = F.concat(F.lit("f("), "n_name", F.lit(")"))
    one(n.select(F.to_json(F.struct(F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("domain"), call.alias("api_call"))).alias("value"), F.col("n_nationkey").alias("o"))).write.text(f"{path}/apis")
    one(table(spark, d, "region").select(F.to_json(F.struct(F.struct(F.concat(F.lit("D"), F.col("r_regionkey").cast("string")).alias("domain")).alias("api_data"))).alias("value"), F.col("r_regionkey").alias("o"))).write.text(f"{path}/pairs")
    one(n.select(F.to_json(F.struct((F.col("n_regionkey") + 1).alias("question_id"), call.alias("text"))).alias("value"), F.col("n_nationkey").alias("o"))).write.text(f"{path}/responses")
    apis, pairs, responses = datasets.api_tables(spark, f"{path}/apis", f"{path}/pairs", f"{path}/responses")
    return responses.join(pairs.withColumnRenamed("position", "question"), "question").join(apis.select("id", F.col("call")), "id").select("id", "question", "text", "domain")


@query("SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def appended_rows(spark, d):
    path = _place(spark, "appended")
    datasets.append_rows(table(spark, d, "customer").select("c_custkey"), path)
    datasets.append_rows(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), path)
    return spark.read.parquet(path)


@query("SELECT model, category, count(*) + 1 AS n_lines FROM (SELECT source AS model, lang AS category FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 AND lang IS NOT NULL) GROUP BY 1, 2 UNION ALL SELECT source, lang, 1 FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2 HAVING min(quality) = 1")
def score_files(spark, d):
    """Score files written and read: lines of each."""
    rows = _results(spark, d).filter("category is not null").select("model", "category", F.col("doc_id").alias("id"), (F.col("valid") == 1).alias("valid"))
    path = _place(spark, "scores")
    datasets.write_score_files(evaluation.score_lines(rows, ["model", "category"]), path, ["model", "category"])
    return spark.read.text(path).groupBy("model", "category").agg(F.count("*").alias("n_lines"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY lower(n_name), n_name, n_nationkey) AS place FROM nation")
def locale_order(spark, d):
    return relational.in_locale_order(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "n_nationkey")


@query("SELECT n_name, CASE WHEN n_regionkey = 0 THEN n_nationkey ELSE n_regionkey END AS skill FROM nation WHERE n_nationkey < 15")
def skills_by_name(spark, d):
    """Rows of the names in a list, whose values go before their own unless they are 0."""
    n = table(spark, d, "nation")
    given = n.filter("n_nationkey < 15").select("n_name", F.col("n_regionkey").alias("skill"))
    return relational.named_with_override(relational.only(n, ["n_name", "n_nationkey"]).withColumnRenamed("n_nationkey", "skill"), given, "n_name", "skill").select("n_name", "skill")


@query("""WITH d AS (SELECT page_id AS k, string_split(url, '/') AS w FROM pages), q AS (SELECT page_id AS query, string_split(url, '/')[-1] AS term FROM pages WHERE page_id < 5),
c AS (SELECT k, len(w) AS dl, term, count(*) AS f FROM (SELECT k, w, unnest(w) AS term FROM d) GROUP BY ALL), t AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, t), i AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
s AS (SELECT query, k AS page_id, round(sum(idf * f * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + f)), 6) AS score FROM q JOIN i USING (term) JOIN c USING (term), t GROUP BY 1, 2)
SELECT query, rank, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) AS rank FROM s) JOIN pages USING (page_id) WHERE rank <= 3""")
def page_search(spark, d):
    """The best pages for the last parts of some addresses, without snippets."""
    pages = table(spark, d, "pages").select("page_id", "url", F.col("url").alias("text"))
    asked = pages.filter("page_id < 5").select(F.col("page_id").alias("q"), F.element_at(F.split("url", "/"), -1).alias("text"))
    return retrieval.web_search(pages, asked, "page_id", "q", lambda c: F.split(c, "/"), 3, show_snippet=False)


@query("SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations")
def embedding_texts(spark, d):
    """Texts for an embedding model, in batches."""
    c = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return retrieval.embedding_batches(c, "key", "text", 64).select("key.conv_id", "key.turn", "text")


@query("SELECT id, kind, prompt, completion FROM (SELECT item_id AS id, text AS prompt, 'A ' || text AS completion FROM benchmark WHERE length(text) > 0), (VALUES ('jsonl'), ('parquet')) v(kind)")
def exported_rows(spark, d):
    """Training rows exported as JSON lines and Parquet, and read again."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("instruction"), F.concat(F.lit("A "), "text").alias("cot_answer"))
    out = None
    for kind, end in (("jsonl", ".jsonl"), ("parquet", "")):
        path = _place(spark, "exported") + end
        datasets.export(rows, path, "completion", kind)
        one = datasets.load_rows(spark, path).select("id", F.lit(kind).alias("kind"), "prompt", "completion")
        out = one if out is None else out.union(one)
    return out


@query("SELECT c_custkey, 'lookup(name=''' || c_name || ''',nation=' || c_nationkey || ')' AS source FROM customer")
def calls_as_source(spark, d):
    """Outputs of a model read by its handler, as source to run."""
    made = table(spark, d, "customer").select("c_custkey", F.format_string(STYLES["tagged"], "c_name", "c_nationkey").alias("text"))
    handler = source_calls.Handler("tagged")
    return _python_rows(made, lambda k, t: (k, handler.source(t)[0]), "c_custkey long, source string")


@query("SELECT page_id, md5(coalesce(html, '')) AS raw_md5 FROM pages")
def raw_pages(spark, d):
    p = pages_of.converted(table(spark, d, "pages").select("page_id", "html"), "html", "raw")
    return p.select("page_id", F.md5("text").alias("raw_md5"))


# Code texts -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'int a = 1;  ' || chr(10) || 's = \"// ' || p_name || '\";  ' AS kept FROM part")
def comments_stripped(spark, d):
    code = F.concat(F.lit("int a = 1; // one\n\n/* two\nthree */\ns = \"// "), "p_name", F.lit('"; /* x */'))
    return table(spark, d, "part").select("p_partkey", code_text.without_c_comments(code).alias("kept"))


def _python_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([fn(*r) for r in pdf.itertuples(index=False, name=None)], columns=names)

    return df.mapInPandas(run, schema)


@query("""SELECT p_partkey, 'x = ' || p_size AS stripped, ['''' || p_brand || '''', CAST(p_size AS VARCHAR)] AS arguments, 'a.f(x=b.g(' || p_size || '))' AS call, CAST(1 AS BIGINT) AS n_errors,
['numpy', 'PyYAML'] AS needs, '{"type": "array", "items": {"type": "integer"}}' AS kind FROM part""")
def code_rows(spark, d):
    """Code without comments, arguments of calls, calls with their owners, unreadable statements, needed packages and types."""

    def one(key, size, brand):
        import json

        code = f'"""Doc."""\nx = {size}  # {brand}\n\n'
        return key, code_text.without_python_comments(code), code_text.reference_arguments(f"f('{brand}', n={size})"), code_text.qualified(f"f(x=g({size}))", {"f": "a", "g": "b"}), code_text.syntax_errors(f"x = {size}\ny = = 1\nz = 2\n"), code_text.dependencies("import os, yaml\nfrom numpy.linalg import svd\nfrom . import me\nimport mine", {"yaml": "PyYAML"}, ["mine"]), json.dumps(code_text.type_schema("Optional[List[int]]"))

    return _python_rows(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), one, "p_partkey long, stripped string, arguments array<string>, call string, n_errors long, needs array<string>, kind string")


@query("""SELECT p_partkey, 'Looks up. ' || p_name AS description, 'integer' AS size_type, ['size'] AS required, 'first more' AS said FROM part""")
def docstring_descriptions(spark, d):
    """Descriptions of functions from their docstrings."""

    def one(key, name):
        s = code_text.docstring_schema(f"Looks up.\n    {name}\n\n    Args:\n        size (int): first\n            more\n        kind (str, default='a'): [Optional] second\n    Returns:\n        ok (bool): done\n")
        p = s["parameters"]
        return key, s["description"], p["properties"]["size"]["type"], p["required"], p["properties"]["size"]["description"]

    return _python_rows(table(spark, d, "part").select("p_partkey", "p_name"), one, "p_partkey long, description string, size_type string, required array<string>, said string")


@query("""WITH p AS (SELECT item_id AS id, string_split(b.text, ' ') AS r, string_split(d.text, ' ') AS h FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
w AS (SELECT id, unnest(r) AS g, 'r' AS side FROM p UNION ALL SELECT id, unnest(h), 'h' FROM p), c AS (SELECT id, g, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM w GROUP BY 1, 2)
SELECT id, round(CAST(sum(least(r, h) * CASE WHEN starts_with(g, 't') THEN 2.0 ELSE 1.0 END) AS DOUBLE), 6) AS hits, round(CAST(sum(r * CASE WHEN starts_with(g, 't') THEN 2.0 ELSE 1.0 END) AS DOUBLE), 6) AS total FROM c WHERE r > 0 GROUP BY 1""")
def weighted_recalls(spark, d):
    """Words of references found in texts, those that begin with t weighing two."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ref"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("hyp")).join(b, "id").select("id", "ref", "hyp")

    def one(key, ref, hyp):
        words = ref.split(" ")
        hits, total = code_text.weighted_recall([(words, {w: 2.0 if w.startswith("t") else 1.0 for w in words})], hyp.split(" "), 1)
        return key, round(hits, 6), round(total, 6)

    return _python_rows(rows, one, "id long, hits double, total double")


@query("""WITH p AS (SELECT item_id AS id, string_split(b.text, ' ') AS r, string_split(d.text, ' ') AS h FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), o AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, n, array_to_string(h[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, n, h, unnest(range(1, len(h) - n + 2)) AS k FROM p, o WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT id, n, array_to_string(r[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, n, r, unnest(range(1, len(r) - n + 2)) AS k FROM p, o WHERE len(r) >= n) GROUP BY ALL),
c AS (SELECT p.id, o.n, coalesce(sum(least(hg.c, coalesce(rg.c, 0))), 0)::DOUBLE AS m, greatest(1, coalesce(sum(hg.c), 0))::DOUBLE AS l FROM p CROSS JOIN o LEFT JOIN hg ON hg.id = p.id AND hg.n = o.n LEFT JOIN rg ON rg.id = hg.id AND rg.n = hg.n AND rg.g = hg.g GROUP BY 1, 2),
z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS zeros, max(CASE WHEN n = 1 THEN m END) OVER (PARTITION BY id) AS first FROM c),
s AS (SELECT id, method, sum(ln(CASE WHEN method = 2 THEN (m + 1) / (l + 1) WHEN m > 0 THEN m / l WHEN method = 1 THEN 0.1::DOUBLE / l ELSE 1 / (2 ** zeros * l) END)) / 4 AS e, max(first) AS first FROM z, (SELECT unnest([1, 2, 3]) AS method) GROUP BY 1, 2)
SELECT s.id, method, round(CASE WHEN first = 0 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r)::DOUBLE / len(h)) END * exp(e) END, 8) AS bleu FROM s JOIN p ON p.id = s.id""")
def sentence_bleu_methods(spark, d):
    """BLEU of each text against its reference by three ways of smoothing."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ref"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("hyp")).join(b, "id").select("id", "ref", "hyp", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("method"))
    return _python_rows(rows, lambda i, r, h, m: (i, m, round(similarity.sentence_bleu([r.split(" ")], h.split(" "), method=m), 8)), "id long, method int, bleu double")


_SMOOTHED = """WITH b AS (SELECT p_partkey, p_size % 5 AS h1, p_size % 3 AS h2, p_size % 2 AS h3, 0 AS h4, 8::DOUBLE AS l1, 7::DOUBLE AS l2, 6::DOUBLE AS l3, 5::DOUBLE AS l4, p_size + 2 AS n FROM part),
p AS (SELECT *, h1 / l1 AS p1, h2 / l2 AS p2, h3 / l3 AS p3, h4 / l4 AS p4 FROM b),
f AS (SELECT *, CASE WHEN p1 = 0 THEN (0 + 5 / ln(n)) / l1 ELSE p1 END AS q1, CASE WHEN p2 = 0 THEN (1 + 5 / ln(n)) / l2 ELSE p2 END AS q2, CASE WHEN p3 = 0 THEN (2 + 5 / ln(n)) / l3 ELSE p3 END AS q3, CASE WHEN p4 = 0 THEN (3 + 5 / ln(n)) / l4 ELSE p4 END AS q4,
  CAST(p1 = 0 AS INT) AS z1, CAST(p1 = 0 AS INT) + CAST(p2 = 0 AS INT) AS z2, CAST(p1 = 0 AS INT) + CAST(p2 = 0 AS INT) + CAST(p3 = 0 AS INT) AS z3, CAST(p1 = 0 AS INT) + CAST(p2 = 0 AS INT) + CAST(p3 = 0 AS INT) + 1 AS z4 FROM p),
g AS (SELECT *, (p1 + 1 + p1 + p2) / 3 AS a1, (q1 + 1 + q1 + q2) / 3 AS c1, (h3 + 5 * CASE WHEN p1 = 0 THEN 0 ELSE p2 * p2 / p1 END) / (l3 + 5) AS s3 FROM f),
h AS (SELECT *, (a1 + p2 + p3) / 3 AS a2, (c1 + q2 + q3) / 3 AS c2, (h4 + 5 * CASE WHEN p2 = 0 THEN 0 ELSE s3 * s3 / p2 END) / (l4 + 5) AS s4 FROM g),
i AS (SELECT *, (a2 + p3 + p4) / 3 AS a3, (c2 + q3 + q4) / 3 AS c3 FROM h), j AS (SELECT *, (a3 + p4 + 0.25::DOUBLE) / 3 AS a4, (c3 + q4 + 0.25::DOUBLE) / 3 AS c4 FROM i),
m AS (SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS method, unnest([[p1, p2, p3, p4], [CASE WHEN p1 = 0 THEN 0.1 / l1 ELSE p1 END, CASE WHEN p2 = 0 THEN 0.1 / l2 ELSE p2 END, CASE WHEN p3 = 0 THEN 0.1 / l3 ELSE p3 END, CASE WHEN p4 = 0 THEN 0.1 / l4 ELSE p4 END],
  [(h1 + 1) / (l1 + 1), (h2 + 1) / (l2 + 1), (h3 + 1) / (l3 + 1), (h4 + 1) / (l4 + 1)], [CASE WHEN p1 = 0 THEN 1 / (2 ** z1 * l1) ELSE p1 END, CASE WHEN p2 = 0 THEN 1 / (2 ** z2 * l2) ELSE p2 END, CASE WHEN p3 = 0 THEN 1 / (2 ** z3 * l3) ELSE p3 END, CASE WHEN p4 = 0 THEN 1 / (2 ** z4 * l4) ELSE p4 END],
  [q1, q2, q3, q4], [a1, a2, a3, a4], [p1, p2, s3, s4], [c1, c2, c3, c4]]) AS p FROM j)
SELECT p_partkey, method, list_transform(p, lambda x: round(x, 8)) AS p FROM m"""


@query(_SMOOTHED)
def smoothing_methods(spark, d):
    """Precisions of four orders smoothed by all methods."""
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("method"))
    return _python_rows(rows, lambda k, s, m: (k, m, [round(x, 8) for x in similarity.smooth([s % 5, s % 3, s % 2, 0], [8, 7, 6, 5], m, s + 2, (1, 4))]), "p_partkey long, method int, p array<double>")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS syntax, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS flow FROM part")
def code_matches(spark, d):
    """Shares of subtrees and of data flow that two pieces of code have in common."""
    rows = table(spark, d, "part").select("p_partkey", "p_size")

    def one(key, size):
        # trees: Module(Expr(Call)), Expr(Call), Call, and Module(Assign(...)), Assign(...): names and values don't count
        syntax = similarity.syntax_match(f"f(x={size})", f"g(y={size + 1})" if size % 2 == 0 else "x = g(y=1)")
        flow = similarity.data_flow_match("a = b\nc = a", f"x{size} = y\nz = x{size}" if size % 3 == 0 else f"x{size} = y\nz = 1")
        return key, syntax, flow

    return _python_rows(rows, one, "p_partkey long, syntax double, flow double")
