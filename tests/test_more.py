"""Evaluation, prompts, code texts, ratings and sources on small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill import __main__ as cli
from evalmill.functions import code_text, pages, prompts
from evalmill.functions.java_values import java_value
from evalmill.functions.text import two_digits
from evalmill.operators import battles, evaluation, relational, scoring, similarity
from evalmill.sources import datasets
from evalmill.sources.tables import shared_folder


@pytest.mark.parametrize(("text", "kind", "nested", "value"), [
    ("new ArrayList<>(Arrays.asList(1, \"a, b\", true, 2L, 1.5f))", "ArrayList", None, [1, "a, b", True, 2, 1.5]),
    ('new ArrayList<String>() {{ add("x)"); add("y"); }}', "ArrayList", "String", ["x)", "y"]),
    ("new int[][]{{1, 2}, {3}}", "Array", None, [[1, 2], [3]]), ("new ArrayList<>()", "ArrayList", None, []), ("new int[] { }", "Array", None, []),
    ('new HashMap<String, List<Integer>>() {{ put("a", Arrays.asList(1, 2)); put("b", new int[]{3}); }}', "HashMap", None, {"a": [1, 2], "b": [3]}),
    ("new HashMap<>()", "HashMap", None, {}), ("new ArrayList<>(", "ArrayList", None, "new ArrayList<>("), ("new int[]{1}", "ArrayList", None, "new int[]{1}"),
    ("7", "integer", None, 7), ("7L", "long", None, 7), ("7", "long", None, "7"), ("3e3F", "float", None, 3000.0), ("'c'", "char", None, "c"), ("yes", "boolean", None, "yes"), ("new char[]{'a', 'b'}", "Array", "char", ["a", "b"]),
])
def test_java_values(text, kind, nested, value):
    assert java_value(text, kind, nested) == value


def js_fixed(x, up):
    from fractions import Fraction

    hundred = Fraction(x) * 100
    n, rest = divmod(hundred, 1)
    n += rest > Fraction(1, 2) or rest == Fraction(1, 2) and (up or n % 2 == 1)
    return f"{int(n) // 100}.{int(n) % 100:02d}"


def test_two_digits(spark):
    values = [19 / 40, 1 / 8, 3 / 8, 5 / 8, 7 / 8, 0.0, 1.0, 0.005, 0.015, 0.045, 1.005, 2.675, 99.995, 100.0, 12.345, 0.285, 1e-9] + [k / 997 for k in range(0, 997, 13)] + [k / 8 for k in range(0, 800, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for up in (False, True):
        got = [r[0] for r in df.select(two_digits(F.col("v"), up)).collect()]
        assert got == [js_fixed(v, up) for v in values]
        assert up or got == [f"{v:.2f}" for v in values]


def test_code_texts():
    assert code_text.without_python_comments('"""Doc."""\nx = "#" # c\n\ndef f():\n    "inner"\n    return 1\n') == 'x = "#"\ndef f():\n    return 1'
    assert code_text.reference_arguments("load('a', repo_or_dir='r', model=m(1))") == ["'a'", "'r'", "m(1)"]
    assert code_text.reference_arguments("load('a', repo_or_dir='r', model=m)", "hub") == ["'r'", "m"] and code_text.reference_arguments("load(x, model='k')", "model") == ["'k'"] and code_text.reference_arguments("not a call(") == []
    assert code_text.qualified("f(x = g((1, 2), h(3)), y = (4))", {"f": "a", "g": "a", "h": "a"}) == "a.f(x = a.g((1, 2), a.h(3)), y = (4))"
    assert code_text.syntax_errors("x = 1") == 0 and code_text.syntax_errors("x = = 1\ny = 2\nz = = 3") == 2
    assert code_text.type_schema("Union[int, None]") == {"type": "integer"} and code_text.type_schema("Union[int, str]") == {"type": "any"} and code_text.type_schema("Dict[str, List[float]]") == {"type": "dict", "additionalProperties": {"type": "array", "items": {"type": "float"}}} and code_text.type_schema("Tuple[int, str]")["items"] == [{"type": "integer"}, {"type": "string"}]
    assert code_text.dependencies("import os\nimport b, A.x\nfrom .me import y", {"b": "Bee"}) == ["A", "Bee"]
    java = code_text.hinted({"name": "f", "description": "D.", "parameters": {"properties": {"a": {"type": "ArrayList", "description": "A.", "items": {"type": "int"}}, "b": {"type": "any", "description": "B."}}}}, "java")
    assert java["description"].endswith("Java 8 SDK syntax.") and "items" not in java["parameters"]["properties"]["a"] and java["parameters"]["properties"]["b"]["type"] == "string"


def test_weighted_recall():
    hyp, ref = "a b b c".split(), "a b d".split()
    assert code_text.weighted_recall([(ref, {"a": 1.0, "b": 0.5, "d": 0.25})], hyp, 1) == (1.5, 1.75)
    assert code_text.weighted_recall([(ref, {"a": 5.0})], hyp, 1) == (2.0, 3.0) and code_text.weighted_recall([(ref, {}), (["x"], {})], hyp, 2) == (1.0, 3.0)


def test_markdown():
    assert pages.markdown_of("<h1>T</h1><p>a <b>c</b> <a href='u'>l</a></p><ul><li>x<li>y</ul><script>no</script><pre>k  k</pre>") == "# T\n\na **c** [l](u)\n\n* x\n* y\n\n```\nk  k\n```"
    assert pages.text_of("<p>a&amp;b<style>x</style></p>\n <i> c </i>") == "a&b\nc" and pages.markdown_of(None) == ""


def test_prompts(spark):
    one = spark.createDataFrame([("f()", prompts.DEFAULT_CONFIG, "style=none")], "f string, c string, bad string")
    r = one.select(prompts.system_prompt(F.col("f"), F.col("c")).alias("p"), prompts.system_prompt(F.col("f"), F.col("bad")).alias("n"), prompts.config_fields(F.col("bad")).alias("x")).first()
    assert r["p"].startswith("You are an expert in composing functions.You are given") and r["p"].endswith("in json format that you can invoke.\nf()\n") and r["n"] is None and r["x"] is None
    m = spark.createDataFrame([([("user", "a"), ("assistant", None)],)], "m array<struct<role string, content string>>")
    folds = {s: m.select(prompts.chat_fold(F.col("m"), s, F.lit("S"))).first()[0] for s in ("colon_single", "colon_two", "colon_space", "no_colon", "new_line", "dolly", "rwkv", "phoenix")}
    assert folds == {"colon_single": "S\nuser: a\nassistant:", "colon_two": "S\nuser: a\nassistant:", "colon_space": "S\nuser: a\nassistant: ", "no_colon": "Susera\nassistant", "new_line": "S\nuser\na\nassistant\n", "dolly": "Suser:\na\nassistant:\n", "rwkv": "Suser: a\n\nassistant:", "phoenix": "Suser: <s>a</s>assistant: <s>"}
    with pytest.raises(ValueError):
        prompts.expand_categories(["no such"])
    assert len(prompts.expand_categories(["all"])) == 23


def test_evaluation(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, result string")
    with pytest.raises(ValueError):
        evaluation.length_checked(a.limit(1), a.select("id"))
    assert evaluation.length_checked(a.limit(1), a.select("id"), partial=True).count() == 1
    x = spark.createDataFrame([(["a", "b"], ["b", "a", "b"]), (["a", "b"], ["b", "a"]), ([], [])], "w array<string>, f array<string>")
    assert [r[0] for r in x.select(evaluation.in_same_order(F.col("w"), F.col("f"))).collect()] == [True, False, True]
    assert [r[0] for r in x.select(evaluation.never_called(F.array(F.lit("a"), F.lit("c")), F.col("f"))).collect()] == [["c"], ["c"], ["a", "c"]]
    e = spark.createDataFrame([([],), ([""],), (["a"],)], "r array<string>")
    assert [r[0] for r in e.select(evaluation.is_empty_execution(F.col("r"))).collect()] == [True, True, False] and [r[0] for r in e.select(evaluation.is_executable(F.col("r"))).collect()] == [False, True, True]


def test_components_are_the_best(spark):
    rng = np.random.default_rng(4)
    rows = [(f"t{i}", f"t{j}", f"m{k}", f"m{m}", "A is better" if rng.random() < 0.5 + 0.2 * (i - j) else "Tie") for i, j, k, m in rng.integers(0, 3, (200, 4)).tolist()]
    df = spark.createDataFrame(rows, "tool_a string, tool_b string, model_a string, model_b string, rating string")
    got = {(r["kind"], r["name"]): r["rating"] for r in battles.components_mle(df, ("tool", "model")).collect()}
    beta = {k: (v - 1000) / 400 for k, v in got.items()}

    def loss(b):
        total = sum(v * v for v in b.values()) / 2
        for ta, tb, ma, mb, rating in rows:
            z = math.log(10) * (b["tool", ta] - b["tool", tb] + b["model", ma] - b["model", mb])
            total += 2 * math.log1p(math.exp(-z if rating == "A is better" else z))
        return total

    least = loss(beta)
    assert len(beta) == 6 and all(loss(beta | {k: v + s}) > least for k, v in beta.items() for s in (1e-3, -1e-3))


def test_latency_percentile_and_bleu(spark):
    v = [0.0, 1.0, 1.0, 2.0, 5.0, 7.5, 7.5, 9.0]
    r = scoring.latency_stats(spark.createDataFrame([("k", x) for x in v], "k string, v double"), "k", "v").first()
    assert math.isclose(r["p95"], np.quantile(v[1:], 0.95)) and math.isclose(r["mean"], np.mean(v[1:]))
    pairs = spark.createDataFrame([(1, "a b a c".split(), "a b c".split()), (2, [], ["x"])], "id long, hyp array<string>, ref array<string>")
    assert {tuple(r) for r in similarity.clipped_orders(pairs, "id", 2).collect()} == {(1, 1, 3, 4), (1, 2, 1, 3)}


def test_long_chains_have_all_levels(spark):
    n = 70
    nodes, edges = spark.range(n).select("id"), spark.range(1, n).select("id", (F.col("id") - 1).alias("depends_on"))
    assert sorted(r["level"] for r in relational.dag_levels(nodes, edges).collect()) == list(range(n))


def test_dump_and_described(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- a dump\nCREATE TABLE `students` (\n  `id` int NOT NULL,\n  `name` varchar(9),\n  PRIMARY KEY (`id`)\n) ENGINE=X;\n/*!1 x */;\nINSERT INTO `students` VALUES (1,'A; (b)'),(2,NULL),(3,'it''s');\n")
    t = datasets.read_dump(spark, str(tmp_path / "d.sql"))
    assert [tuple(r) for r in t["students"].collect()] == [("1", "A; (b)"), ("2", None), ("3", "it's")]
    assert datasets.described(t) == "Table: students\n  id (string)\n  name (string)"


def test_evaluate_from_files(spark, tmp_path, capsys):
    fn = {"name": "f", "description": "F.", "parameters": json.dumps({"type": "dict", "properties": {"x": {"type": "integer", "description": "X."}}, "required": ["x"]})}
    for name in ("tests", "truth", "results/org_m/non_live"):
        (tmp_path / name).mkdir(parents=True)
    write = lambda p, rows: (tmp_path / p).write_text("\n".join(map(json.dumps, rows)))
    write("tests/V_simple_python.json", [{"id": f"simple_python_{k}", "question": [[{"role": "user", "content": "q"}]], "function": [fn]} for k in range(3)])
    write("tests/V_irrelevance.json", [{"id": "irrelevance_0", "question": [], "function": [fn]}])
    write("truth/V_simple_python.json", [{"id": f"simple_python_{k}", "ground_truth": [{"f": {"x": [1]}}]} for k in range(3)])
    write("results/org_m/non_live/V_simple_python_result.json", [{"id": f"simple_python_{k}", "model": "m", "result": r} for k, r in enumerate(("[f(x=1)]", "[f(x=2)]", "no"))])
    write("results/org_m/non_live/V_irrelevance_result.json", [{"id": "irrelevance_0", "model": "m", "result": "no call"}])
    tests = datasets.load_tests(spark, str(tmp_path / "tests"), ["simple_python"])
    assert tests.count() == 3 and "Python 3 syntax" in tests.first()["functions"]
    cli.main(["version"])
    cli.main(["test-categories"])
    assert "memory_kv" in capsys.readouterr().out
    cli.evaluate(str(tmp_path / "results"), str(tmp_path / "tests"), str(tmp_path / "truth"), str(tmp_path / "out"), ["simple_python", "irrelevance"], False)
    board = spark.read.option("header", True).csv(str(tmp_path / "out/boards/non_live")).collect()
    assert [(r["model"], round(float(r["accuracy"]), 4)) for r in board] == [("m", 0.6667)]
    lines = {(r["category"], r["value"]) for r in spark.read.text(str(tmp_path / "out/scores")).collect()}
    assert {(c, json.loads(v).get("total_count"), json.loads(v).get("error_type")) for c, v in lines} == {("simple_python", 3, None), ("irrelevance", 1, None), ("simple_python", None, "value_error:others"), ("simple_python", None, "ast_decoder:decoder_failed")}
    assert shared_folder(spark)


def test_sqlite_and_retries(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INT, name TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"n{k}") for k in range(25)])
    got = datasets.read_sqlite(spark, path, "SELECT id, name FROM t WHERE id > 4", "id long, name string", rows=7)
    assert got.count() == 20 and got.filter("id = 5").first()["name"] == "n5"
    waits, fails = [], iter([True, True, False])

    def shaky():
        if next(fails):
            raise OSError("not now")
        return "done"

    assert datasets.retried(shaky, 3, 1.0, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    fails = iter([True] * 9)
    with pytest.raises(OSError):
        datasets.retried(shaky, 2, sleep=waits.append)


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        relational.only(spark.range(3), ["id", "none"])
    with pytest.raises(ValueError):
        datasets.export(spark.range(3), "x", "no shape")
