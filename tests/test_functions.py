import pytest
from pyspark.sql import functions as F

from evalmill.functions import calls as C
from evalmill.functions.checking import check_call, check_calls
from evalmill.functions import text as X
from evalmill.operators import similarity as S


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col).first()[0]


@pytest.mark.parametrize(("text", "kind", "value"), [("3.14f", "float", 3.14), ("123L", "long", 123), ("new int[]{1, 2, 3}", "Array", [1, 2, 3]), ("new ArrayList<>()", "ArrayList", []), ("new HashMap<>()", "HashMap", {}), ("true", "boolean", True), ("'a'", "char", "a"), ("abc", "integer", "abc"), ('new ArrayList<String>(Arrays.asList("a", "b"))', "ArrayList", ["a", "b"]), ('new HashMap<String, Integer>() {{ put("k", 1); }}', "HashMap", {"k": 1})])
def test_java_value(text, kind, value):
    assert C.java_value(text, kind) == value


@pytest.mark.parametrize(("text", "kind", "value"), [("123n", "Bigint", 123), ("new Array(1, 2, 3)", "array", [1, 2, 3]), ("{'key': true}", "dict", {"key": True}), ("[1, 'two', true]", "array", [1, "two", True]), ("{a: {b: [1, 2]}}", "dict", {"a": {"b": [1, 2]}}), ("[[1, 2], [3]]", "array", [[1, 2], [3]]), ("'x'", "String", "x"), ("f(", "array", "f(")])
def test_js_value(text, kind, value):
    assert C.js_value(text, kind) == value


def test_python_calls():
    assert C.parse_python("```[a.f(x=1, y=-2.5, z=[1, 'b'], w=(1, 2)), g(k={'p': True}, n=3*4)]```") == [{"a.f": {"x": 1, "y": -2.5, "z": [1, "b"], "w": (1, 2)}}, {"g": {"k": {"p": True}, "n": 12}}]
    with pytest.raises((ValueError, SyntaxError)):
        C.parse_python("just words")


def test_other_decoders():
    assert C.parse_json('x [{"function": "f", "parameters": {"a": 1}}] y') == [{"f": {"a": 1}}]
    assert C.parse_json("nothing") == []
    assert C.parse_xml('<function name="f"><param name="a" value="3" type="integer"/></function>') == [{"f": {"a": 3}}]
    assert C.parse_tagged('<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call><tool_call>bad</tool_call>') == [{"f": {"a": 1}}]
    assert C.parse_two_lines('f\n{"a": 1}') == [{"f": {"a": 1}}]


DOC = {"name": "f", "parameters": {"properties": {"a": {"type": "integer"}, "s": {"type": "string"}, "x": {"type": "float"}}, "required": ["a"]}}


@pytest.mark.parametrize(("call", "truth", "ok"), [({"f": {"a": 1}}, {"a": [1], "s": ["", "p"]}, True), ({"f": {"a": True}}, {"a": [1]}, False), ({"f": {"a": 1, "s": "New-York"}}, {"a": [1], "s": ["new york"]}, True), ({"f": {"a": 1}}, {"a": [1], "s": ["p"]}, False), ({"f": {"s": "p"}}, {"a": [1], "s": ["p"]}, False), ({"f": {"a": 1, "x": 2}}, {"a": [1], "x": [2.0]}, True), ({"g": {"a": 1}}, {"a": [1]}, False)])
def test_check_simple(call, truth, ok):
    assert (check_call(DOC, call, {"f": truth}) is None) is ok


def test_parallel_is_greedy():
    truths = [{"f": {"a": [1, 2]}}, {"f": {"a": [1]}}]
    assert not check_calls([DOC], [{"f": {"a": 1}}, {"f": {"a": 2}}], truths, "parallel")[0]
    assert check_calls([DOC], [{"f": {"a": 2}}, {"f": {"a": 1}}], truths, "parallel")[0]


def test_bleu_goldens():
    hyp = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
    refs = [r.split() for r in ("It is a guide to action that ensures that the military will forever heed Party commands", "It is the guiding principle which guarantees the military forces always being under the command of the Party", "It is the practical guide for the army always to heed the directions of the party")]
    assert round(S.sentence_bleu(refs, hyp), 4) == 0.5046
    assert S.sentence_bleu([hyp], hyp) == pytest.approx(1.0)


@pytest.mark.parametrize("method", range(8))
def test_smoothing_is_positive(method):
    p = S.smooth([4, 2, 1, 0], [8, 7, 6, 5], method, 8, (0, 4))
    assert len(p) == 4 and all(x > 0 for x in p[:3])


def test_code_match():
    a = "x = 1\ny = x + 2\n"
    assert S.syntax_match(a, a) == 1 and S.data_flow_match(a, "p = 1\nq = p + 2\n") == 1
    assert S.syntax_match(a, "for i in z: pass") < 1


def test_text_columns(spark):
    assert one(spark, X.final_answer(F.col("t")), t="a <ANSWER>: b <ANSWER>: c") == "c"
    assert one(spark, X.without_last_line(F.col("t")), t="a\nb\nc") == "a\nb"
    assert one(spark, X.code_fence(F.col("t"), "sql"), t="x\n```sql\nSELECT 1\n```") == "SELECT 1\n"
    assert one(spark, X.secret_mask(F.col("t")), t="abcdefgh") == "....efgh"
    assert one(spark, X.human_size(F.length("t")), t="x" * 2048) == "2.00 KB"
    assert one(spark, X.contains_answer(F.col("t"), F.lit("3.5")), t="it is 35, yes")
    assert not one(spark, X.contains_answer(F.col("t"), F.lit("35")), t="it is 351")
    assert one(spark, X.after_reasoning(F.col("t")), t="<think>x</think> y") == "y"
    assert one(spark, X.category_of(F.col("t")), t="live_parallel_3-1-0:cfg") == "live_parallel"
    assert one(spark, X.fixed_chunks(F.col("t"), 2), t="abcde") == ["ab", "cd", "e"]
    assert one(spark, X.fixed_chunks(F.col("t"), 2), t="") == []


def case(kind, value, allowed, items=None, language="python"):
    doc = {"name": "a.f", "parameters": {"properties": {"x": {"type": kind} | ({"items": {"type": items}} if items else {})}, "required": []}}
    return check_call(doc, {"a.f": {"x": value}}, {"a.f": {"x": allowed}}, language)


@pytest.mark.parametrize(("args", "error"), [
    (("string", "New York", ["new-york"]), None), (("string", "x", ["y"]), "value_error:string"), (("string", 1, ["y"]), "type_error:simple"), (("integer", True, [1]), "type_error:simple"), (("integer", 1, [1, ""]), None), (("float", 1, [1.0]), None), (("integer", 1.0, [1]), "type_error:simple"),
    (("integer", "n", ["n"]), None), (("integer", "N", ["n"]), "value_error:others"), (("boolean", False, [True]), "value_error:others"), (("array", [1, 2], [[1, 2]], "integer"), None), (("array", [1, "2"], [[1, 2]], "integer"), "type_error:nested"), (("array", ["A b"], [["ab"]], "string"), None),
    (("array", ["b"], [["ab"]], "string"), "value_error:list/tuple"), (("array", [], ["", [1]], "integer"), None), (("array", (1, 2), [[1, 2]], "integer"), "type_error:simple"), (("tuple", (1, 2), [[1, 2]], "integer"), None),
    (("dict", {"k": "A"}, [{"k": ["a"], "o": ["", 1]}]), None), (("dict", {"q": 1}, [{"k": ["a", ""]}]), "value_error:dict_key"), (("dict", {"k": "b"}, [{"k": ["a"]}]), "value_error:dict_value"), (("dict", {}, [{"k": ["a"]}]), "value_error:dict_key"), (("dict", {"k": "b"}, [{"k": ["a"]}, {"k": ["b"]}]), None),
    (("array", [{"k": 1}], [[{"k": [1]}]], "dict"), None), (("array", [{"k": 1}, {"k": 2}], [[{"k": [1]}]], "dict"), "value_error:list_dict_count"), (("array", [{"k": 2}], [[{"k": [1]}]], "dict"), "value_error:dict_value"),
    (("ArrayList", "new ArrayList<>(Arrays.asList(1, 2))", [[1, 2]], "integer", "java"), None), (("integer", "7", [7], None, "java"), None), (("integer", 7, [7], None, "java"), "type_error:java"), (("dict", "{a: 1}", [{"a": [1]}], None, "javascript"), None), (("Boolean", 1, [True], None, "javascript"), "type_error:js"),
])
def test_arguments_are_checked(args, error):
    assert case(*args) == error


def test_calls_are_checked():
    docs = [{"name": n, "parameters": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}} for n in ("a.f", "g")]
    f, g = {"a.f": {"x": 1}}, {"g": {"x": 2}}
    truths = [{"a.f": {"x": [1]}}, {"g": {"x": [2]}}]
    assert check_calls(docs, [g, f], truths, "parallel_multiple") == (True, None) and check_calls(docs, [f, g], truths, "parallel", ordered=True) == (True, None)
    assert check_calls(docs, [g, f], truths, "parallel", ordered=True)[1] == "simple_function_checker:wrong_func_name" and check_calls(docs, [f], truths, "parallel", ordered=True)[1] == "parallel_function_checker_enforce_order:wrong_count"
    assert check_calls(docs, [f, f], truths, "parallel")[1] == "parallel_function_checker_no_order:cannot_find_match" and check_calls(docs, [f], truths, "parallel")[1] == "parallel_function_checker_no_order:wrong_count"
    assert check_calls(docs, [g], truths[1:], "multiple") == (True, None) and check_calls(docs, [g, g], truths[1:], "multiple")[1] == "multiple_function_checker:wrong_count" and check_calls(docs, [], truths[:1], "simple_python")[1] == "simple_function_checker:wrong_count"
    assert check_calls(docs, [{"a_f": {"x": 1}}], truths[:1], "simple_python", dots=False) == (True, None) and check_calls(docs, [{"a_f": {"x": 1}}], truths[:1], "simple_python")[1] == "simple_function_checker:wrong_func_name"
    assert check_calls(docs, ["a.f(x=1)"], truths[:1], "simple_python")[1] == "ast_decoder:decoder_wrong_output_format"
    assert check_calls(docs, [{"a.f": {}}], truths[:1], "simple_python")[1] == "simple_function_checker:missing_required" and check_calls(docs, [{"a.f": {"x": 1, "y": 2}}], truths[:1], "simple_python")[1] == "simple_function_checker:unexpected_param"
    assert check_calls(docs, [f], [{"a.f": {"x": [1], "z": ["needed"]}}], "simple_python")[1] == "simple_function_checker:missing_optional"
