import json

import pytest

from evalmill.functions import schemas as S
from evalmill.functions import source_calls as P

FN = {"name": "geo.area", "description": "Area.", "parameters": {"type": "dict", "properties": {"side": {"type": "float", "description": "Length."}, "unit": {"type": "string", "description": "Unit.", "enum": ["m", "km"], "default": "m"}, "tags": {"type": "array", "items": {"type": "dict", "properties": {"k": {"type": "any", "description": "K."}}}, "description": "Tags.", "default": []}}, "required": ["side"]}}


def test_java_and_javascript_calls():
    assert P.parse_java('Geo.area(a="x, y", b=new HashMap<String, Integer>() {{ put("k", 1); }}, c=new int[]{1, 2}, d=5L, ctx, "dropped")') == [{"Geo.area": {"a": "x, y", "b": 'new HashMap<String, Integer>() {{ put("k", 1); }}', "c": "new int[]{1, 2}", "d": "5L", None: "ctx"}}]
    assert P.parse_javascript("f(a='b=c', g=(x) => x + 1, o={k: [1, 2]}, t=true);") == [{"f": {"a": "b=c", "g": "(x) => x + 1", "o": "{k: [1, 2]}", "t": "true"}}]
    for bad in ("f(a=1, a=2)", "f(a=(1)", "f", 'f(a="x)', "f(a=])"):
        with pytest.raises(ValueError):
            P.parse_java(bad)
    doc = [{"name": "f", "parameters": {"properties": {"n": {"type": "long"}, "l": {"type": "ArrayList", "items": {"type": "integer"}}}}}]
    assert P.typed_source(P.parse_java("f(n=5L, l=new ArrayList<>(Arrays.asList(1, 2)), z=q)"), doc, "java") == [{"f": {"n": 5, "l": [1, 2], "z": "q"}}]


def test_other_decoders():
    assert P.parse_braces("<start_function_call>call:f{a:<escape>x{,}<escape>,b:[1,2.5,{c:null}],d:true,e:word}<end_function_call><start_function_call>call:g<end_function_call>") == [{"f": {"a": "x{,}", "b": [1, 2.5, {"c": None}], "d": True, "e": "word"}}, {"g": {}}]
    assert P.parse_tail('ok <tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>') == [{"f": {"a": 1}}]
    assert P.parse_tail("<|tool_call|>[oops") == ["[oops"]
    assert P.parse_upper_tag("x <TOOLCALL>[f(a=1)]</TOOLCALL>") == [{"f": {"a": 1}}] and P.parse_upper_tag("x") == []
    assert P.parse_python_tag('<|python_tag|>{"name": "f", "parameters": {}}; {"name": "g", "parameters": {"a": 1}}') == [{"f": {}}, {"g": {"a": 1}}]
    assert P.parse_function_split("text <<function>>f(a=1)<<function>>g(b='x')") == [{"f": {"a": 1}}, {"g": {"b": "x"}}]
    assert P.decode("java", None)[1] and P.decode("java", "")[1] and P.decode("none", "x")[1]
    assert P.rendered([{"f": '{"a": "x"}'}, {"g": {}}]) == ["f(a='x')", "g()"]


def test_tools():
    t = S.tools([FN], "completions")[0]
    assert t["type"] == "function" and t["function"]["name"] == "geo_area"
    props = t["function"]["parameters"]["properties"]
    assert props["side"] == {"type": "number", "format": "float", "description": "Length. This is a float type value."}
    assert props["tags"]["items"] == {"type": "object", "properties": {"k": {"type": "string", "description": "K."}}}
    assert "input_schema" in S.tools([FN], "anthropic")[0] and "json" in S.tools([FN], "amazon")[0]["toolSpec"]["inputSchema"]
    w = S.tools([FN], "writer")[0]["function"]
    assert w["name"] == "geo.area" and w["parameters"]["properties"]["unit"] == {"type": "string", "description": "Unit. Default is: m. Enum values: ['m', 'km']."}
    assert "enum" in S.tools([FN], "google")[0]["parameters"]["properties"]["unit"]
    assert FN["parameters"]["properties"]["side"]["type"] == "float"


def test_renderers():
    assert '    <param name="unit" type="string" required="false" default="\'m\'">' in S.as_xml([FN]).replace("        <param", "    <param")
    assert "        tags (list[dict], default=[]): Tags.\n" in S.as_python([FN])
    assert json.loads(S.as_json([FN])) == [FN]


def test_problems():
    assert S.problems(FN) == []
    bad = json.loads(json.dumps(FN))
    bad["parameters"]["properties"]["class"] = {"type": "integer", "description": "", "default": "x"}
    bad["parameters"]["required"].append("nope")
    assert S.problems(bad) == ["class: a keyword", "class: the default is of another type", "required: nope is unknown"]
    assert S.problems([]) and S.problems({}) and S.problems({**FN, "more": 1}) == ["description: other keys"]
    assert S.without_keywords({"in": 1, "a": 2}) == {"_in": 1, "a": 2}
