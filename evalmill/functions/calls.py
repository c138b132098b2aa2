"""Parsing and checking of function calls; Python, since nested literals have no native form.

``parse_python`` reads calls as data: nothing is evaluated but arithmetic of
constants.  Values keep Python's types; ``canon`` is their JSON with sorted keys.
"""

from __future__ import annotations

import ast
import json
import operator
import re
from typing import Any

from evalmill.functions.java_values import java_value

_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _value(node: ast.AST) -> Any:
    match node:
        case ast.Constant():
            return "..." if node.value is ... else node.value
        case ast.UnaryOp(op=ast.USub()):
            return -_value(node.operand)
        case ast.List():
            return [_value(x) for x in node.elts]
        case ast.Tuple():
            return tuple(_value(x) for x in node.elts)
        case ast.Dict():
            return {_value(k): _value(v) for k, v in zip(node.keys, node.values, strict=True)}
        case ast.BinOp() if type(node.op) in _ARITHMETIC:
            a, b = _value(node.left), _value(node.right)
            if not all(isinstance(x, int | float) for x in (a, b)):
                raise ValueError("arithmetic of constants only")
            return _ARITHMETIC[type(node.op)](a, b)
        case ast.Call():
            return _call(node) if node.keywords else ast.unparse(node)
        case ast.Name():
            return node.id
        case ast.Attribute():
            return _name(node)
        case ast.Subscript() | ast.Lambda():
            return ast.unparse(node)
    raise ValueError(f"not a literal: {type(node).__name__}")


def _call(node: ast.Call) -> dict[str, dict[str, Any]]:
    return {_name(node.func): {k.arg: _value(k.value) for k in node.keywords}}


def parse_python(text: str) -> list[dict[str, dict[str, Any]]]:
    """Calls with keyword arguments; positional ones are left out.  Fences, brackets and spaces around are optional."""
    text = text.strip("`\n ")
    if not text.startswith("["):
        text = "[" + text
    if not text.endswith("]"):
        text += "]"
    body = ast.parse(text.strip("'"), mode="eval").body
    nodes = [body] if isinstance(body, ast.Call) else body.elts
    if not all(isinstance(n, ast.Call) for n in nodes):
        raise ValueError("not a list of calls")
    return [_call(n) for n in nodes]


def parse_json(text: str) -> list[dict[str, Any]]:
    """``{function, parameters}`` or ``{name, arguments}`` objects of the first list; none if it isn't JSON."""
    m = re.search(r"\[.*\]", text, re.DOTALL)
    try:
        found = json.loads(m[0]) if m else []
    except ValueError:
        return []
    out = []
    for x in found:
        name = x.get("function", x.get("name"))
        out.append({name: x.get("parameters", x.get("arguments", {}))})
    return out


def parse_xml(text: str) -> list[dict[str, Any]]:
    """``<function name=..><param name=.. value=.. type=../></function>``, values typed."""
    import xml.etree.ElementTree as E

    m = re.search(r"<functions>.*</functions>", text, re.DOTALL)
    root = E.fromstring(m[0] if m else f"<functions>{text}</functions>")
    out = []
    for f in root.iter("function"):
        params = {p.get("name"): typed(p.get("value") if p.get("value") is not None else (p.text or ""), p.get("type", "string")) for p in f.iter() if p.tag in ("param", "parameter")}
        out.append({f.get("name"): params})
    return out


def parse_tagged(text: str) -> list[dict[str, Any]]:
    """JSON objects between tool-call tags; those that aren't JSON are skipped."""
    out = []
    for body in re.findall(r"<tool_call>\s*(.*?)\s*</tool_call>", text, re.DOTALL):
        try:
            x = json.loads(body)
        except ValueError:
            continue
        out.append({x["name"]: x.get("arguments", {})})
    return out


def parse_two_lines(text: str) -> list[Any]:
    """A name, then its arguments as JSON."""
    head, _, rest = text.strip().partition("\n")
    return [{head.strip(): json.loads(rest)}] if rest.strip() else [head]


DECODERS = {"python": parse_python, "json": parse_json, "xml": parse_xml, "tagged": parse_tagged, "two_lines": parse_two_lines}


def typed(value: str, kind: str) -> Any:
    """A best-effort cast; the text itself where it can't be."""
    try:
        match kind:
            case "integer" | "int":
                return int(value)
            case "float" | "number" | "double":
                return float(value)
            case "boolean" | "bool":
                return {"true": True, "false": False}[value.strip().lower()]
            case "array" | "list" | "dict" | "object":
                return json.loads(value)
    except (ValueError, KeyError):
        return value
    return value


def js_value(text: str, kind: str) -> Any:
    """A JavaScript literal as a Python value; the text itself where the form doesn't fit."""
    s = text.strip()
    match kind:
        case "String":
            return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"`" else text
        case "integer":
            return int(s) if re.fullmatch(r"-?\d+", s) else text
        case "float":
            return float(s) if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", s) else text
        case "Bigint":
            return int(s[:-1]) if re.fullmatch(r"-?\d+n", s) else text
        case "Boolean":
            return {"true": True, "false": False}.get(s, text)
        case "array" | "dict":
            s = re.sub(r"^new\s+Array\((.*)\)$", r"[\1]", s, flags=re.DOTALL)
            try:
                return _js_literal(s)
            except (ValueError, SyntaxError):
                return text
    return text


def _js_literal(s: str) -> Any:
    """Lists and objects as Python literals: bare keys quoted, words of JavaScript replaced outside of strings."""
    out, at = [], 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", s):
        out += [_js_words(s[at : m.start()]), m[0]]
        at = m.end()
    return ast.literal_eval("".join([*out, _js_words(s[at:])]))


def _js_words(s: str) -> str:
    s = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', s)
    return re.sub(r"\b(true|false|null|undefined)\b", lambda m: {"true": "True", "false": "False"}.get(m[1], "None"), s)


def standardize(text: str) -> str:
    return re.sub(r"[ ,./\-_*^]", "", text).lower().replace("'", '"')


def is_call_format(calls: Any) -> bool:
    """A list of dicts of one name and its arguments, a dict each."""
    return isinstance(calls, list) and all(isinstance(c, dict) and len(c) == 1 and isinstance(next(iter(c.values())), dict) for c in calls)


def is_empty(calls: Any) -> bool:
    """No calls: not in the form of calls, or none of them."""
    return not is_call_format(calls) or not calls


def is_executable(calls: Any) -> bool:
    """A list of one or more texts."""
    return isinstance(calls, list) and bool(calls) and all(isinstance(c, str) for c in calls)


def canon(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


__all__ = ["DECODERS", "canon", "is_call_format", "is_empty", "is_executable", "java_value", "js_value", "parse_json", "parse_python", "parse_tagged", "parse_two_lines", "parse_xml", "standardize", "typed"]
