"""Calls written in Java, JavaScript or tagged forms, as data; nothing is run."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from typing import Any

from evalmill.functions import calls as C

_STRING = r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`'
_GENERIC = r"(?<=\w)<[\w\s,.?\[\]<>]*>(?=\s*[(\[{])"
_TOKEN = re.compile(f"(?P<skip>{_STRING}|{_GENERIC})|(?P<open>[(\\[{{])|(?P<close>[)\\]}}])|(?P<comma>,)|(?P<equal>(?<![=!<>])=(?![=>]))", re.DOTALL)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _marks(text: str) -> Iterator[tuple[str, int]]:
    """(kind, position) of commas, equal signs and the last bracket outside of strings, generics and brackets."""
    stack: list[str] = []
    for m in _TOKEN.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind == "open":
            stack.append(_PAIRS[m[0]])
        elif kind == "close":
            if not stack or stack.pop() != m[0]:
                raise ValueError("brackets don't match")
        elif kind != "skip" and not stack:
            yield kind, at
    if stack or len(re.findall(r'"', re.sub(_STRING, "", text))):
        raise ValueError("brackets or quotes don't match")


def split_arguments(text: str) -> list[tuple[str | None, str]]:
    """(name or None, value) of each argument at the top level."""
    out, start, equal = [], 0, None
    for kind, at in [*_marks(text), ("comma", len(text))]:
        if kind == "equal":
            equal = at if equal is None else equal
            continue
        name, value = (None, text[start:at]) if equal is None else (text[start:equal].strip(), text[equal + 1 : at])
        if value.strip():
            out.append((name, value.strip()))
        start, equal = at + 1, None
    return out


def _source_call(text: str, quotes: str, positional: str) -> list[dict[str, dict[Any, str]]]:
    m = re.fullmatch(r"\s*(?:new\s+)?([\w.$]+)\s*\((.*)\)\s*;?\s*", text, re.DOTALL)
    if not m:
        raise ValueError("not a call")
    args: dict[Any, str] = {}
    for name, value in split_arguments(m[2]):
        if name is None and not re.fullmatch(positional, value):
            continue
        if name in args:
            raise ValueError("an argument is given twice")
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in quotes and re.fullmatch(_STRING, value, re.DOTALL)
        args[name] = value[1:-1] if name is not None and quoted else value
    return [{m[1]: args}]


def parse_java(text: str) -> list[dict[str, dict[Any, str]]]:
    """Named arguments as source text, strings and characters without quotes; of positional ones only identifiers, under None."""
    return _source_call(text, "\"'", r"[A-Za-z_$][\w$]*(\.class)?")


def parse_javascript(text: str) -> list[dict[str, dict[Any, str]]]:
    return _source_call(text, "\"'", r"(?!false\b|null\b)[A-Za-z_$][\w$]*")


def typed_source(calls: list[dict], docs: list[dict], language: str) -> list[dict]:
    """Arguments' source text converted by the types of the functions' parameters; unknown ones stay text."""
    types = {d["name"]: d["parameters"]["properties"] for d in docs}

    def convert(fn: str, name: str, value: str) -> Any:
        meta = types.get(fn, {}).get(name)
        if meta is None:
            return value
        if language == "java":
            return C.java_value(value, meta["type"], meta.get("items", {}).get("type"))
        return C.js_value(value, meta["type"])

    return [{fn: {k: convert(fn, k, v) for k, v in args.items()}} for call in calls for fn, args in call.items()]


def parse_tail(text: str) -> list[Any]:
    """All after the first tool-call tag as a list of JSON objects; the text itself if it isn't JSON."""
    m = re.search(r"<\|?tool_call\|?>(.*)", text.strip().removeprefix("ASSISTANT:"), re.DOTALL)
    if not m:
        return []
    body = m[1].replace("</tool_call>", "").strip()
    try:
        found = json.loads(body if body.startswith("[") or body.endswith("]") else f"[{body}]")
    except ValueError:
        return [body]
    found = [_literal(x) if isinstance(x, str) else x for x in found]
    return [{x["name"]: x["arguments"]} if isinstance(x, dict) and set(x) == {"name", "arguments"} else x for x in found]


def _literal(text: str) -> Any:
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parse_upper_tag(text: str) -> list[dict]:
    """Calls in Python's syntax in the first TOOLCALL tag; none without one."""
    m = re.search(r"<TOOLCALL>(.*?)</TOOLCALL>", text, re.DOTALL)
    return C.parse_python(m[1]) if m else []


def parse_python_tag(text: str) -> list[dict]:
    """Objects with name and parameters, after a Python tag, apart by semicolons."""
    body = text.replace("<|python_tag|>", "")
    parts = body.split(";") if ";" in body else [body]
    found = [json.loads(p) for p in parts if p.strip()]
    return [{x["name"]: x["parameters"]} for f in found for x in (f if isinstance(f, list) else [f])]


def parse_function_split(text: str) -> list[dict]:
    """Calls in Python's syntax after ``<<function>>`` marks."""
    return [c for part in text.split("<<function>>")[1:] for c in C.parse_python(part.strip())]


class _Braces:
    """Values of the brace grammar: objects, lists, escaped texts and bare words."""

    def __init__(self, text: str, escape: str):
        self.text, self.escape, self.at = text, escape, 0

    def value(self) -> Any:
        self.blank()
        if self.text.startswith(self.escape, self.at):
            end = self.text.index(self.escape, self.at + len(self.escape))
            found = self.text[self.at + len(self.escape) : end]
            self.at = end + len(self.escape)
            return found
        if self.peek() == "{":
            return dict(self.items("}", lambda: (self.key(), self.value())))
        if self.peek() == "[":
            return self.items("]", self.value)
        m = re.compile(r"[^{}\[\],]*").match(self.text, self.at)
        self.at = m.end()
        return bare(m[0].strip())

    def key(self) -> str:
        self.blank()
        m = re.compile(r"([^:{}\[\],]*):").match(self.text, self.at)
        if not m:
            raise ValueError("a key is missing")
        self.at = m.end()
        return m[1].strip().removeprefix(self.escape).removesuffix(self.escape)

    def items(self, end: str, one) -> list:
        out = []
        self.at += 1
        while True:
            self.blank()
            if self.peek() == end:
                self.at += 1
                return out
            if self.peek() == "":
                raise ValueError("brackets don't match")
            out.append(one())
            self.blank()
            if self.peek() == ",":
                self.at += 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def blank(self) -> None:
        while self.peek().isspace():
            self.at += 1


def bare(word: str) -> Any:
    """null, true, false, a number, or the word itself."""
    known = {"null": None, "none": None, "true": True, "false": False}
    if word.lower() in known:
        return known[word.lower()]
    for cast in (int, float):
        try:
            return cast(word)
        except ValueError:
            pass
    return word


def parse_braces(text: str, start: str = "<start_function_call>", end: str = "<end_function_call>", escape: str = "<escape>") -> list[dict]:
    """``call:name{key:value,...}`` between marks; a call without braces has no arguments."""
    out = []
    for body in re.findall(f"{re.escape(start)}(.*?){re.escape(end)}", text, re.DOTALL):
        m = re.match(r"\s*call:([^{\s]+)\s*(\{.*)?", body, re.DOTALL)
        if m:
            out.append({m[1]: _Braces(m[2], escape).value() if m[2] else {}})
    return out


DECODERS = {**C.DECODERS, "java": parse_java, "javascript": parse_javascript, "tail": parse_tail, "upper_tag": parse_upper_tag, "python_tag": parse_python_tag, "function_split": parse_function_split, "braces": parse_braces}


def decode(style: str, text: str | None) -> tuple[list | None, str | None]:
    """(calls, error type); null, unknown styles and what can't be read give an error, never an exception."""
    if text is None or style not in DECODERS:
        return None, "ast_decoder:decoder_failed"
    try:
        return DECODERS[style](text), None
    except Exception:  # noqa: BLE001 - any text may come, and each parser fails in its own way
        return None, "ast_decoder:decoder_failed"


def rendered(calls: list[dict]) -> list[str]:
    """Calls as Python source."""
    return [f"{fn}({','.join(f'{k}={v!r}' for k, v in (json.loads(args) if isinstance(args, str) else args).items())})" for call in calls for fn, args in call.items()]


class Handler:
    """How a model's outputs are read: as calls to compare, and as source to run."""

    def __init__(self, style: str):
        if style not in DECODERS:
            raise ValueError(f"no style {style}")
        self.style = style

    def calls(self, text: str | None) -> list | None:
        return decode(self.style, text)[0]

    def source(self, text: str | None) -> list[str] | None:
        found = self.calls(text)
        return None if found is None else rendered(found)
