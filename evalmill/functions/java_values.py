"""Java literals, arrays, lists and maps as Python values, by a reader of tokens.

A value is ``new T[] {...}``, a constructor with arguments and an initialiser
block, a factory call such as ``Arrays.asList(...)``, a block of items, or a
scalar.  Commas and brackets in strings and inner collections are no problem.
"""

from __future__ import annotations

import re
from typing import Any

_TOKEN = re.compile(r"""\s*(?P<token>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[()\[\]{}<>,;]|[^\s()\[\]{}<>,;"']+)""", re.DOTALL)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_WHOLE, _LONG = re.compile(r"-?\d+"), re.compile(r"-?\d+[lL]")
_DOUBLE, _FLOAT = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[fF]")


class Unreadable(ValueError):
    pass


class Source(str):
    """A scalar as it is written."""


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while m := _TOKEN.match(text, at):
            self.tokens.append(m["token"])
            at = m.end()
        if text[at:].strip():
            raise Unreadable(text)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise Unreadable(token)
        self.at += 1
        return token

    def skip_generics(self) -> None:
        if self.peek() == "<":
            depth = 0
            while True:
                depth += {"<": 1, ">": -1}.get(self.take(), 0)
                if not depth:
                    return

    def items(self, close: str) -> list:
        """Values with commas between, up to the closing bracket."""
        out = []
        while self.peek() != close:
            out.append(self.value())
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return out

    def statements(self) -> list[tuple[str, list]]:
        """(method, arguments) of the calls of an initialiser block, its braces single or double."""
        out, depth = [], 0
        while self.peek() == "{":
            self.take()
            depth += 1
        while self.peek() != "}":
            name = self.take().rsplit(".", 1)[-1]
            self.take("(")
            out.append((name, self.items(")")))
            while self.peek() == ";":
                self.take()
        for _ in range(depth):
            self.take("}")
        return out

    def made(self) -> Any:
        """What follows ``new``."""
        kind = self.take().rsplit(".", 1)[-1]
        self.skip_generics()
        if self.peek() == "[":
            while self.peek() == "[":
                self.take()
                self.take("]")
            self.take("{")
            return "array", self.items("}")
        self.take("(")
        given = self.items(")")
        calls = self.statements() if self.peek() == "{" else []
        if kind.endswith("Map"):
            return kind, {plain(c[1][0]): c[1][1] for c in calls if c[0] == "put" and len(c[1]) == 2}
        held = list(given[0][1]) if len(given) == 1 and isinstance(given[0], tuple) and isinstance(given[0][1], list) else []
        return kind, held + [c[1][0] for c in calls if c[0] == "add" and len(c[1]) == 1]

    def value(self) -> Any:
        token = self.take()
        if token == "new":
            return self.made()
        if token == "{":
            return "array", self.items("}")
        if token in ")]}>,;":
            raise Unreadable(token)
        if self.peek() == "(" and token.rsplit(".", 1)[-1] in ("asList", "of"):
            self.take("(")
            return "factory", self.items(")")
        parts = [token]
        while self.peek() and self.peek() not in ",)]}":
            parts.append(self.take())
        return Source(" ".join(parts))


def plain(value: Any) -> Any:
    """A scalar by its form; collections with all they hold."""
    if isinstance(value, tuple):
        return plain(value[1])
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if value in ("true", "false"):
        return value == "true"
    if len(value) > 1 and value[0] == value[-1] == '"':
        return value[1:-1]
    for form, cast in ((_LONG, lambda x: int(x[:-1])), (_FLOAT, lambda x: float(x[:-1])), (_WHOLE, int), (_DOUBLE, float)):
        if form.fullmatch(value):
            return cast(value)
    return str(value)


def scalar(text: str, kind: str) -> Any:
    """A scalar of a stated type; the text itself where the form doesn't fit."""
    s = text.strip()
    if kind in ("byte", "short", "integer"):
        return int(s) if _WHOLE.fullmatch(s) else text
    if kind == "long":
        return int(s[:-1]) if _LONG.fullmatch(s) else text
    if kind == "float":
        return float(s[:-1]) if _FLOAT.fullmatch(s) else text
    if kind == "double":
        return float(s) if _DOUBLE.fullmatch(s) else text
    if kind == "boolean":
        return {"true": True, "false": False}.get(s, text)
    if kind == "char":
        return s[1:-1] if len(s) == 3 and s[0] == s[2] == "'" else text
    return text


def item(value: Any, kind: str | None) -> Any:
    """An element of a collection, of a stated type or by its form."""
    if kind is None or not isinstance(value, Source):
        return plain(value)
    if kind in ("String", "any"):
        return value.strip('"')
    return scalar(value, kind)


#: The constructors that a declared type takes.
_FITS = {"Array": ("array",), "ArrayList": ("ArrayList",), "HashMap": ("HashMap",)}


def java_value(text: str, kind: str, nested: str | None = None) -> Any:
    """A Java literal as a Python value; the text itself where the form doesn't fit the type."""
    if kind not in _FITS:
        return scalar(text, kind)
    try:
        reader = _Reader(text)
        found = reader.value()
    except Unreadable:
        return text
    if not isinstance(found, tuple) or found[0] not in _FITS[kind]:
        return text
    if isinstance(found[1], dict):
        return {k: item(v, nested) for k, v in found[1].items()}
    return [item(v, nested) for v in found[1]]
