"""Source code as text: comments, calls in answers, descriptions of functions, dependencies."""

from __future__ import annotations

import ast
import io
import re
import sys
import tokenize
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(text: str) -> str:
    return "\n".join(line for line in text.split("\n") if line.strip())


def without_python_comments(source: str) -> str:
    """Python without comments and without texts that stand alone as statements; blank lines go."""
    lines = source.split("\n")
    drop: list[tuple[tuple[int, int], tuple[int, int]]] = []
    fresh = True  # at the start of a statement
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.COMMENT or t.type == tokenize.STRING and fresh:
            drop.append((t.start, t.end))
        if t.type not in (tokenize.COMMENT, tokenize.NL):
            fresh = t.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING)
    for (a, x), (b, y) in reversed(drop):
        lines[a - 1 : b] = [lines[a - 1][:x] + lines[b - 1][y:]]
    return _filled("\n".join(line.rstrip() for line in lines))


def without_c_comments(c: Column) -> Column:
    """Text of languages with // and /* */, each comment a space, texts in quotes untouched; blank lines go."""
    kept = F.regexp_replace(c, r"""(?s)("(?:\\.|[^\\"])*"|'(?:\\.|[^\\'])*')|//[^\n]*|/\*.*?\*/""", "$1 ")
    kept = F.regexp_replace(kept, r"""(?s)("(?:\\.|[^\\"])*"|'(?:\\.|[^\\'])*') """, "$1")
    return F.array_join(F.filter(F.split(kept, "\n"), lambda x: F.trim(x) != ""), "\n")


def api_call_slice(c: Column) -> Column:
    """The call in an answer: between ``api_call`` and ``api_provider`` from two places after the first colon to the last bracket; the whole answer without the first mark."""
    body = F.split(F.get(F.split(c, "api_call"), 1), "api_provider")[0]
    start = F.when(body.contains(":"), F.locate(":", body) - 1).otherwise(0)
    last = F.length(body) - F.locate(")", F.reverse(body)) + 1
    end = F.when(body.contains(")"), last).otherwise(F.greatest(F.length(body) - 1, F.lit(0)))
    return F.when(c.contains("api_call"), F.substring(body, start + 3, F.greatest(end - start - 2, F.lit(0)))).otherwise(c)


def _first_call(code: str) -> ast.Call | None:
    try:
        tree = ast.parse(code.strip())
    except SyntaxError:
        return None
    node = tree.body[0].value if tree.body and isinstance(tree.body[0], ast.Expr | ast.Assign) else None
    return node if isinstance(node, ast.Call) else None


def reference_arguments(code: str, kind: str = "all") -> list[str]:
    """Source of a call's arguments: all, those of ``repo_or_dir`` and ``model`` (hub), or that of ``model`` (model); positional ones only with all."""
    call = _first_call(code)
    if call is None:
        return []
    names = {"all": None, "hub": ("repo_or_dir", "model"), "model": ("model",)}[kind]
    out = [ast.unparse(a) for a in call.args] if names is None else []
    return out + [ast.unparse(k.value) for k in call.keywords if k.arg and (names is None or k.arg in names)]


def qualified(call: str, owners: Mapping[str, str]) -> str:
    """Each called name with its owner before it; other names stay."""
    return re.sub(r"\b([A-Za-z_]\w*)\s*(?=\()", lambda m: f"{owners[m[1]]}.{m[1]}" if m[1] in owners else m[1], call)


def syntax_errors(code: str) -> int:
    """Statements at the top level that can't be read; the rest is read on after each."""
    n, lines = 0, code.split("\n")
    while lines:
        try:
            ast.parse("\n".join(lines))
            return n
        except SyntaxError as e:
            n += 1
            lines = lines[max(1, min(e.lineno or 1, len(lines))) :]
    return n


#: Names of types and what they are called in descriptions.
TYPE_NAMES = {"str": "string", "int": "integer", "float": "float", "bool": "boolean", "dict": "dict", "Dict": "dict", "list": "array", "List": "array", "tuple": "array", "Tuple": "array", "Any": "any"}


def type_schema(text: str) -> dict:
    """A type as it is written in Python, as a description: optional ones like the type itself, unions of several as any."""
    text = text.strip()
    head, _, rest = text.partition("[")
    if not rest.endswith("]"):
        return {"type": TYPE_NAMES.get(text, text)}
    inner = _split_types(rest[:-1])
    if head in ("Optional", "Union"):
        real = [t for t in inner if t not in ("None", "NoneType")]
        return type_schema(real[0]) if len(real) == 1 else {"type": "any"}
    if head in ("List", "list"):
        return {"type": "array", "items": type_schema(", ".join(inner))}
    if head in ("Tuple", "tuple"):
        return {"type": "array", "items": [type_schema(t) for t in inner]}
    if head in ("Dict", "dict") and len(inner) == 2:
        return {"type": "dict", "additionalProperties": type_schema(inner[1])}
    return {"type": TYPE_NAMES.get(head, head)}


def _split_types(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += {"[": 1, "]": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


_PARAM = re.compile(r"\s*(\w+)\s*\(([^)]*)\)\s*:\s*(.*)")


def docstring_schema(doc: str) -> dict:
    """Description, parameters and response of a docstring with ``Args:`` and ``Returns:`` sections.

    A parameter is ``name (type): text``, more text on deeper lines; ``[Optional]``
    in its text makes it optional, ``default`` after a comma in its brackets gives its default.
    """
    text, section, sections = [], None, {"Args": [], "Returns": []}
    for line in doc.strip().split("\n"):
        head = line.strip().rstrip(":")
        if line.strip().endswith(":") and head in sections:
            section = head
        elif section is None:
            text.append(line.strip())
        else:
            sections[section].append(line)
    out = {"description": " ".join(t for t in text if t), "parameters": {"type": "dict", "properties": {}, "required": []}, "response": {"type": "dict", "properties": {}}}
    for section, place in (("Args", out["parameters"]), ("Returns", out["response"])):
        name, depth = None, None
        for line in sections[section]:
            m, indent = _PARAM.match(line), len(line) - len(line.lstrip())
            if m and (depth is None or indent <= depth):
                name, depth = m[1], indent
                kind, *more = _split_types(m[2])
                place["properties"][name] = {**type_schema(kind), "description": m[3].strip()}
                default = next((x.partition("=")[2] for x in more if x.strip().startswith("default")), None)
                if default is not None:
                    place["properties"][name]["default"] = default.strip()
                if section == "Args" and "[Optional]" not in m[3] and default is None:
                    place["required"].append(name)
            elif name and line.strip():
                place["properties"][name]["description"] += " " + line.strip()
    return out


def imported(source: str) -> set[str]:
    """Top-level packages that code imports; relative imports are its own."""
    found: set[str] = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            found.add(node.module.split(".")[0])
    return found


def dependencies(source: str, packages: Mapping[str, str] = {}, local: Iterable[str] = ()) -> list[str]:  # noqa: B006 - never changed
    """Names of the packages that code needs, by lower-case name: imports but those of the standard library and local ones, mapped to what they are installed as."""
    need = imported(source) - set(local) - set(sys.stdlib_module_names)
    return sorted({packages.get(m, m) for m in need}, key=lambda n: (n.lower(), n))


def weighted_recall(refs: list[tuple[list[str], Mapping[str, float]]], hyp: list[str], n: int) -> tuple[float, float]:
    """(hits, total) of the references' n-grams, each counted at most as often as in ``hyp``.

    Single words are weighted where the weights are as many as the reference's different words; others weigh 1.
    """
    grams = lambda s: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    have, hits, total = grams(hyp), 0.0, 0.0
    for ref, weights in refs:
        want = grams(ref)
        by = (lambda g: weights.get(g[0], 1)) if n == 1 and len(weights) == len(want) else (lambda g: 1)
        hits += sum(min(c, have[g]) * by(g) for g, c in want.items())
        total += max(1, sum(c * by(g) for g, c in want.items()))
    return hits, total


def hinted(fn: dict, language: str) -> dict:
    """A function's description with its language, and for Java and JavaScript all parameters as texts that hold source."""
    # fixed values: the sentences that the models get
    names = {"java": "Java 8 SDK", "javascript": "JavaScript"}
    out = fn | {"description": fn["description"] + f" Note that the provided function is in {names.get(language, 'Python 3')} syntax."}
    if language not in names:
        return out
    shown, lists = ("Java", ("ArrayList", "Array")) if language == "java" else ("JavaScript", ("array",))
    params = {}
    for name, p in fn["parameters"]["properties"].items():
        kind, new = p["type"], dict(p)
        said = [p.get("description", ""), f" This parameter can be of any type of {shown} object in string representation." if kind == "any" else f" This is {shown} {kind} type parameter in string representation."]
        if kind in lists and "items" in p:
            said.append(f" The list elements are of type {p['items']['type']}; they are not in string representation.")
            new.pop("items")
        if language == "javascript" and kind == "dict" and "properties" in p:
            import json

            said.append(f" The dictionary entries have the following schema; they are not in string representation. {json.dumps(p['properties'])}")
            new.pop("properties")
        params[name] = new | {"type": "string", "description": "".join(said)}
    return out | {"parameters": fn["parameters"] | {"properties": params}}
