"""Secret scan by assignment-aware lexing.

Three base rules find well-formed secrets anywhere in a text.  On top, the text
is read as source or configuration: at each ``=``, ``:``, ``:=`` or ``=>`` the
name on the left and the literals on the right make a pair; a name that was
given a literal before stands for it (constants propagate, also through ``+``,
on this line or the next, adjacent literals, continued lines and parentheses),
and the resolved value is scored by how sensitive the target name is and how
much the value looks like a key.  All its literals are spans.  A tuple is no value.

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
repeated rows have the same; a long text is read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalmill.llm.common import append_columns, small_batches

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so shorter runs are those that fail

_OP = re.compile(r"[:=]")
_OPERATOR = re.compile(r"(:=|=>|=(?![=~])|:(?!//|:))[ \t]*")
_PART = re.compile(r"""[rbuf]{0,2}("{3}(?P<t>(?:[^"\\]|\\(?s:.)|"(?!""))*+)(?:"{3}|\Z)|'{3}(?P<u>(?:[^'\\]|\\(?s:.)|'(?!''))*+)(?:'{3}|\Z)|(?!"{3})"(?P<d>(?:[^"\\\n]|\\(?:\r?\n|.))*)"|(?!'{3})'(?P<s>(?:[^'\\\n]|\\(?:\r?\n|.))*)'|(?P<b>[A-Za-z0-9+/_.=~-]+))""", re.ASCII)
_GAP, _GAP_INSIDE = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"(?:\s|\\\r?\n|(?:#|//)[^\n]*)*+")
_PLUS = re.compile(r"(?P<next>\r?\n[ \t]*)?\+(?:\s|\\\r?\n)*+")
_GIVEN = re.compile(r"[ \t]*[:=]")
_BARE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*$")
#: Parts of names and their weight.
SENSITIVE = (("passphrase", 3.0), ("password", 3.0), ("passwd", 3.0), ("pwd", 2.5), ("secret", 3.0), ("private_key", 3.0), ("privatekey", 3.0), ("api_key", 3.0), ("apikey", 3.0), ("access_key", 3.0), ("accesskey", 3.0), ("signing_key", 3.0), ("encryption_key", 3.0), ("auth_key", 3.0), ("client_key", 2.5), ("credential", 2.5), ("token", 2.5), ("bearer", 2.5), ("auth", 1.5), ("salt", 1.0), ("key", 1.0))
HARMLESS = ("count", "length", "len", "limit", "url", "uri", "path", "file", "name", "type", "hint", "label", "expiry", "expires", "policy", "field", "column", "min", "max", "size", "id")
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|todo|example.*|sample.*|dummy.*|test|changeme.*|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|env\..*|os\.environ.*|process\.env.*)$")
LEAST = 4.5


class Value:
    """A resolved value: what its score needs, and its parts, literals' spans or other values, which are shared and not copied."""

    __slots__ = ("counts", "head", "length", "parts", "tail")

    def __init__(self, literal: str = "", span: tuple[int, int] | None = None):
        self.length, self.counts, self.head, self.tail = len(literal), Counter(literal), literal[:64], literal[-64:]
        self.parts: list = [span] if span else []

    def add(self, other: Value) -> None:
        self.length += other.length
        self.counts.update(other.counts)
        self.head, self.tail = (self.head + other.head)[:64], (self.tail + other.tail)[-64:]
        self.parts.append(other)

    def spans(self, seen: set[int]):
        """Spans of all literals, without those of values in ``seen``."""
        todo = [self]
        while todo:
            v = todo.pop()
            if isinstance(v, tuple):
                yield v
            elif id(v) not in seen:
                seen.add(id(v))
                todo += v.parts

    def placeholder(self) -> bool:
        if self.length <= 64:
            return bool(PLACEHOLDER.match(self.head))
        ends = self.head[:32] + self.tail[-32:]  # the forms are told by their ends, or are one repeated character
        return bool(PLACEHOLDER.match(ends)) and (len(set(ends.lower())) > 1 or len({c.lower() for c in self.counts}) == 1)

    def entropy(self) -> float:
        """Bits a character."""
        return -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values() if c / self.length) if self.length else 0.0


def name_weight(name: str) -> float:
    low = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace("-", "_")
    parts = re.split(r"[._]", low)
    if parts[-1] in HARMLESS:
        return 0.0
    return max((w for s, w in SENSITIVE if s in low), default=0.0)


def score(name: str, value: str | Value) -> float:
    """Name weight, at most 3, and up to 3 for the value's entropy, length and mix of character classes."""
    v = value if isinstance(value, Value) else Value(value)
    w = name_weight(name)
    chars = "".join(v.counts)
    if not w or v.length < 6 or v.placeholder() or any(c.isspace() for c in chars):
        return 0.0
    mix = sum(bool(re.search(p, chars)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return w + min(1.5, v.entropy() / 3) + min(0.75, min(v.length, 32) / 32) + 0.25 * (mix - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def resolved(text: str, at: int, known: dict[str, Value]) -> tuple[Value, int] | None:
    """The value that starts at ``at`` and where it ends; none if there is none or it can't be told."""
    value, end, depth, want, quoted = Value(), at, 0, True, False

    def goes_on(k: int, names: bool) -> bool:
        p = _PART.match(text, k)
        return bool(p) and (p["b"] is None or names and p["b"] in known) and not _GIVEN.match(text, p.end())

    while True:
        at = (_GAP_INSIDE if depth else _GAP).match(text, at).end()
        plus = _PLUS.match(text, at)
        if want:
            if text.startswith("(", at):
                depth, at = depth + 1, at + 1
                continue
            p = _PART.match(text, at)
            if not p:
                break
            kind = next(g for g in "tudsb" if p[g] is not None)
            got, at = p[kind], p.end()
            if kind == "b" and _BARE_NAME.match(got):
                after = _PLUS.match(text, _GAP.match(text, at).end())
                if got in known:
                    value.add(known[got])
                elif value.parts or after and not after["next"]:
                    return None  # an unknown name
                else:
                    value.add(Value(got, (p.start(kind), p.end(kind))))
            else:
                value.add(Value(re.sub(r"\\\r?\n", "", got), (p.start(kind), p.end(kind))))
            end, want, quoted = at, False, kind != "b"
        elif depth and text.startswith(")", at):
            depth, at = depth - 1, at + 1
            end = at
        elif plus and (not plus["next"] or goes_on(plus.end(), True)):
            at, want = plus.end(), True
        elif quoted and goes_on(at, False):
            want = True
        elif depth and text.startswith(",", at):
            return None  # a tuple
        else:
            break
    return (value, end) if value.parts else None


def name_before(text: str, at: int, least: int) -> str:
    """The name that ends before ``at``, perhaps in quotes or brackets, however long; empty if there is none."""
    while at > least and text[at - 1] in " \t":
        at -= 1
    closed = at
    while at > least and closed - at < 2 and text[at - 1] in "\"']":
        at -= 1
    lo = at
    while lo > least and (text[lo - 1] in "_.-" or text[lo - 1].isascii() and text[lo - 1].isalnum()):
        lo -= 1
    return text[lo:at].lstrip("0123456789.-")


def pairs(text: str):
    """(name, resolved value) of every assignment, in order."""
    known: dict[str, Value] = {}
    upto = 0
    for m in _OP.finditer(text):
        if m.start() < upto or text[m.start() - 1 : m.start()] in ("=", "!", "<", ">", ":"):
            continue
        name = name_before(text, m.start(), upto)
        op = _OPERATOR.match(text, m.start())
        if not name or not op:
            continue
        if got := resolved(text, op.end(), known):
            known[name], upto = got
            yield name, got[0]


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    out, seen = set(), set()
    held = []  # ids stay those of these values
    for name, value in pairs(text):
        held.append(value)
        if score(name, value) >= LEAST:
            out.update((a, 3, b) for a, b in value.spans(seen) if b > a)
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_assign``, ``n_access``, ``n_hex`` (long), ``base_sha256`` and ``spans`` (all, joined by commas)."""
    small_batches(df.sparkSession)

    def run(texts):
        cols: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in texts:
            base = base_spans(t := t or "")
            kinds = [k for _, k, _ in base]
            for c, k in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                cols[c].append(kinds.count(k))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(sorted(base + lexed_spans(t))))
        return cols

    return append_columns(df, [text_col], run, T.StructType([T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))


def redact_text(text: str | None, mask: str = "[REDACTED]") -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + lexed_spans(text)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text", out_col: str = "redacted", mask: str = "[REDACTED]") -> DataFrame:
    """``df`` with every span, overlapping ones as one, replaced by ``mask``."""
    small_batches(df.sparkSession)
    return append_columns(df, [text_col], lambda texts: {out_col: [redact_text(t, mask) for t in texts]}, T.StructType([T.StructField(out_col, T.StringType())]))
