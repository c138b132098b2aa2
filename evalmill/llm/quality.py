"""Quality rules by distribution divergence.

Each text has a histogram of character classes and one of common words.  They
are compared with language references by the Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1).  References are measured over all
texts that pass the base rules, one a language label (the labels are a closed
set: their references are held by every task).  Guards of least length
keep short texts from being judged by noise.

Null texts have no words and fail the base rules.  Where no reference exists
(an empty table, or labels all null), the base rules alone decide.  Repeated
rows get equal results; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalmill.llm.common import append_columns, map_batches, scratch, small_batches

#: Frequent words of some languages.
COMMON_WORDS = {
    "en": "the of and to in a is it that was for on are with as be this by from at or an not have but they you his her which".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son elle aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "it": "di e il la che in un a per è una sono con del della non si da le dei nel al come più gli ma lo anche ha alla".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou".split(),
}
WORD_AT = {w: k for k, w in enumerate(sorted({w for v in COMMON_WORDS.values() for w in v}))}
MIN_CHARS, MIN_WORDS = 200, 50
#: The most a text's characters may differ grows with the noise of a short text: MAX_CHAR_DISTANCE + CHAR_NOISE / sqrt(characters).
MAX_CHAR_DISTANCE, CHAR_NOISE, MAX_WORD_DISTANCE = 0.17, 0.8, 0.45
#: Texts farther than this from all first references aren't part of the second, final ones.
TRIM = 0.15

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "other space", "sentence mark", "quote or bracket", "bar", "symbol", "other ASCII", "control", "Latin lower", "Latin upper", "Latin mark", "Greek", "Cyrillic", "Hebrew or Arabic", "Indic or Thai", "CJK", "Hangul", "private or surrogate", "other")


def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane."""
    t = np.full(0x10000, CLASSES.index("other"), dtype=np.uint8)
    for name, ranges in (("Greek", ((0x370, 0x400),)), ("Cyrillic", ((0x400, 0x530),)), ("Hebrew or Arabic", ((0x590, 0x780),)), ("Indic or Thai", ((0x900, 0xE80),)), ("Hangul", ((0x1100, 0x1200), (0xAC00, 0xD7B0))), ("CJK", ((0x2E80, 0xA4D0),)), ("private or surrogate", ((0xD800, 0xF900), (0xFFF0, 0x10000)))):
        for a, b in ranges:
            t[a:b] = CLASSES.index(name)
    for c in range(0x80, 0x250):
        t[c] = CLASSES.index("Latin lower" if chr(c).islower() else "Latin upper" if chr(c).isupper() else "Latin mark")
    for c in range(0x80):
        s = chr(c)
        t[c] = CLASSES.index("lower" if s.islower() else "upper" if s.isupper() else "digit" if s.isdigit() else "space" if s == " " else "newline" if s == "\n" else "other space" if s in "\t\r\x0b\x0c" else "sentence mark" if s in ".,;:!?-" else "quote or bracket" if s in "'\"()[]{}" else "bar" if s == "|" else "symbol" if s in _SYMBOLS else "control" if c < 32 or c == 127 else "other ASCII")
    return t


_TABLE = _class_table()


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[np.minimum(points, 0xFFFF)], minlength=len(CLASSES))


def word_histogram(text: str) -> np.ndarray:
    """Counts of the common words; the last bin has all other words."""
    found = Counter(map(WORD_AT.get, _LETTERS.findall(text.lower())))
    out = np.zeros(len(WORD_AT) + 1, dtype=np.int64)
    for k, n in found.items():
        out[-1 if k is None else k] += n
    return out


def base_rules(text: str | None) -> dict:
    words = _WORDS.findall(text) if text else []
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n") if text else ():
        if _WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(windows)
        if len(count) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(upto, i)
                    upto = i + 3
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, _SYMBOLS)) if text else 0, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": n < 50 or 100 * repeat > 50 * n}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


_BASE = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())])
_HISTOGRAMS = T.StructType([T.StructField("em_chars", T.ArrayType(T.IntegerType())), T.StructField("em_words", T.ArrayType(T.IntegerType()))])


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base rules and both histograms."""
    small_batches(df.sparkSession)

    def run(texts):
        base = [base_rules(t) for t in texts]
        return {f.name: [b[f.name] for b in base] for f in _BASE} | {"em_chars": [char_histogram(t or "") for t in texts], "em_words": [word_histogram(t or "") for t in texts]}

    return append_columns(df, [text_col], run, T.StructType(_BASE.fields + _HISTOGRAMS.fields))


def distances(rows: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """``js_distance`` of each row of counts to a distribution."""
    total = rows.sum(axis=1)
    p = rows / np.maximum(total, 1)[:, None]
    m = (p + ref) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(ref > 0, ref * np.log2(ref / m), 0).sum(axis=1)
    return np.where((total > 0) & (ref.sum() > 0), np.sqrt(np.maximum(both / 2, 0)), 1.0)


def nearest(chars: np.ndarray, words: np.ndarray, refs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of characters and words to the reference of the least sum, and its place; of equals the first."""
    if not refs:
        return np.zeros(len(chars)), np.zeros(len(chars)), np.zeros(len(chars), dtype=int)
    c, w = np.array([distances(chars, rc) for _, rc, _ in refs]), np.array([distances(words, rw) for _, _, rw in refs])
    best = (c + w).argmin(axis=0)
    at = np.arange(len(chars))
    return c[best, at], w[best, at], best


def stacked(column, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers as a matrix."""
    return np.asarray(column.flatten()).reshape(-1, width).astype(float)


def references(measured: DataFrame, lang_col: str = "lang", trim: float = TRIM) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, characters, words) of every label, in order.

    Means of the distributions of all texts that pass the base rules, then once
    more of those among them that are near a first mean: junk must not shape
    what junk is compared with.
    """
    n_chars, n_words = len(CLASSES), len(WORD_AT) + 1
    good = measured.filter(~F.col("base_failed") & F.col(lang_col).isNotNull())

    def means(first: list) -> list:
        def partial(batches):
            sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n_chars + n_words))
            for b in batches:
                c, w, y = stacked(b.column(1), n_chars), stacked(b.column(2), n_words), np.array(b.column(0).to_pylist(), dtype=object)
                near = nearest(c, w, first)[0] <= trim if first else np.ones(len(c), dtype=bool)
                both = np.hstack([c / np.maximum(1, c.sum(axis=1))[:, None], w / np.maximum(1, w.sum(axis=1))[:, None]])
                for label in set(y[near].tolist()):
                    sums[label] += both[near & (y == label)].sum(axis=0)
            yield {"y": [y for y, v in sums.items() for _ in v], "bin": [k for v in sums.values() for k in range(len(v))], "x": [float(x) for v in sums.values() for x in v]}

        rows = map_batches(good.select(F.col(lang_col).alias("y"), "em_chars", "em_words"), partial, "y string, bin int, x double").groupBy("y", "bin").agg(F.sum("x").alias("x")).collect()
        out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n_chars + n_words))
        for y, k, x in rows:
            out[y][k] = x
        return [(y, v[:n_chars] / v[:n_chars].sum(), v[n_chars:] / max(v[n_chars:].sum(), 1e-9)) for y, v in sorted(out.items()) if v[:n_chars].sum()]

    first = means([])
    return means(first) or first


def judge(measured: DataFrame, refs: list[tuple[str, np.ndarray, np.ndarray]], max_char: float = MAX_CHAR_DISTANCE, noise: float = CHAR_NOISE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """``measured`` with the nearest reference, its distances and ``kept``.

    A text is rejected by the base rules, or if it is long enough for a
    histogram to tell and that histogram is too far from the nearest reference.
    """

    keep = [c for c in measured.columns if c not in ("em_chars", "em_words")]
    fields = [T.StructField("nearest", T.StringType()), T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    keep = [c for c in keep if c.lower() not in {f.name for f in fields}]
    struct = T.StructType([measured.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(struct)
    at = [measured.columns.index(c) for c in [*keep, "base_failed", "em_chars", "em_words"]]

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in at]
            c, w = stacked(cols[-2], len(CLASSES)), stacked(cols[-1], len(WORD_AT) + 1)
            dc, dw, best = nearest(c, w, refs)
            n_chars, n_words = c.sum(axis=1), w.sum(axis=1)
            far = ((n_chars >= min_chars) & (dc > max_char + noise / np.sqrt(np.maximum(n_chars, 1)))) | ((n_words >= min_words) & (dw > max_word)) if refs else np.zeros(len(c), dtype=bool)
            failed = np.array(cols[-3].to_pylist(), dtype=bool)
            made = [pa.array([refs[k][0] for k in best.tolist()] if refs else [None] * len(c), pa.string()), pa.array(dc), pa.array(dw), pa.array(~failed & ~far)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*cols[:-3], *made], arrow, strict=True)], schema=arrow)

    return measured.mapInArrow(run, struct)


def assess(df: DataFrame, text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """All columns of ``df`` but the text, the base rules, distances and ``kept``."""
    held = scratch(measure(df, text_col).drop(text_col), "quality")
    return judge(held, references(held, lang_col), **kw)
