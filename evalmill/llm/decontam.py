"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are numbered by the vocabulary of the benchmark; a window of a document
can only match where all its words are in it, and there a polynomial hash of the
numbers is looked up in the set.  Every hit is verified on the words themselves.

The set is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words, one
at a time; a larger benchmark takes more blocks, and between them the rows with
what was found so far are written to the shared folder, so that no two blocks
are held at once.  Null texts have no words; repeated rows are marked alike; an
empty table of either kind gives no hit.  An item of fewer words than a window is
one window; an item without words none.  Equal items all count.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import append_columns, discard, scratch, small_batches

WINDOW = 10
#: Words of benchmark text in one broadcast: the bound of its size, about 100 MB of tables at most.
BLOCK_WORDS = 500_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: in UTF-8, letters, digits and all bytes from 0x80."""
    return _WORD.findall(text.encode().lower()) if text else []


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = h * _BASE + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of some items: vocabulary, sorted hashes by length, and exact words with their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                got = self.items[tuple(ids[i : i + n])]
                if not got or got[-1] != k:
                    got.append(k)
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for key in self.items:
            by[len(key)].append(window_hashes(np.array(key), len(key)))
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in by.items()}

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are in an occurrence of a window, and the items that occur."""
        hit, found = np.zeros(len(words) + 1, dtype=np.int64), set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, table in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = window_hashes(ids, n)[at]
            pos = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for i in at[table[pos] == h].tolist():
                if items := self.items.get(tuple(ids[i : i + n].tolist())):
                    hit[i] += 1
                    hit[i + n] -= 1
                    found.update(self.names[k] for k in items)
        return np.cumsum(hit)[:-1] > 0, found


def blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str, block_words: int) -> Iterator[Windows]:
    """The benchmark a block at a time; no more than a block is held."""
    held, n = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(row[1])
        if words and row[0] is not None:
            if held and n + len(words) > block_words:
                yield Windows(held, size)
                held, n = [], 0
            held.append((row[0], words))
            n += len(words)
    if held:
        yield Windows(held, size)


_SPANS = "em_hit_runs"
_ITEMS = "em_items"


def mark(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``em_hit_runs`` (first and end word of each run of hit words) and ``em_items`` (ids as strings)."""
    spark = df.sparkSession
    small_batches(spark)
    fields = T.StructType([T.StructField(_SPANS, T.ArrayType(T.IntegerType())), T.StructField(_ITEMS, T.ArrayType(T.StringType()))])
    out = df.withColumns({_SPANS: F.array().cast("array<int>"), _ITEMS: F.array().cast("array<string>")})
    keep, shared, written = df.columns, None, None
    for block in blocks(benchmark, size, item_col, item_text_col, block_words):
        if shared is not None:
            before, written = written, scratch(out, "marked")
            out = written
            shared.destroy()
            if before is not None:
                discard(before)
        shared = spark.sparkContext.broadcast(block)

        def run(texts, runs, items, shared=shared):
            new_runs, new_items = [], []
            for t, r, i in zip(texts, runs, items, strict=True):
                words = words_of(t)
                hit, found = shared.value.find(words)
                if found:
                    for a, b in zip(r[::2], r[1::2], strict=True):
                        hit[a:b] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    r, i = edge.tolist(), sorted({*i, *found})
                new_runs.append(r)
                new_items.append(i)
            return {_SPANS: new_runs, _ITEMS: new_items}

        out = append_columns(out.withColumnsRenamed({_SPANS: "em_r0", _ITEMS: "em_i0"}), [text_col, "em_r0", "em_i0"], run, fields).select(*[F.col(f"`{c}`") for c in keep], _SPANS, _ITEMS)
    return out


def digests(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    marked = mark(df, benchmark, text_col=text_col, **kw)

    def run(texts, runs, items):
        return {
            "n_words": [len(words_of(t)) for t in texts],
            "n_hit": [sum(r[1::2]) - sum(r[::2]) for r in runs],
            "n_items": [len(i) for i in items],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
            "contaminated": [bool(i) for i in items],
        }

    fields = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")] + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    return append_columns(marked, [text_col, _SPANS, _ITEMS], run, fields).drop(_SPANS, _ITEMS)


def remove_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows with no occurrence of a window."""
    return mark(df, benchmark, text_col=text_col, **kw).filter(F.size(_ITEMS) == 0).drop(_SPANS, _ITEMS)


def strip_spans(text: str | None, runs: list[int]) -> str | None:
    """``text`` without the characters from the first to the last letter of each run of hit words."""
    if not text or not runs:
        return text
    raw = text.encode()
    words = list(_WORD.finditer(raw.lower()))
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[at : words[a].start()])
        at = words[b - 1].end()
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "cleaned", **kw) -> DataFrame:
    """``df`` with the text outside of all hit words in ``out_col``; rows stay."""
    marked = mark(df, benchmark, text_col=text_col, **kw)
    fields = T.StructType([T.StructField(out_col, T.StringType())])
    return append_columns(marked, [text_col, _SPANS], lambda texts, runs: {out_col: [strip_spans(t, r) for t, r in zip(texts, runs, strict=True)]}, fields).drop(_SPANS, _ITEMS)
