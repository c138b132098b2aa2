"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are lower-cased and folded: look-alike letters of other scripts and digits
that stand for letters become the Latin letter.  A lexicon entry is a stem of
3 to 8 letters at the start of a word, or a whole word of 3 to 24, with a weight.  Exception phrases cancel
the entries they cover.  Hits are normalised by length and a logistic curve
makes the score.

The lexicon and the curve are learned from labelled rows: at most
``max_rows`` of them, those with the least hash of the id, a bounded sample.
An entry must be
so much commoner in toxic texts that less than ``CHANCE`` words as good are
expected by chance, given how many words the sample has; so the support it needs
follows the sample's size.  Scoring reads every text whole.  Null and empty texts have no hits.  Rows whose
label is null are not learned from; of a repeated id the larger label counts.
Without any toxic training row the lexicon is empty and every score is low.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import append_columns, map_batches, scratch, small_batches

MAX_ROWS = 20_000
CHANCE = 0.5
#: Look-alikes and digits, and the letter each stands for.
LOOKS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "κ": "k", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ı": "i", "ⅼ": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
FOLD = str.maketrans(LOOKS | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
#: Harmless phrases that hold an entry.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "pathetic fallacy", "idiot proof", "idiot-proof", "pond scum", "sore loser")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    return text.lower().translate(FOLD) if text else ""


def features(words: set[str]):
    """Prefixes of 3 to 8 letters and, ending in a mark, the word."""
    for w in words:
        n = len(w)
        for k in range(3, min(8, n) + 1):
            yield w[:k]
        if 3 <= n <= 24:
            yield w + "$"


class Lexicon:
    """Entries with weights in an automaton.  ``curve``: intercept and slopes of the logistic."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] = (-4.0, 1.0, 0.0), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self.exceptions = weights, curve, exceptions
        self._automaton = None

    def __reduce__(self):
        return Lexicon, (self.weights, self.curve, self.exceptions)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, list[tuple[int, bool, float]]] = {}
            for e, w in self.weights.items():
                s = e.removesuffix("$")
                entries.setdefault(s, []).append((len(s), e.endswith("$"), w))
            for e in map(fold, self.exceptions):
                entries.setdefault(e, []).append((len(e), True, 0.0))
            for s, what in entries.items():
                a.add_word(s, what)
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text, the longest entry of a place only, without what exceptions cover."""
        if not self.weights or not text:
            return []
        t = fold(text)
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for last, found in self.automaton.iter(t):
            for n, whole, w in found:
                a, b = last + 1 - n, last + 1
                if a and t[a - 1].isalnum() or whole and b < len(t) and t[b].isalnum():
                    continue
                if w == 0.0:
                    free.append((a, b))
                elif a not in best or best[a][0] < b:
                    best[a] = (b, w)
        return [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in free)]

    def inputs(self, text: str | None) -> tuple[float, float]:
        """Weighted hits over the logarithm of the length, and the density a hundred words."""
        h = self.hits(text)
        if not h:
            return 0.0, 0.0
        n = 1 + text.count(" ") + text.count("\n")
        total = sum(w for _, _, w in h)
        return total / math.log2(8 + n), min(5.0, 100 * total / n / 10)

    def score(self, text: str | None) -> float:
        a, b = self.inputs(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    if not len(y) or not 0 < (n * y).sum() < n.sum():
        return (-4.0, 1.0, 0.0)
    a = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(3), a.T @ (n * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def tail(k: int, n: int, rate: float) -> float:
    """Chance of at least ``k`` of ``n`` texts being toxic at a rate between 0 and 1."""
    at = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate))
    return min(1.0, sum(map(at, range(k, n + 1))))


class Chance:
    """How many words as good are expected by chance, from ``held``: the number of texts a word is in, and how many such words there are."""

    def __init__(self, held: dict[int, int], n_pos: int, n_neg: int):
        self.rate = n_pos / max(1, n_pos + n_neg)
        self.sizes = np.array(sorted(held), dtype=np.int64)
        self.above = np.append(np.cumsum([held[n] for n in self.sizes[::-1].tolist()], dtype=np.int64)[::-1], 0)

    def words(self, n: int) -> int:
        """Words in at least ``n`` texts."""
        return int(self.above[np.searchsorted(self.sizes, n)])

    def expected(self, pos: int, neg: int) -> float:
        if not 0 < self.rate < 1:
            return math.inf
        p = tail(pos, pos + neg, self.rate)
        # a word in fewer texts can't be as good
        return max(1, self.words(math.ceil(math.log(max(p, 1e-300)) / math.log(self.rate) - 1e-9))) * p

    def least(self) -> int:
        """The least number of toxic texts with which an entry can be good enough."""
        n = 1
        while 0 < self.rate < 1 and self.expected(n, 0) > CHANCE:
            n += 1
        return n


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, chance: Chance, min_odds: float = 3.0) -> dict[str, float]:
    """Entries: the longest of each family of prefixes that keeps its support, if much likelier in toxic texts."""
    odds = lambda f: math.log(((pos[f] + 0.5) / (n_pos + 1)) / ((neg.get(f, 0) + 0.5) / (n_neg + 1)))
    good = {f: w for f in pos if (w := odds(f)) >= min_odds and pos[f] >= 20 * neg.get(f, 0) and chance.expected(pos[f], neg.get(f, 0)) <= CHANCE}
    longer: dict[str, str] = {}
    for f in good:  # the best continuation of each prefix by one letter or the word's end
        up = f[:-1]
        if up in good and (up not in longer or pos[f] > pos[longer[up]]):
            longer[up] = f
    out: dict[str, float] = {}
    for f in sorted(good, key=lambda f: (len(f), f)):
        if any(f[:k] in good for k in range(3, len(f))):
            continue  # its family is entered by the shortest member
        while f in longer and pos[longer[f]] >= 0.9 * pos[f]:
            f = longer[f]
        out[f] = good[f]
    return dict(sorted(out.items(), key=lambda e: (-e[1], e[0])))


def train(docs: DataFrame, labels: DataFrame, fold_filter=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most ``max_rows`` labelled ids that ``fold_filter`` (a column of the labels' id) lets through."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("em_id"), F.col(label_col).cast("int").alias("em_y")).filter(F.col("em_id").isNotNull() & F.col("em_y").isin(0, 1))
    if fold_filter is not None:
        usable = usable.filter(fold_filter(F.col("em_id")))
    rows = usable.groupBy("em_id").agg(F.max("em_y").alias("em_y")).orderBy(F.xxhash64("em_id"), "em_id").limit(max_rows).collect()
    spark = docs.sparkSession
    if not rows:
        return Lexicon({}, exceptions=exceptions)
    n_pos = sum(r[1] for r in rows)
    n_neg = len(rows) - n_pos
    chosen = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in rows], T.StructType([T.StructField("em_id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())])))  # at most max_rows ids
    sample = scratch(docs.select(F.col(id_col).alias("em_id"), F.col(text_col).alias("t")).join(chosen, "em_id").select("y", "t"), "toxic-sample")

    def count(batches, only):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update({f for f in features(set(_WORD.findall(fold(t)))) if only is None or f in only.value})
        yield {"f": list(c), "n": list(c.values())}

    def total(want, only, least):
        got = map_batches(sample.filter(F.col("y") == want).select("t"), lambda b: count(b, only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r[0]: r[1] for r in got.collect()}

    def words(batches):
        for b in batches:
            yield {"w": [w for t in b.column(0).to_pylist() for w in set(_WORD.findall(fold(t))) if 3 <= len(w) <= 24]}

    held = map_batches(sample.select("t"), words, "w string").groupBy("w").agg(F.count("*").alias("n")).groupBy("n").count().collect() if n_pos and n_neg else []
    chance = Chance({r[0]: r[1] for r in held}, n_pos, n_neg)
    pos = total(1, None, chance.least()) if held else {}
    neg = total(0, spark.sparkContext.broadcast(frozenset(pos)), 1) if pos and n_neg else {}
    lexicon = Lexicon(choose(pos, neg, n_pos, n_neg, chance), exceptions=exceptions)
    if not lexicon.weights:
        return lexicon

    def inputs(batches):
        for b in batches:
            got = [lexicon.inputs(t) for t in b.column(1).to_pylist()]
            yield {"y": b.column(0), "a": [g[0] for g in got], "b": [g[1] for g in got]}

    fit = map_batches(sample, inputs, "y int, a double, b double").groupBy("y", "a", "b").count().collect() if n_neg else []
    n = np.array([r[3] for r in fit], dtype=float)
    return Lexicon(lexicon.weights, fit_curve(np.array([[r[1], r[2]] for r in fit]).reshape(-1, 2), np.array([r[0] for r in fit], dtype=float), n), exceptions)


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``df`` with ``em_toxicity``, 0 to 1."""
    small_batches(df.sparkSession)
    return append_columns(df, [text_col], lambda texts: {"em_toxicity": [lexicon.score(t) for t in texts]}, T.StructType([T.StructField("em_toxicity", T.DoubleType())]))
