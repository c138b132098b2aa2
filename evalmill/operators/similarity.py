"""Overlap of texts: n-grams, BLEU, and structure of Python code."""

from __future__ import annotations

import ast
import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions.text import ngrams


def clipped_orders(pairs: DataFrame, key: str, orders: int) -> DataFrame:
    """(key, n, hits, total) of n-grams of ``hyp`` (tokens) for each order, each counted at most as often as in ``ref``; pairs are read once."""
    marked = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))
    grams = lambda c: F.flatten(F.array(*[F.transform(ngrams(F.col(c), n), marked(n)) for n in range(1, orders + 1)]))
    side = lambda c, have, most: pairs.select(key, F.explode(grams(c)).alias("x")).select(key, "x.n", "x.g", F.lit(have).alias("have"), F.lit(most).alias("most"))
    counts = side("hyp", 1, 0).union(side("ref", 0, 1)).groupBy(key, "n", "g").agg(F.sum("have").alias("have"), F.sum("most").alias("most"))
    return counts.groupBy(key, "n").agg(F.sum(F.least("have", "most")).alias("hits"), F.sum("have").alias("total")).filter("total > 0")


def clipped(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """(key, hits, total) of the n-grams of one order."""
    return clipped_orders(pairs, key, n).filter(F.col("n") == n).drop("n")


def corpus_bleu(pairs: DataFrame, key: str, orders: int = 4, epsilon: float = 0.1) -> DataFrame:
    """One row: counts of all pairs together, zero counts smoothed by epsilon, times the brevity penalty."""
    of = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    total = clipped_orders(pairs, key, orders).agg(*[x for n in range(1, orders + 1) for x in (of("hits", n).alias(f"h{n}"), F.greatest(of("total", n), F.lit(1)).alias(f"t{n}"))])
    lengths = pairs.agg(F.sum(F.size("hyp")).alias("hl"), F.sum(F.size("ref")).alias("rl"))
    logs = [F.log(F.when(F.col(f"h{n}") == 0, F.lit(epsilon)).otherwise(F.col(f"h{n}")) / F.col(f"t{n}")) for n in range(1, orders + 1)]
    mean = sum(logs[1:], logs[0]) / orders
    penalty = F.when(F.col("hl") > F.col("rl"), 1.0).when(F.col("hl") == 0, 0.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    return total.crossJoin(lengths).withColumn("bleu", F.when(F.col("h1") == 0, 0.0).otherwise(penalty * F.exp(mean)))  # one row each


def smooth(hits: list[int], totals: list[int], method: int, length: int = 0, extra: tuple[int, int] | None = None, epsilon: float = 0.1, alpha: float = 5, k: float = 5) -> list[float]:
    """Modified precisions of orders 1.. by one of the smoothing methods 0 to 7."""
    l = [max(1, t) for t in totals]  # noqa: E741
    p = [h / t for h, t in zip(hits, l, strict=True)]
    if method == 0:
        return [x or 2.2250738585072014e-308 for x in p]
    if method == 1:
        return [x or epsilon / t for x, t in zip(p, l, strict=True)]
    if method == 2:
        return [(h + 1) / (t + 1) for h, t in zip(hits, l, strict=True)]
    if method == 3:
        out, zeros = [], 0
        for x, t in zip(p, l, strict=True):
            zeros += x == 0
            out.append(x or 1 / (2**zeros * t))
        return out
    if method == 6:
        out = p[:2]
        for i in range(2, len(p)):
            pi = out[i - 1] ** 2 / out[i - 2] if out[i - 2] else 0.0
            out.append((hits[i] + alpha * pi) / (l[i] + alpha))
        return out
    if method in (4, 7) and length > 1:
        p = [x or (i + k / math.log(length)) / t for i, (x, t) in enumerate(zip(p, l, strict=True))]
    if method in (5, 7):
        nxt = [*p, extra[0] / max(1, extra[1]) if extra else 0.0]
        out, before = [], p[0] + 1
        for i in range(len(p)):
            before = (before + nxt[i] + nxt[i + 1]) / 3
            out.append(before)
        return out
    return p


def sentence_bleu(refs: list[list[str]], hyp: list[str], orders: int = 4, method: int = 1) -> float:
    """BLEU of one text against several references."""
    grams = lambda s, n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))

    def precision(n):
        h = grams(hyp, n)
        most: Counter = Counter()
        for r in refs:
            most |= grams(r, n)
        return sum(min(c, most[g]) for g, c in h.items()), max(1, sum(h.values()))

    found = [precision(n) for n in range(1, orders + 1)]
    if not found[0][0]:
        return 0.0
    p = smooth([h for h, _ in found], [t for _, t in found], method, len(hyp), precision(orders + 1))
    near = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
    penalty = 1.0 if len(hyp) > near else math.exp(1 - near / len(hyp)) if hyp else 0.0
    return penalty * math.exp(sum(math.log(x) for x in p) / orders)


def subtrees(code: str) -> Counter:
    """Shapes of all trees with children, names and values left out."""
    out: Counter = Counter()

    def shape(node: ast.AST) -> str:
        inner = [shape(c) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]
        s = f"({type(node).__name__}{' ' if inner else ''}{' '.join(inner)})"
        if inner:
            out[s] += 1
        return s

    shape(ast.parse(code))
    return out


def syntax_match(ref: str, hyp: str) -> float:
    """Share of the reference's subtrees that occur in the other code."""
    r, h = subtrees(ref), subtrees(hyp)
    return sum(n for s, n in r.items() if s in h) / max(1, sum(r.values()))


def data_flow(code: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(variable, relation, sources) of assignments, names numbered by first use, sources first."""
    edges: list[tuple[str, str, tuple[str, ...]]] = []
    known: dict[str, str] = {}
    number = lambda n: known.setdefault(n, f"var_{len(known)}")
    names = lambda node: [n.id for n in ast.walk(node) if isinstance(n, ast.Name)]
    for node in ast.walk(ast.parse(code)):
        pairs: list[tuple[ast.AST, ast.AST]] = []
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Tuple) and isinstance(node.value, ast.Tuple) and len(t.elts) == len(node.value.elts):
                    pairs += list(zip(t.elts, node.value.elts, strict=True))
                else:
                    pairs.append((t, node.value))
        elif isinstance(node, ast.AugAssign):
            pairs.append((node.target, ast.Tuple([node.target, node.value])))
        elif isinstance(node, ast.For):
            pairs.append((node.target, node.iter))
        for t, v in pairs:
            sources = tuple(number(n) for n in names(v))
            edges += [(number(n), "computedFrom", sources) for n in names(t)]
    return edges


def data_flow_match(ref: str, hyp: str) -> float:
    """Share of the reference's edges found in the other code, each once."""
    r, h = Counter(data_flow(ref)), Counter(data_flow(hyp))
    return sum((r & h).values()) / max(1, sum(r.values()))
