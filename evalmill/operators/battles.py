"""Ratings from pairwise battles (ord, a, b, rating)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.actions import in_order

A, B, TIE, BAD = "A is better", "B is better", "Tie", "Both are bad"


def counts(battles: DataFrame) -> DataFrame:
    """Battles of each competitor on either side."""
    return battles.select(F.col("a").alias("name")).union(battles.select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


def win_matrix(battles: DataFrame) -> DataFrame:
    """(a, b, points) in long form: 2 for a win, 1 for a tie of either kind, seen from a."""
    even = F.col("rating").isin(TIE, BAD)
    seen = battles.select("a", "b", F.when(F.col("rating") == A, 2).when(even, 1).otherwise(0).alias("p"))
    back = battles.select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(F.col("rating") == B, 2).when(even, 1).otherwise(0).alias("p"))
    return seen.union(back).groupBy("a", "b").agg(F.sum("p").alias("points"))


def elo_fold(rows, k: float = 4, scale: float = 400, base: float = 10, start: float = 1000, ratings: dict | None = None) -> dict[str, float]:
    """Online Elo over (a, b, rating) in order."""
    r = ratings if ratings is not None else {}
    share = {A: 1.0, B: 0.0, TIE: 0.5, BAD: 0.5}
    for a, b, rating in rows:
        if rating not in share:
            raise ValueError(f"unexpected rating {rating}")
        ra, rb = r.get(a, start), r.get(b, start)
        ea = 1 / (1 + base ** ((rb - ra) / scale))
        gain = k * (share[rating] - ea)
        r[a] = ra + gain
        r[b] = (r.get(b, start) if a == b else rb) - gain
    return r


def online_elo(battles: DataFrame, group: str, reverse: bool = False, k: float = 4, scale: float = 400, base: float = 10, start: float = 1000) -> DataFrame:
    """(group, name, rating): Elo of each group's battles in order, or from the last to the first.

    The rule is sequential, so a group is one fold; groups run side by side, and
    a task holds the ratings of one group, however long its battles are.
    """
    by = F.col("ord") if not reverse else -F.col("ord")
    df = battles.select(group, by.alias("em_at"), "a", "b", "rating")

    def fold(rows):
        held, ratings, some = None, {}, False
        for key, a, b, rating in rows:
            if some and key != held:
                yield from ((held, n, r) for n, r in ratings.items())
                ratings = {}
            held, some = key, True
            elo_fold([(a, b, rating)], k, scale, base, start, ratings)
        yield from ((held, n, r) for n, r in ratings.items())

    kind = battles.schema[group].dataType.simpleString()
    return in_order(df, [group], ["em_at"], ["a", "b", "rating"], fold, f"{group} {kind}, name string, rating double")


#: Pairs that met, and components, that the fit on the driver takes: some hundred MB at most.
MAX_PAIRS, MAX_NAMES = 5_000_000, 1_000_000


def _checked(df: DataFrame, most: int, what: str) -> DataFrame:
    n = df.count()
    if n > most:
        raise ValueError(f"{n} {what}; the fit holds {most} at most")
    return df


def bradley_terry(points: DataFrame, penalty: float | None = 0.7, scale: float = 400, start: float = 1000, steps: int = 100) -> DataFrame:
    """Maximum-likelihood strengths from the win matrix, with an L2 penalty of 1 / penalty or none.

    Counting is distributed; the fit has one unknown a competitor and runs on
    the driver by Newton's method with conjugate gradients, over the pairs that
    met only: ``MAX_PAIRS`` of them at most, else ValueError.  Without a penalty
    strengths are centred.
    """
    rows = _checked(points.filter("a <> b"), MAX_PAIRS, "pairs").collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    # a row (a, b, points) says what a won from b; every meeting enters twice, once from each side
    i, j = np.array([at[r["a"]] for r in rows], dtype=np.int64), np.array([at[r["b"]] for r in rows], dtype=np.int64)
    beta = _newton(np.column_stack([i, j]).reshape(-1, 2), np.array([2.0 * r["points"] for r in rows]), len(names), 1 / penalty if penalty else 1e-9, steps)
    if not penalty and len(names):
        beta -= beta.mean()
    spark = points.sparkSession
    return spark.createDataFrame([(n, float(scale * b + start)) for n, b in zip(names, beta, strict=True)], "name string, rating double")


def _newton(sides: np.ndarray, weight: np.ndarray, n: int, ridge: float, steps: int = 100, unit: float = 1.0) -> np.ndarray:
    """Maximum of sum(weight * log sigmoid(sum of beta at ``sides`` by their signs)) - ridge / 2 * beta^2.

    ``sides``: a row a meeting; the first half of its columns wins over the second, -1 for none.
    """
    half = sides.shape[1] // 2
    sign = np.where(np.arange(sides.shape[1]) < half, unit, -unit)
    there = sides >= 0
    held = np.where(there, sides, 0)
    flat, on = held[there], np.broadcast_to(sign, sides.shape)[there]
    row = np.nonzero(there)[0]
    across = lambda v: (np.where(there, v[held], 0.0) * sign).sum(axis=1)
    back = lambda x: np.bincount(flat, x[row] * on, n)
    beta = np.zeros(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-across(beta)))
        g = back(weight * (1 - p)) - ridge * beta
        curve = weight * p * (1 - p)
        step, r = np.zeros(n), g.copy()
        d, rr = r.copy(), float(g @ g)
        for _ in range(4 * n + 10):  # conjugate gradients
            if rr <= 1e-24 * max(1.0, float(g @ g)):
                break
            h = back(curve * across(d)) + ridge * d
            a = rr / float(d @ h)
            step, r = step + a * d, r - a * h
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        beta += np.clip(step, -2, 2)
        if not n or np.abs(step).max() < 1e-10:
            break
    return beta


def components_mle(battles: DataFrame, kinds: tuple[str, ...] = ("tool", "model", "framework"), scale: float = 400, base: float = 10, start: float = 1000, penalty: float = 1.0) -> DataFrame:
    """(kind, name, rating): strengths of all components together, from battles with ``<kind>_a``, ``<kind>_b`` and ``rating``.

    A battle that A wins is one for A's components, any other for B's.  A kind
    counts where both sides have one; tools only where ``tool_categories_a`` and
    ``_b`` (arrays, if there are such columns) overlap.  Equal battles are
    counted before the fit, which holds ``MAX_PAIRS`` different ones at most.
    """
    cols = []
    for k in kinds:
        both = F.col(f"{k}_a").isNotNull() & F.col(f"{k}_b").isNotNull()
        if f"{k}_categories_a" in battles.columns:
            both = both & F.coalesce(F.arrays_overlap(f"{k}_categories_a", f"{k}_categories_b"), F.lit(False))
        cols += [F.when(both, F.col(f"{k}_a")).alias(f"{k}_a"), F.when(both, F.col(f"{k}_b")).alias(f"{k}_b")]
    names = None
    for k in kinds:
        for side in "ab":
            one = battles.select(F.lit(k).alias("kind"), F.col(f"{k}_{side}").alias("name")).filter("name is not null")
            names = one if names is None else names.union(one)
    known = _checked(names.distinct(), MAX_NAMES, "components").collect()
    at = {(r["kind"], r["name"]): i for i, r in enumerate(sorted(known))}
    won = battles.select(*cols, (F.col("rating") == A).alias("won")).groupBy(*[f"{k}_{s}" for k in kinds for s in "ab"], "won").agg(F.count("*").alias("n"))
    rows = _checked(won, MAX_PAIRS, "different battles").collect()
    place = lambda k, v: at[k, v] if v is not None else -1
    sides = np.array([[place(k, r[f"{k}_{s}"]) for s in ("ab" if r["won"] else "ba") for k in kinds] for r in rows], dtype=np.int64).reshape(-1, 2 * len(kinds))
    beta = _newton(sides, np.array([2.0 * r["n"] for r in rows]), len(at), 1 / penalty, unit=math.log(base))
    return battles.sparkSession.createDataFrame([(k, n, float(scale * beta[i] + start)) for (k, n), i in at.items()], "kind string, name string, rating double")


def rounded(rating: Column) -> Column:
    """A rating as a whole number: half is added and the rest cut off towards zero."""
    return (rating + 0.5).cast("int")


def square_counts(battles: DataFrame) -> DataFrame:
    """(a, b, n) for every pair of competitors, 0 where they never met: counts in both directions; for leaderboards of some hundred names."""
    names = battles.select(F.col("a").alias("name")).union(battles.select("b")).distinct()
    grid = names.select(F.col("name").alias("a")).crossJoin(F.broadcast(_checked(names, 5000, "names").select(F.col("name").alias("b"))))
    met = battles.select("a", "b").union(battles.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    return grid.join(met, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rating_lines(ratings: DataFrame, group: str) -> DataFrame:
    """(group, pos, line) of a text file with a section a group: a headline, names with ratings from the highest, an empty line."""
    order = Window.partitionBy(group).orderBy(F.desc("rating"), "name")
    body = ratings.select(group, F.row_number().over(order).alias("pos"), F.concat_ws(": ", "name", F.col("rating").cast("string")).alias("line"))
    keys = ratings.groupBy(group).agg(F.count("*").alias("n"))
    head = keys.select(group, F.lit(0).alias("pos"), F.concat(F.lit("ELO Ratings for "), F.col(group).cast("string"), F.lit(" category:")).alias("line"))
    return head.union(body).union(keys.select(group, (F.col("n") + 1).cast("int"), F.lit("")))
