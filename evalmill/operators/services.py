"""Read-only operations of the simulated services, over the rows of all their sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions.text import two_digits


def search(df: DataFrame, needle: str, text: str, tags: str | None = None) -> DataFrame:
    """Rows whose text holds ``needle`` or one of whose tags is it, in any case; nulls hold nothing."""
    low = needle.lower()
    hit = F.coalesce(F.contains(F.lower(text), F.lit(low)), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.lower(t) == low), F.lit(False))
    return df.filter(hit)


def within(ts: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """``ts`` from ``start`` to ``end``, both included; a null or absent bound is open."""
    ok = ts.isNotNull()
    for bound, side in ((start, ts >= start if start is not None else None), (end, ts <= end if end is not None else None)):
        if bound is not None:
            ok = ok & (bound.isNull() | side)
    return ok


def exchange(amounts: DataFrame, rates: DataFrame, source: str, target: str, amount: str) -> DataFrame:
    """``amounts`` with ``converted``; rates (base, quote, rate) hold in both directions, the stated one first.

    Equal currencies keep the amount; a pair without a rate gives null.
    """
    stated = rates.select(F.col("base").alias(source), F.col("quote").alias(target), F.col("rate").alias("em_by"), F.lit(1.0).alias("em_over"))
    turned = rates.select(F.col("quote").alias(source), F.col("base").alias(target), F.lit(1.0).alias("em_by"), F.col("rate").alias("em_over"))
    both = stated.union(turned.join(stated, [source, target], "left_anti"))
    same = F.col(source) == F.col(target)
    out = amounts.join(both, [source, target], "left")
    return out.withColumn("converted", F.when(same, F.col(amount)).otherwise(F.col(amount) * F.col("em_by") / F.col("em_over"))).drop("em_by", "em_over")


def population_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, mean, population deviation, least and greatest of each key."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def contact_stats(messages: DataFrame, receiver: str, sender: str) -> DataFrame:
    """Messages that each receiver got, and from how many senders."""
    each = messages.groupBy(receiver, sender).agg(F.count("*").alias("em_n"))
    return each.groupBy(receiver).agg(F.sum("em_n").alias("n_received"), F.count(sender).alias("n_contacts"))


def usage(df: DataFrame, key: str, start: str, end: str, *sums: str) -> DataFrame:
    """First start, last end and sums of each key: partial results merge."""
    return df.groupBy(key).agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.count("*").alias("n_calls"), *[F.sum(s).alias(f"total_{s}") for s in sums])


def folder_sizes(files: DataFrame, path: str, size: Column) -> DataFrame:
    """Bytes and files below each folder and each file itself, from full paths; partial sums precede the shuffle."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(above).alias("folder"), size.alias("em_size")).groupBy("folder").agg(F.sum("em_size").alias("n_bytes"), F.count("*").alias("n_files"))


def line_differences(a: Column, b: Column) -> Column:
    """(pos, a, b) of the lines that differ at the same place; what one text has beyond the other isn't compared."""
    n = F.least(F.size(a), F.size(b))
    both = F.transform(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get(b, i).alias("b")))
    return F.filter(both, lambda s: ~s["a"].eqNullSafe(s["b"]))


def digit_sum(c: Column) -> Column:
    return F.aggregate(F.transform(F.filter(F.split(c, ""), lambda x: x.rlike("^[0-9]$")), lambda x: x.cast("int")), F.lit(0), lambda s, x: s + x)


def is_memory_key(c: Column) -> Column:
    """Lower-case words joined by single underscores, the first of letters only."""
    return F.coalesce(c.rlike(r"^[a-z]+(_[a-z0-9]+)*\z"), F.lit(False))


def success_share(passed: Column, failed: Column) -> Column:
    """Text with two digits, or N/A where nothing was tried; the share is rounded as the double it is, ties upwards."""
    n = F.coalesce(passed, F.lit(0)) + F.coalesce(failed, F.lit(0))
    return F.when(n > 0, two_digits(F.coalesce(passed, F.lit(0)) / n, up=True)).otherwise("N/A")


def missing_numbers(spark: SparkSession, n: int, done: DataFrame, col: str) -> DataFrame:
    """Numbers below ``n`` that ``done`` lacks: the parts still to be made."""
    return spark.range(n).select(F.col("id").alias(col)).join(done.select(F.col(col).cast("long").alias(col)), col, "left_anti")


def newest(snapshots: DataFrame, key: str, order: list[str], *cols: str) -> DataFrame:
    """The last row of each key; a group by with partial results, no window."""
    last = F.max_by(F.struct(*cols), F.struct(*order)).alias("em_last")
    return snapshots.groupBy(key).agg(last).select(key, *[F.col(f"em_last.{c}").alias(c) for c in cols])


def expand(df: DataFrame, key: str, names: str, dim: DataFrame, name: str, value: str) -> DataFrame:
    """(key, values): each name's value in the names' order; a name that ``dim`` lacks gives none."""
    rows = df.select(key, F.posexplode(names).alias("em_pos", name)).join(dim.select(name, value), name)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("em_pos", value))).alias("em_all")).select(key, F.col(f"em_all.{value}").alias("values"))


def greedy_match(valid: Column) -> Column:
    """For each row of a truth-by-output matrix, the first true output that no row before has taken, or -1."""
    free = lambda taken, row: F.filter(F.transform(row, lambda x, j: F.when(x & ~F.array_contains(taken, j), j)), lambda j: j.isNotNull())
    first = lambda taken, row: F.coalesce(F.try_element_at(free(taken, row), F.lit(1)), F.lit(-1))
    return F.aggregate(valid, F.array().cast("array<int>"), lambda taken, row: F.concat(taken, F.array(first(taken, row))))
