"""Accuracy roll-ups, cost and latency, ranked leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_accuracy(results: DataFrame, *keys: str, valid: str = "valid") -> DataFrame:
    """accuracy and total_count of each group."""
    return results.groupBy(*keys).agg(F.avg(F.col(valid).cast("double")).alias("accuracy"), F.count("*").alias("total_count"))


def weighted(scores: DataFrame, *keys: str) -> DataFrame:
    """Accuracy weighted by the number of cases."""
    return scores.groupBy(*keys).agg((F.sum(F.col("accuracy") * F.col("total_count")) / F.sum("total_count")).alias("accuracy"), F.sum("total_count").alias("total_count"))


def with_members(scores: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """One row for each key and member of the fixed dimension; a missing member has accuracy 0 and is marked."""
    grid = scores.select(key).distinct().crossJoin(F.broadcast(members))
    return grid.join(scores, [key, member], "left").withColumns({"missing": F.col("accuracy").isNull(), "accuracy": F.coalesce("accuracy", F.lit(0.0)), "total_count": F.coalesce("total_count", F.lit(0))})


def unweighted(full: DataFrame, key: str) -> DataFrame:
    """Mean over the members, missing ones as 0; the shown value is null if any is missing."""
    return full.groupBy(key).agg(F.avg("accuracy").alias("accuracy"), F.sum("total_count").alias("total_count"), F.max("missing").alias("any_missing")).withColumn("display_accuracy", F.when(~F.col("any_missing"), F.col("accuracy")))


def percentage_weighted(full: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Weights normalised by their sum."""
    return full.groupBy(key).agg((F.sum(F.col("accuracy") * F.col(weight)) / F.sum(weight)).alias("accuracy"), F.sum("total_count").alias("total_count"))


def ranked(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Position by descending value, nulls last, ties by ``tie``.  For leaderboards: one row a competitor."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), tie)))


def config_sensitivity(results: DataFrame, key: str, config: str) -> DataFrame:
    """Sample variance, deviation and range of the accuracies over configurations, in per cent; 0 with one."""
    per = category_accuracy(results, key, config)
    one = F.count("*") <= 1
    return per.groupBy(key).agg(
        F.count("*").alias("n_configs"),
        F.when(one, 0.0).otherwise(F.var_samp("accuracy") * 1e4).alias("variance"),
        F.when(one, 0.0).otherwise(F.stddev_samp("accuracy") * 100).alias("deviation"),
        F.when(one, 0.0).otherwise((F.max("accuracy") - F.min("accuracy")) * 100).alias("max_delta"),
    )


def latency_stats(df: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """Mean, sample deviation and interpolated 95th percentile of the values that aren't 0.

    Values are counted first; the percentile is read off running counts, which
    are sorted and spilled as need be, so no buffer holds a key's values.
    """
    c = F.col(value)
    some = df.filter(c != 0)
    counts = some.groupBy(key, c.alias("em_v")).agg(F.count("*").alias("em_n"))
    sizes = some.groupBy(key).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation"), F.count("*").alias("em_size"))
    upto = F.sum("em_n").over(Window.partitionBy(key).orderBy("em_v").rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("em_size") - 1) * F.lit(q)
    at = lambda k: F.min(F.when(F.col("em_upto") > k, F.col("em_v")))  # noqa: E731 - the value at a place counted from 0
    found = counts.withColumn("em_upto", upto).join(sizes.select(key, "em_size"), key).withColumns({"em_lo": F.floor(place), "em_hi": F.ceil(place), "em_part": place - F.floor(place)})
    p = found.groupBy(key).agg(at(F.col("em_lo")).alias("lo"), at(F.col("em_hi")).alias("hi"), F.first("em_part").alias("part")).select(key, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("p95"))
    return sizes.join(p, key).select(key, "mean", "deviation", "p95")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost by prices a million tokens."""
    return tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6


def gpu_cost(seconds: Column, price_an_hour: float = 23.92) -> Column:
    return seconds / 3600 * price_an_hour / 100
