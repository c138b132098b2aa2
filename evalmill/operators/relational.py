"""Join and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't in it."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def global_position(df: DataFrame, order: list[str], name: str, partitions: int = 32) -> DataFrame:
    """1-based position in a total order without one task for all rows: ranges, positions within, and offsets of ranges."""
    dealt = df.repartitionByRange(partitions, *order).withColumn("em_range", F.spark_partition_id())
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy("em_range").orderBy(*order)))
    offset = dealt.groupBy("em_range").agg(F.count("*").alias("em_n")).withColumn("em_before", F.coalesce(F.sum("em_n").over(Window.orderBy("em_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # as many rows as ranges
    return local.join(F.broadcast(offset.select("em_range", "em_before")), "em_range").withColumn(name, F.col(name) + F.col("em_before")).drop("em_range", "em_before")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows paired by position; the shorter side decides."""
    return global_position(left, left_order, "position").join(global_position(right, right_order, "position"), "position")


def multiset_contains(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """For each key of ``right``: whether ``left`` holds each of its items at least as often."""
    a = left.groupBy(key, item).agg(F.count("*").alias("have"))
    b = right.groupBy(key, item).agg(F.count("*").alias("need"))
    return b.join(a, [key, item], "left").groupBy(key).agg(F.min((F.coalesce("have", F.lit(0)) >= F.col("need")).cast("int")).cast("boolean").alias("contained"))


def symmetric_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of unordered meetings in long form, each in both directions."""
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).union(pairs.select(F.col(b).alias("a"), F.col(a).alias("b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def chain_roots(single: DataFrame) -> DataFrame:
    """(id, root, dist) of ids that have one dependency each, given as (id, root, dist = 1): the first id up the chain that isn't one of them, by pointer jumping.

    A chain of n ids takes about log2(n) rounds.  Ids in a cycle, or behind one, have no root and are left out.
    """
    from evalmill.sources.tables import stored

    moving, settled = single, single.limit(0)
    for _ in range(single.count().bit_length() + 1):
        step = settled.union(moving).select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"))
        got = stored(moving.join(step, "root", "left").select("id", "root", "dist", "next", "more"), "chains")
        settled = settled.union(got.filter("next is null").select("id", "root", "dist"))
        moving = got.filter("next is not null").select("id", F.col("next").alias("root"), (F.col("dist") + F.col("more")).alias("dist"))
        if moving.isEmpty():
            break
    return settled


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of a dependency graph with edges (id, depends_on): 0 without a dependency, else one more than the highest.

    Ids in a cycle, or behind one, have none.  Ids with one dependency follow
    their chain's root; the others take as many rounds as there are of them on a path.
    """
    from evalmill.sources.tables import stored

    edges = stored(edges.select("id", "depends_on").distinct(), "edges")
    single = stored(edges.groupBy("id").agg(F.count("*").alias("n"), F.max("depends_on").alias("root")).filter("n = 1 and root is not null").select("id", "root", F.lit(1).alias("dist")), "single")
    chain = stored(chain_roots(single), "chains")
    up = chain.select(F.col("id").alias("depends_on"), "root", "dist")
    wide = stored(edges.join(single.select("id"), "id", "left_anti").join(up, "depends_on", "left").select("id", F.coalesce("root", "depends_on").alias("root"), F.coalesce("dist", F.lit(0)).alias("dist")), "wide")
    done = stored(nodes.join(edges, "id", "left_anti").select("id", F.lit(0).alias("level")), "levels")
    while True:
        open_ = wide.join(done.select("id"), "id", "left_anti")
        state = open_.join(done.select(F.col("id").alias("root"), "level"), "root", "left").groupBy("id").agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.max(F.col("level").isNull()).alias("waits"))
        ready = stored(state.filter(~F.col("waits")).select("id", (F.col("level") + 1).alias("level")), "levels")
        if ready.isEmpty():
            break
        done = stored(done.union(ready), "levels")
    known = done.distinct().select(F.col("id").alias("root"), "level")
    return done.union(chain.join(known, "root").select("id", (F.col("level") + F.col("dist")).alias("level")))


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with these columns alone; one that is missing raises ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    return df.select(*columns)


def named_with_override(rows: DataFrame, given: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose name is in ``given``, with its value where that isn't null or 0."""
    theirs = given.select(name, F.col(value).alias("em_given"))
    zero = F.coalesce(F.col("em_given"), F.lit(0)) == 0
    return rows.join(theirs, name).withColumn(value, F.when(zero, F.col(value)).otherwise(F.col("em_given"))).drop("em_given")


def in_locale_order(df: DataFrame, name: str, tie: str, out: str = "place") -> DataFrame:
    """``df`` with the place of each name in the order of the Unicode collation; for lists that are shown."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.collate(F.col(name), "UNICODE"), tie)))
