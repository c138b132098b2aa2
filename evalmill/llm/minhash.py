"""Near-duplicates by circulant MinHash, banding and exact verification.

Two permutations of the 32-bit numbers make all coordinates: the first scatters
a document's shingles, the second is shifted circularly by k for coordinate k
and its least value taken.  Bands of coordinates are buckets.

Texts with equal shingle sets are one class.  In a bucket every class is paired
with one hub, the class with the largest buckets, so pairs grow with the number
of classes and not with its square; each pair is verified on full sets.  Links
make components.  Where a bucket still holds several components, the rest is
found exactly: all pairs across components in buckets of at most ``SMALL``
classes, and in larger ones a join on the rarest shingles (prefix and position
filter), which loses no pair that reaches the threshold.  The number of bands
makes the chance to miss a pair at the threshold less than ``MISS``.

Nodes are ids: rows that repeat an id are one document.  Null and empty texts
have no shingles and link with nothing.  A row with a null id follows its class
but never represents it.  Ids of any type but whole numbers stand for themselves
behind row numbers.  ``distinct_documents`` treats rows as documents, whatever
their ids.  An empty table gives no rows.  Components are found by label
propagation with pointer jumping over tables; nothing of them is collected.

Buckets, shingles, hubs and classes of very many rows meet the other side of a
join by broadcast (``joined_by_key``), so that no task gets all rows of one.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import joined_by_key, map_batches, release, scratch, small_batches
from evalmill.llm.shingles import mix, shingles

ROWS = 4
MISS = 1e-7
SMALL = 12
CHUNK = 64
_U32 = np.uint32


def bands_for(num: int, den: int) -> int:
    """The least number of bands at which a pair of similarity num/den is missed with a chance below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (num / den) ** ROWS))


def permutation(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit numbers, in place."""
    x ^= x >> _U32(16)
    x *= _U32(a)
    x ^= x >> _U32(15)
    x *= _U32(b)
    x ^= x >> _U32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k is the least of pi(sigma(x) - k) over the set, one pi for all k."""
    x = permutation((hashes >> np.uint64(32)).astype(_U32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(size, dtype=_U32)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=_U32)
    for lo in range(0, len(x), 512):
        np.minimum(out, permutation(x[None, lo : lo + 512] - shift, 0x21F0AAAD, 0xD35A2D97).min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int) -> DataFrame:
    """(doc_id, ckey, n, bands): the key of the shingle set, its size and its buckets."""

    def run(batches):
        for b in batches:
            ids, keys, n, out = b.column(0), [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(band_hashes(signature(s, bands * ROWS)) if len(s) else None)
            yield {"doc_id": ids, "ckey": keys, "n": n, "bands": out}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, ckey binary, n long, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, h) whose full sets reach the threshold.

    A hub's set meets its partners' in pieces of about CHUNK partners, so that
    no task holds all partners of a hub.
    """
    counts = scratch(pairs.groupBy("h").agg(F.count("*").alias("m")), "hubs")
    pieces = joined_by_key(pairs, counts, "h", "m").withColumn("k", F.ceil(F.col("m") / CHUNK)).select("x", "h", F.pmod(F.xxhash64("x"), F.col("k")).alias("g"))
    pieces = scratch(pieces, "pieces")
    member = pieces.join(sets.select(F.col("cid").alias("x"), "blob"), "x").select("h", "g", F.lit(1).alias("kind"), "x", "blob")
    hub = pieces.select("h", "g").distinct().join(sets.select(F.col("cid").alias("h"), "blob"), "h").select("h", "g", F.lit(0).alias("kind"), F.col("h").alias("x"), "blob")

    def run(batches):
        at, held = None, []
        for b in batches:
            xs, hs = [], []
            for h, g, kind, x, blob in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(blob, dtype=np.uint64)
                if (h, g) != at:
                    at, held = (h, g), []
                if kind == 0:
                    held.append(s)
                    continue
                for o in held:
                    small, large = (s, o) if len(s) < len(o) else (o, s)
                    i = np.searchsorted(large, small)
                    i[i == len(large)] = 0
                    both = int((large[i] == small).sum())
                    if den * both >= num * (len(s) + len(o) - both):
                        xs.append(x)
                        hs.append(h)
                        break
            yield {"x": xs, "h": hs}

    dealt = member.union(hub).repartition("h", "g").sortWithinPartitions("h", "g", "kind")
    return map_batches(dealt, run, "x long, h long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least id reachable from each end of an edge."""
    both = scratch(edges.select(F.col("x").alias("u"), F.col("h").alias("v")).union(edges.select(F.col("h").alias("u"), F.col("x").alias("v"))).distinct(), "edges")
    labels = scratch(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("far"))
        new = scratch(step.join(jump, "c", "left").select("v", F.least("c", "far").alias("c"), (F.least("c", "far") != F.col("old")).alias("moved")), "labels")
        labels = new.select("v", "c")
        if new.filter("moved").isEmpty():
            return labels


def _rare_pairs(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components that can reach the threshold, from (cid, c): exact by prefix and position filter."""

    def tokens(batches):
        for b in batches:
            for i, c, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = np.frombuffer(blob, dtype=np.int64)
                for lo in range(0, len(s), 50_000):
                    part = s[lo : lo + 50_000]
                    yield {"cid": np.full(len(part), i), "c": np.full(len(part), c), "n": np.full(len(part), len(s)), "t": part}

    rows = map_batches(rest.join(sets.dropDuplicates(["cid"]), "cid").select("cid", "c", "blob"), tokens, "cid long, c long, n long, t long")
    rows = scratch(rows, "tokens")
    count = scratch(rows.groupBy("t").agg(F.count("*").alias("df"), (F.min("c") < F.max("c")).alias("across")), "frequencies")
    order = F.row_number().over(Window.partitionBy("cid").orderBy("df", "t"))
    least = F.ceil(F.col("n") * num / den - F.lit(1e-9))
    post = joined_by_key(rows, count, "t", "df").withColumn("i", order).filter((F.col("i") <= F.col("n") - least + 1) & F.col("across")).select("t", "cid", "c", "n", "i")
    post = scratch(post, "postings")
    a, b = post.alias("a"), post.alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    # |both| >= num / (num + den) * (|a| + |b|), and at most what is left from this shared shingle on
    can = (num + den) * F.least(F.col("a.n") - F.col("a.i") + 1, F.col("b.n") - F.col("b.i") + 1) >= num * (F.col("a.n") + F.col("b.n"))
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.cid") > F.col("b.cid")) & (F.col("a.c") != F.col("b.c")) & (den * small >= num * large) & can).select(F.col("a.cid").alias("x"), F.col("b.cid").alias("h")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``; similar is num/den or more."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        keyed, found = _by_row(docs.select(id_col, text_col), text_col, size, num, den)
        named = found.join(keyed.select("em_key", F.col(id_col).alias("doc_id")), "em_key")
        least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
        named = joined_by_key(named, scratch(least, "least"), "component_id", "m")
        return named.select("doc_id", "n_shingles", F.col("least").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("doc_id").isNotNull() | (F.col("m") == 1))).alias("kept"))
    spark = docs.sparkSession
    small_batches(spark)
    sig = scratch(signatures(docs, id_col, text_col, size, bands_for(num, den)), "signatures")
    classes = scratch(sig.filter("n > 0 and doc_id is not null").groupBy("ckey").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.first("bands").alias("bands")), "classes")
    release(spark)
    in_bucket = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    several = scratch(in_bucket.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket-sizes")
    multi = scratch(joined_by_key(in_bucket, several, "bucket", "m"), "buckets")
    release(spark)
    central = multi.join(multi.groupBy("cid").agg(F.sum("m").alias("s")), "cid")
    hubs = central.groupBy("bucket").agg(F.max_by(F.struct(F.col("cid").alias("h"), F.col("n").alias("hn")), F.struct("s", -F.col("cid"))).alias("hub"), F.first("m").alias("hm")).select("bucket", "hm", "hub.*")
    hubs = scratch(hubs, "hubs")
    fits = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)  # noqa: E731 - sizes that can reach the threshold
    stars = scratch(joined_by_key(multi, hubs, "bucket", "hm").filter((F.col("cid") != F.col("h")) & fits(F.col("n"), F.col("hn"))).select(F.col("cid").alias("x"), "h").distinct(), "stars")
    release(spark)

    def blobs(batches):
        for b in batches:
            yield {"cid": b.column(0), "blob": [shingles(t, size).tobytes() for t in b.column(1).to_pylist()]}

    wanted = multi.select("cid").distinct()
    sets = scratch(map_batches(docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("t")).join(wanted.hint("merge"), "cid", "left_semi"), blobs, "cid long, blob binary"), "sets")
    release(spark)
    links = scratch(verified(stars, sets, num, den), "links")
    release(spark)
    labels = components(links)

    held = multi.join(labels.select(F.col("v").alias("cid"), "c"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    held = scratch(held, "held")
    open_ = scratch(held.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.first("m").alias("om")).filter("lo < hi and om > 2").select("bucket", "om"), "open")
    rest = scratch(joined_by_key(held, open_, "bucket", "om").drop("om"), "rest")
    few = rest.filter(F.col("m") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.cid") > F.col("b.cid")) & (F.col("a.c") != F.col("b.c")) & fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.cid").alias("x"), F.col("b.cid").alias("h")).distinct()
    pairs = pairs.union(_rare_pairs(rest.filter(F.col("m") > SMALL).select("cid", "c").distinct(), sets, num, den)).distinct()
    done = stars.select("x", "h").union(stars.select(F.col("h").alias("x"), F.col("x").alias("h")))
    pairs = scratch(pairs.join(done, ["x", "h"], "left_anti"), "pairs")
    release(spark)
    if not pairs.isEmpty():
        more = scratch(verified(pairs, sets, num, den), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
        release(spark)
    of_class = classes.join(labels.select(F.col("v").alias("cid"), "c"), "cid", "left").join(sig.filter("n > 0").groupBy("ckey").agg(F.count("*").alias("m")), "ckey", "right").select("ckey", F.coalesce("c", "cid").alias("c"), "m")
    some = joined_by_key(sig.filter("n > 0").select("doc_id", "n", "ckey"), scratch(of_class, "classes-of"), "ckey", "m").select("doc_id", "n", "c")
    out = some.union(sig.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.col("c").isNull()).alias("kept"))


def _by_row(docs: DataFrame, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a number for each row, ``em_key``, and (em_key, n_shingles, component_id) of the rows."""
    keyed = scratch(docs.withColumn("em_key", F.monotonically_increasing_id()), "numbered")
    return keyed, near_duplicates(keyed, "em_key", text_col, size, num, den).select(F.col("doc_id").alias("em_key"), "n_shingles", "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component of similar texts, that of the least id (a null id is the greatest; of equal ids one row), and all rows without words.

    Rows are documents: rows with null or repeated ids are held against others like any.
    """
    keyed, found = _by_row(docs, text_col, size, num, den)
    named = found.join(keyed.select("em_key", F.col(id_col).alias("id")), "em_key")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "em_key")).alias("best")).select("best.em_key")
    return keyed.join(scratch(kept, "kept").hint("merge"), "em_key", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
