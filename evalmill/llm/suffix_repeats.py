"""Exact substring deduplication by common-prefix intervals of enhanced suffix arrays.

A string of ``length`` bytes that occurs twice holds, in both places, the same
anchor: the least hash among its 64-byte grams, the leftmost of equals.  So the
windows of a text fall into runs with one anchor each, and only suffixes at
anchors with the same gram need be compared.

* Runs equal as whole segments, by a 64-bit hash beside that of the gram, are one
  entry with its number of occurrences, counted with partial aggregation: copies
  never meet in one task.  An entry of several occurrences has an interval of
  its own, the whole segment.
* Entries that differ but share the gram form a group.  Its suffixes from the
  anchor on, sorted, with the longest common prefixes of neighbours, are an
  enhanced suffix array; a stack scan yields the common-prefix intervals, and
  within each the left contexts are arranged the same way, so that each pair of
  intervals is a repeat that can be extended neither right nor left: a maximal
  repeat group with all its occurrences, not just neighbours.
* A group of more than ``group`` entries isn't gathered.  A repeat that reaches
  l bytes left of the anchor and r bytes right has l + r >= ``length``, so it is
  among the entries that share the next half of what is missing on the right, or
  among those that share the rest on the left.  Both kinds are groups by a longer
  shared context, again and again until they are small; one that already shares
  ``length`` bytes is an interval itself.  For the spans, entries are cut to the
  windows around their context, and equal ones go on as one.

``repeat_groups`` returns the maximal groups with every occurrence, ``removal``
what is left of each text.

Texts are UTF-8; null is empty.  Texts shorter than ``length`` keep all bytes.
Rows with equal texts, with or without equal ids, repeat each other.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import BROADCAST_ROWS, append_columns, discard, joined_by_key, map_batches, release, scratch, small_batches
from evalmill.llm.shingles import _BYTES, mix, powers

LENGTH = 400
GRAM = 64
GROUP = 256
#: Bits of a key that hold the place; longer texts are cut in overlapping parts.
PLACE = 20
_U = np.uint64


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place, by doubling."""
    h, s = _BYTES[raw], 1
    while s < gram:
        h = h[:-s] * _U(0x9E3779B97F4A7C15) + h[s:]
        h ^= h >> _U(29)
        s *= 2
    return mix(h)


def runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, anchor, gram hash) of the runs of windows with one anchor."""
    part = (1 << PLACE) - length
    width = length - gram + 1
    for lo in range(0, len(raw) - length + 1, part):
        h = gram_hashes(raw[lo : lo + part + length - 1], gram)
        key = (h & ~_U((1 << PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
        span, n = 1, len(h) - width + 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[:n], key[width - span : width - span + n])
        anchor = (key & _U((1 << PLACE) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(anchor))
        first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [n - 1]])
        yield lo + first, lo + last, lo + anchor[first], h[anchor[first]].view(np.int64)


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes and a number."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return mix(h + extra.astype(np.uint64)).view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals, by one scan with a stack; lcp[i] is of entries i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if not stack or stack[-1][0] < value:
            stack.append((value, first))


def maximal_repeats(segments: list[tuple[bytes, int]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from it on, members) of the maximal repeats around the anchor of ``length`` or more.

    ``segments``: distinct ones, each with its anchor's place.
    """
    right = [s[a:] for s, a in segments]
    left = [s[:a][::-1] for s, a in segments]
    order = sorted(range(len(segments)), key=right.__getitem__)
    lcp = [common(right[x], right[y]) for x, y in zip(order, order[1:], strict=False)]
    rank = {m: k for k, m in enumerate(sorted(range(len(segments)), key=left.__getitem__))}
    for r, lo, hi in intervals(lcp):
        need = length - r
        members = [m for m in order[lo : hi + 1] if len(left[m]) >= need]
        if len(members) < 2 or r <= 0:
            continue
        members.sort(key=rank.__getitem__)
        if need <= 0:
            need = 0
        sides = [common(left[x], left[y]) for x, y in zip(members, members[1:], strict=False)]
        for n, a, b in intervals(sides):
            if n >= need:  # the members' next bytes to the left differ, as those to the right do: maximal
                yield n, r, members[a : b + 1]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(id, th, nb, gram, seg, s, e, a): the runs of each text with hashes of gram and segment."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, th, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
                if len(raw) < length:
                    continue
                for s, e, a, g in runs(raw, length):
                    out.append((np.full(len(s), i), np.full(len(s), th), np.full(len(s), len(raw)), g, stretch_hashes(raw, s, e + length, a - s), s, e, a))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 8
            yield dict(zip(("id", "th", "nb", "gram", "seg", "s", "e", "a"), cols, strict=True))

    return map_batches(texts.select("id", "th", "t"), run, "id long, th long, nb long, gram long, seg long, s int, e int, a int")


_ENTRY = "key long, gram long, h long, c long, th long, nb long, s int, e int, a int, l int, r int, seg binary"
_FIELDS = [x.split()[0] for x in _ENTRY.split(", ")]


def columns(rows: list, names: list[str]) -> dict[str, list]:
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return dict(zip(names, map(list, cols), strict=True))


def in_pieces(rows: Iterator[tuple], names: list[str], most: int = 1 << 20) -> Iterator[dict[str, list]]:
    """Columns of rows with a text in the field ``seg``, about ``most`` bytes at a time: segments overlap, so they are much more than the texts they come from."""
    at, held, size = names.index("seg"), [], 0
    for r in rows:
        held.append(r)
        size += len(r[at]) + 100
        if size >= most:
            yield columns(held, names)
            held, size = [], 0
    yield columns(held, names)


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted entries with the text of their segment; they share the gram, ``l`` = 0 bytes left of the anchor and ``r`` right."""
    lists = wanted.groupBy("id", "th", "nb").agg(F.collect_list(F.struct("gram", "seg", "c", "s", "e", "a", "k")).alias("w"))

    def entries(batches):
        for b in batches:
            for th, nb, t, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (t or "").encode()
                for x in w:
                    yield (x["gram"], x["gram"], x["seg"], x["c"], th, nb, x["s"], x["e"], x["a"], 0, GRAM, raw[x["s"] : x["e"] + length], x["k"])

    def run(batches):
        return in_pieces(entries(batches), [*_FIELDS, "k"])

    # of equal texts only that of the least id is cut; rows that repeat it are one entry of a group
    joined = texts.join(lists.hint("merge"), ["id", "th", "nb"]).select("th", "nb", "t", "w")
    return map_batches(joined, run, f"{_ENTRY}, k long")


def _split(entries: DataFrame, length: int, clip: bool = False) -> DataFrame:
    """The entries of large groups by longer contexts: the next half on the right, or what a repeat that ends before it has on the left.

    With ``clip`` an entry keeps only its windows around the context, and ``h`` is a hash of them.
    """

    def parts(batches):
        for b in batches:
            for key, gram, h, c, th, nb, s, e, a, left, right, seg in zip(*(b.column(i).to_pylist() for i in range(len(_FIELDS))), strict=True):
                missing = length - left - right
                half = (missing + 1) // 2
                for x, y in ((left, right + half), (left + missing - half + 1, right)):
                    if x <= a - s and a - s + y <= len(seg):
                        shared = xxhash.xxh3_64_intdigest(seg[a - s - x : a - s + y], seed=(key * 8191 + x) & 0xFFFFFFFFFFFFFFFF)
                        if not clip:
                            yield (shared - (1 << 63), gram, h, c, th, nb, s, e, a, x, y, seg)
                            continue
                        lo, hi = max(s, a + y - length), min(e, a - x)
                        near = seg[lo - s : hi - s + length]
                        yield (shared - (1 << 63), gram, xxhash.xxh3_64_intdigest(near, seed=(shared + a - lo) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), c, th, nb, lo, hi, a, x, y, near)

    def run(batches):
        return in_pieces(parts(batches), _FIELDS)

    return map_batches(entries.select(_FIELDS), run, _ENTRY)


def _large_spans(large: DataFrame, length: int, group: int) -> Iterator[DataFrame]:
    """(th, nb, start, end) of the entries of one occurrence in groups of more than ``group``, level by level; ``large`` is discarded.

    A context's entries are cut to the windows around it, and equal ones are one
    entry with their occurrences, repeated as a whole: copies that differ elsewhere
    go on as one, so that a level has about as many rows as there are differences.
    Windows of ``length`` bytes are all equal at last.  What is yielded must be
    written before the next is asked for.
    """
    spark = large.sparkSession
    place = [c for c in _FIELDS if c not in ("key", "h", "c")]
    while not large.isEmpty():
        rows = scratch(_split(large, length, clip=True), "split")
        discard(large)
        classes = scratch(rows.groupBy("key", "h").agg(F.sum("c").alias("c"), F.count("*").alias("m"), F.first(F.struct(*place)).alias("at")).select("key", "h", "c", "m", "at.*"), "classes")
        release(spark)
        yield joined_by_key(rows.filter("c = 1").select("h", "th", "nb", "s", "e"), classes.filter("m > 1").select("h", "m"), "h", "m").select("th", "nb", F.col("s").alias("start"), (F.col("e") + length).alias("end"))
        discard(rows)
        n = scratch(classes.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "sizes")
        yield reaches(joined_by_key(classes, n.filter(F.col("k") <= group), "key", "k"), length)
        large = scratch(joined_by_key(classes, n.filter(F.col("k") > group), "key", "k").select(_FIELDS), "large")
        discard(classes)
        release(spark)
    discard(large)


def _groups(grouped: DataFrame, length: int, group: int) -> Iterator[tuple[bool, DataFrame]]:
    """(False, entries of groups of 2 to ``group`` entries) and (True, those of larger groups that share ``length`` bytes), from entries with their group's size ``k``.

    What is yielded must be written before the next is asked for.
    """
    yield False, grouped.filter(F.col("k") <= group)
    large = scratch(grouped.filter(F.col("k") > group).select(_FIELDS), "large")
    discard(grouped)
    while not large.isEmpty():
        rows = scratch(_split(large, length), "split")
        discard(large)
        n = scratch(rows.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "sizes")
        several = joined_by_key(rows, n, "key", "k")
        yield False, several.filter(F.col("k") <= group)
        yield True, several.filter((F.col("k") > group) & (F.col("l") + F.col("r") >= length))
        large = scratch(several.filter((F.col("k") > group) & (F.col("l") + F.col("r") < length)).select(_FIELDS), "large")
        discard(rows)
        release(rows.sparkSession)
    discard(large)


def arranged(rows: list[tuple], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from it on, places in ``rows``) of the maximal repeats of a group's entries."""
    held: dict[tuple[bytes, int], int] = {}
    for k, r in enumerate(rows):
        held.setdefault((r[11], r[8] - r[6]), k)
    members = list(held)
    if len(members) > 1:
        for left, right, found in maximal_repeats(members, length):
            yield left, right, [held[members[m]] for m in found]


def _by_group(entries: DataFrame, fn, schema: str) -> DataFrame:
    """What ``fn`` yields for the rows of each group; names of columns are those of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        at, rows, out = None, [], []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(len(_FIELDS))), strict=True):
                if r[0] != at:
                    out += fn(rows) if rows else []
                    at, rows = r[0], []
                rows.append(r)
            if len(out) > 20_000:
                yield columns(out, names)
                out = []
        out += fn(rows) if rows else []
        yield columns(out, names)

    return map_batches(entries.select(_FIELDS).repartition("key").sortWithinPartitions("key"), run, schema)


def reaches(entries: DataFrame, length: int) -> DataFrame:
    """(th, nb, start, end) of each entry of one occurrence that has a maximal repeat: all its repeats hold the anchor, so their union is one span."""

    def spans(rows):
        reach: dict[int, tuple[int, int]] = {}
        for left, right, group in arranged(rows, length):
            for m in group:
                x, y = reach.get(m, (0, 0))
                reach[m] = max(x, left), max(y, right)
        return [(rows[m][4], rows[m][5], rows[m][8] - left, rows[m][8] + right) for m, (left, right) in reach.items() if rows[m][3] == 1]

    return _by_group(entries, spans, "th long, nb long, start int, end int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their text ``t`` and its key: a hash and the number of bytes."""
    return docs.select(F.col(id_col), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("id"), F.col(text_col).alias("t")).withColumns({"th": F.xxhash64(F.coalesce("t", F.lit(""))), "nb": F.coalesce(F.octet_length("t").cast("long"), F.lit(0).cast("long"))})


class _Parts:
    """What the removal and the groups are made of: runs, entries (gram, seg, c, at), and numbers ``k`` of entries of the grams that have several."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int):
        small_batches(docs.sparkSession)
        texts = _keyed(docs, id_col, text_col).select("id", "th", "nb", "t")
        self.runs = scratch(_anchors(texts, length), "runs")
        place = F.struct("id", "th", "nb", "s", "e", "a")
        self.entries = scratch(self.runs.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.min(place).alias("at")), "segments")
        release(docs.sparkSession)
        self.texts, self.length = texts, length
        self.several = self.entries.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1")

    def cut(self) -> DataFrame:
        """The entries of groups of several, with their text and the group's size ``k``."""
        wanted = self.entries.join(self.several, "gram").select("gram", "seg", "c", "at.*", "k")
        return _cut(self.texts, wanted, self.length)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(th, nb, spans) of the texts with repeated bytes."""
    spark = docs.sparkSession
    p = _Parts(docs, id_col, text_col, length)
    whole = p.runs.join(p.entries.filter("c > 1").select("gram", "seg"), ["gram", "seg"], "left_semi").select("th", "nb", F.col("s").alias("start"), (F.col("e") + length).alias("end")).distinct()
    found = scratch(whole, "whole")
    discard(p.runs)
    release(spark)
    grouped = scratch(p.cut(), "grouped")
    discard(p.entries)
    release(spark)
    found = found.union(scratch(reaches(grouped.filter(F.col("k") <= group), length), "spans"))
    release(spark)
    large = scratch(grouped.filter(F.col("k") > group).select(_FIELDS), "large")
    discard(grouped)
    for ends in _large_spans(large, length, group):
        found = found.union(scratch(ends, "spans"))
        release(spark)
    return found.groupBy("th", "nb").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(``group``, length, n_occurrences, ``id_col``, start): the maximal repeat groups of ``length`` bytes or more around each anchor, a row an occurrence.

    Copies of an entry are occurrences of all its groups.  A group of more than
    ``group`` entries that share ``length`` bytes comes as it is, not extended.
    """
    p = _Parts(docs, id_col, text_col, length)
    schema = "group long, gram long, seg long, left int, right int"

    def named(r, left, right):
        """The group of the bytes around the anchor; the same for all groups of entries in which it is found."""
        at = r[8] - r[6]
        return xxhash.xxh3_64_intdigest(r[11][at - left : at + right], seed=left) - (1 << 63)

    def members(rows):
        return [(named(rows[found[0]], left, right), rows[m][1], rows[m][2], left, right) for left, right, found in arranged(rows, length) for m in found]

    def windows(batches):
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(len(_FIELDS))), strict=True))
            yield columns([(named(r, r[9], r[10]), r[1], r[2], r[9], r[10]) for r in rows], [x.split()[0] for x in schema.split(", ")])

    found = docs.sparkSession.createDataFrame([], schema)
    for whole_window, part in _groups(scratch(p.cut(), "grouped"), length, group):
        found = found.union(scratch(map_batches(part.select(_FIELDS), windows, schema) if whole_window else _by_group(part, members, schema), "groups"))
    found = found.distinct()
    entry = [F.xxhash64("gram", "seg").alias("group"), "gram", "seg", (F.col("at.a") - F.col("at.s")).alias("left"), (F.col("at.e") + length - F.col("at.a")).alias("right")]
    whole = p.entries.filter("c > 1").select(*entry).join(found.select("gram", "seg", "left", "right"), ["gram", "seg", "left", "right"], "left_anti").select(found.columns)
    found = scratch(found.union(whole), "members")
    names = _keyed(docs, id_col, text_col).select("id", "th", "nb", F.col(id_col).alias("em_name")).distinct()
    places = found.join(p.runs, ["gram", "seg"]).select("group", (F.col("left") + F.col("right")).alias("length"), "id", "th", "nb", (F.col("a") - F.col("left")).alias("start"))
    count = places.groupBy("group").agg(F.count("*").alias("n_occurrences"))
    return places.join(count, "group").join(names, ["id", "th", "nb"]).select("group", "length", "n_occurrences", F.col("em_name").alias(id_col), "start")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(keyed: DataFrame, spans: DataFrame, hot: int = 1000, most: int = 1_000_000) -> DataFrame:
    """``keyed`` with the spans of its texts, or null.  Texts of very many rows meet their spans by broadcast, if these are ``most`` at most."""
    often = scratch(keyed.groupBy("th", "nb").agg(F.count("*").alias("em_n")).filter(F.col("em_n") > hot).orderBy(F.desc("em_n"), "th", "nb").limit(BROADCAST_ROWS).select("th", "nb"), "often")
    theirs = spans.join(F.broadcast(often), ["th", "nb"])
    if often.isEmpty() or (theirs.agg(F.sum(F.size("spans"))).first()[0] or 0) > most:
        return keyed.join(spans.hint("merge"), ["th", "nb"], "left")
    many = keyed.join(F.broadcast(often), ["th", "nb"]).join(F.broadcast(theirs), ["th", "nb"], "left")
    few = keyed.join(F.broadcast(often), ["th", "nb"], "left_anti")
    return many.unionByName(few.join(spans.hint("merge"), ["th", "nb"], "left"))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row."""
    spans = repeated_spans(docs, id_col, text_col, length, group)
    keyed = _keyed(docs, id_col, text_col)
    joined = _with_spans(keyed, scratch(spans, "lists")).select(id_col, "t", "nb", "spans")

    def run(texts, lists):
        removed, n, kept = [], [], []
        for t, s in zip(texts, lists, strict=True):
            raw, runs_ = (t or "").encode(), merge([(x["start"], x["end"]) for x in s or ()])
            at, out = 0, []
            for a, b in runs_:
                out.append(raw[at:a])
                at = b
            removed.append(sum(b - a for a, b in runs_))
            n.append(len(runs_))
            kept.append(b"".join([*out, raw[at:]]))
        return {"n_removed": removed, "n_spans": n, "kept": kept}

    fields = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])
    return append_columns(joined, ["t", "spans"], run, fields).select(id_col, F.col("nb").alias("n_bytes"), "n_removed", "n_spans", "kept")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by listing every window; for tests."""
    raw = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, dtype=int)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        on = np.cumsum(hit)[: len(r)] > 0
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~on])
        n = int(np.count_nonzero(np.diff(np.concatenate([[0], on.astype(int)])) == 1))
        out.append((len(r), int(on.sum()), n, hashlib.sha256(kept).hexdigest()))
    return out
