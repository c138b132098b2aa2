"""Language-model scores by a hierarchical Pitman-Yor model.

Each word has a restaurant for every word that comes before it (the start of a
text is one, too).  The tables of these context restaurants are the customers of
one restaurant of words, their common parent.  Its tables are the customers of
restaurants that spell a word byte by byte, given the byte before; their parent
is one restaurant of bytes, and its base is uniform.

Seating is sampled by Gibbs sweeps.  A customer leaves: it sat alone with the
probability that the seatings of its dish, given customers and tables, give
(a ratio of generalised Stirling numbers), and then its table closes.  It is
seated again by the Chinese-restaurant rule: a table of its dish in proportion
to those seated less a discount a table, or a new one in proportion to strength,
tables and the parent's probability.  In a sweep every customer of each dish
moves, one after the other, all dishes side by side given the totals of the sweep
before; moves that leave a dish its number of tables are skipped by one draw.
Tables that open or close below add and take away customers above.
After burn-in, predictive probabilities of words in contexts are averaged.

Random numbers belong to the word or pair (its 64-bit hash) and the step, sums
are sums of integers, and a text's is taken over its own tokens in order: scores
are the same for any number of partitions and any order of rows.

Counts cover all training texts.  A block of texts keeps its words and their
order; it asks the buckets of all pairs, and the buckets of all words, by sorted
hashes, and gets back arrays in the same order, so that only packed numbers
travel.  A bucket has about ``SPREAD`` entries, a number of buckets that grows
with the input; a pair or word of any frequency is one entry a block.  Only byte
cells (257 x 257) and a few totals reach the driver.  Words and pairs are told
apart by 64-bit hashes.

Null texts are empty: one end token.  Repeated rows are scored alike.  With no
training text, only the uniform base is left.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import discard, map_batches, release, remove, scratch, small_batches
from evalmill.llm.shingles import mix

#: Tokens of a block; the entries that a bucket has, about.
BLOCK = 1_250_000
SPREAD = 1 << 18
END = b"\n"
SYMBOLS = 257  # bytes, and the border of a word
SWEEPS, BURN_IN = 3, 1
BYTE_SWEEPS, BYTE_BURN_IN = 8, 3
STRENGTH = 1.0
#: Customers of a dish up to which the chance to sit alone comes from a table; beyond, from the saddle point, which errs there by less than 2e-3, and by a seventh of the chance at most (few tables and the least discount).
EXACT = 512
#: Dishes of a sweep up to which each ends its moves by itself; the tables are the same.
FEW = 64
#: A word's base probability is 2 ** (-q / OCTAVE) with a whole q.
OCTAVE, LAST = 64, 65535
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def tokens_of(text: str | None) -> list[bytes]:
    return [*_WORD.findall(text.encode().lower()), END] if text else [END]


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: The context of a text's first word; no word is empty.
START = key_of(b"")


# Numbers as bytes -----------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, as many as the largest needs."""
    x = np.ascontiguousarray(x, dtype="<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    k = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(k, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :k] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def pack_less(x: np.ndarray, of: np.ndarray) -> bytes:
    """Numbers near those of ``of``, by their differences."""
    less = of - x
    return pack((less << 1) ^ (less >> 63))


def unpack_less(raw: bytes, of: np.ndarray) -> np.ndarray:
    less = unpack(raw)
    return of - ((less >> 1) ^ -(less & 1))


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers, by their differences."""
    return pack(np.diff(x, prepend=_U(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """Buckets of ascending keys, by their upper bits, and the edges between."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    return bucket[np.concatenate([[0], edge])] if len(keys) else bucket, [0, *edge.tolist(), len(keys)]


def bits_for(entries: int) -> int:
    return max(0, (max(1, entries) // SPREAD).bit_length())


def order_of(h: np.ndarray) -> np.ndarray:
    """What ``argsort`` gives; numbers and places are sorted together, which is much faster."""
    low = _U((1 << max(1, len(h)).bit_length()) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    by = h[order]
    return order if (by[1:] >= by[:-1]).all() else np.argsort(h, kind="stable")


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct numbers, the first place of each, and the rank of every number."""
    order = order_of(h)
    new = np.concatenate([[True], np.diff(h[order]) != 0])[: len(h)]
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return h[order[new]], order[new], rank


# Seating --------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _stirling(d: float) -> np.ndarray:
    """[c, t]: chance that a customer is alone, S(c-1, t-1) / S(c, t) of generalised Stirling numbers of discount d."""
    t = np.arange(EXACT + 1)
    log, out = np.full(EXACT + 1, -np.inf), np.zeros((EXACT + 1, EXACT + 1))
    log[1], out[1, 1] = 0.0, 1.0
    for c in range(2, EXACT + 1):
        alone = np.concatenate([[-np.inf], log[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            joined = np.where(t < c, np.log(np.maximum(c - 1 - d * t, 1e-300)) + log, -np.inf)
            new = np.logaddexp(alone, joined)
            out[c] = np.where(np.isfinite(new), np.exp(alone - new), 0.0)
        log = new
    return out


@lru_cache(maxsize=8)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log((c - 1) / (t - 1)), ascending, and the logarithm of the chance to be alone, [z^(c-1)] G^(t-1) / [z^(c-1)] G^(t-1) G', by the saddle point z G'(z) / G(z) = (c - 1) / (t - 1) of G(z) = (1 - (1 - z)^d) / d."""
    y = -np.geomspace(1e-12, 700, 1 << 16)  # log(1 - z)
    return np.log(d * np.expm1(y) / np.expm1(d * y)) + (d - 1) * y, (1 - d) * y


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Chance that one of ``c`` customers of a dish with ``t`` tables sits alone."""
    small = c <= EXACT
    if small.all():
        return _stirling(d)[c, t]
    out = _stirling(d)[np.where(small, c, 1), np.where(small, t, 1)]
    at = np.flatnonzero(~small)
    n, k = c[at].astype(float), t[at].astype(float)
    r = np.exp(np.interp(np.log((n - 1) / np.maximum(k - 1, 1)), *_saddle(d)))
    out[at] = np.where(k == 1, 0.0, np.where(k == n, 1.0, np.minimum(r, 1.0)))
    return out


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each key."""
    return (mix(key + _U(step * _GOLD & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53


def join(n: np.ndarray, t: np.ndarray, to: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, key: np.ndarray, step: int) -> np.ndarray:
    """Tables after ``n`` customers have become ``to``; many come or go an eighth at a time, the first opens a table.

    ``others`` are tables of the restaurant's other dishes, ``base`` is the parent's probability.
    """
    n, t = n.copy(), t.copy()
    t[to == 0] = 0
    n[to == 0] = 0
    first = (n == 0) & (to > 0)
    t[first] = n[first] = 1
    at = np.flatnonzero(n != to)
    while len(at):
        step += 1
        have, goal, tables = n[at], to[at], t[at]
        u = uniform(key[at], step)
        few = np.maximum(1, have // 8)
        m = np.minimum(np.abs(goal - have), few)
        a = (STRENGTH + d * (others[at] + tables)) * base[at]
        comes = goal > have
        p = np.where(comes, a / (a + np.maximum(have - d * tables, 1e-9)), alone(have, tables, d))
        change = np.floor(m * p + u).astype(np.int64)
        n[at] = have + np.where(comes, m, -m)
        t[at] = np.clip(tables + np.where(comes, change, -change), 1, n[at])
        at = at[n[at] != goal]
    return t


def rates(n: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Chances that a move closes a table, and that it closes or opens one."""
    lone = alone(n, t, d)
    less, same = (STRENGTH + d * (others + t - 1)) * base, np.minimum(t, n - 1)  # if all sit alone, the one that leaves does
    close = lone * (1 - less / (less + (n - 1) - d * (t - 1)))
    more = (STRENGTH + d * (others + same)) * base
    return close, close + (1 - lone) * more / (more + (n - 1) - d * same)


def sweep(c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, key: np.ndarray, step: int) -> np.ndarray:
    """Tables after all customers of each dish have left and sat down again, one after the other.

    A move closes a table, opens one or leaves their number as it is; how many
    of the last kind come before one that doesn't is drawn at once.
    """
    t = t.copy()
    at = np.flatnonzero(c > 1)
    n, o, p, k, now, moves = c[at], others[at], base[at], key[at], t[at], c[at]
    step <<= 32  # a dish may take as many numbers as it has customers
    while len(at) > FEW:
        close, change = rates(n, now, o, p, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            wait = np.where(change > 0, np.log1p(-uniform(k, step)) / np.log1p(-change), np.inf)
        on = np.flatnonzero(wait < moves)  # the moves before the one that changes
        t[at] = now
        at, n, o, p, k = at[on], n[on], o[on], p[on], k[on]
        now = now[on] + np.where(uniform(k, step + 1) * change[on] < close[on], -1, 1)
        moves = moves[on] - np.floor(wait[on]).astype(np.int64) - 1
        step += 2
    for i in range(len(at)):
        t[at[i]] = moved(int(n[i]), int(now[i]), o[i], p[i], d, k[i], step, int(moves[i]))
    return t


def moved(n: int, t: int, others, base, d: float, key: np.uint64, step: int, moves: int) -> int:
    """Tables of one dish after ``moves``, with the numbers that ``sweep`` takes: chances are listed for the tables around, and looked up."""
    size, first, at, drawn = 32, 1, 0, 0  # listed are the tables from ``first`` on
    close, change, log_same, waits, turns = [], [], [], [], []
    while True:
        if not 0 <= t - first < len(close):
            first = max(1, t - size // 2)
            near = np.arange(first, min(n, first + size) + 1)
            x, y = rates(np.full(len(near), n), near, np.full(len(near), others), np.full(len(near), base), d)
            with np.errstate(divide="ignore"):
                close, change, log_same = x.tolist(), y.tolist(), np.log1p(-y).tolist()
        if at == drawn:
            steps = _U(step & 0xFFFFFFFFFFFFFFFF) + np.arange(2 * size, dtype=np.uint64)
            u = (mix(key + steps * _U(_GOLD)) >> _U(11)).astype(np.float64) * 2.0**-53
            waits, turns = np.log1p(-u[::2]).tolist(), u[1::2].tolist()
            step, at, drawn = step + 2 * size, 0, size
            size = min(2 * size, 4096)
        i = t - first
        wait = waits[at] / log_same[i] if change[i] > 0 else math.inf
        if not wait < moves:
            return t
        t += -1 if turns[at] * change[i] < close[i] else 1
        moves -= math.floor(wait) + 1
        at += 1


def share(one: int, two: int) -> float:
    """Discount from how many have one and two customers, kept inside (0, 1)."""
    return float(np.clip(one / (one + 2 * two) if one else 0.5, 0.1, 0.95))


def chain(c: np.ndarray, t: np.ndarray, tu: np.ndarray, p: np.ndarray, d: float, key: np.ndarray, k: int) -> np.ndarray:
    """Tables of pairs after sweep ``k``, given the context's tables ``tu`` and the word's probability ``p``."""
    others = np.maximum(tu - t, 0)
    if k == 0:
        t = join(np.ones_like(c), t, c, others, p, d, key, 1000)
    return sweep(c, t, others, p, d, key, k + 1)


# Spelling -------------------------------------------------------------------------------------------


def spelled(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of the symbol before and the symbol, word) of each byte and the closing border of each word."""
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1]) if len(ends) else 0
    symbol = np.full(n, SYMBOLS - 1, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends - 1] = False
    symbol[inside] = raw
    before = np.concatenate([[SYMBOLS - 1], symbol[:-1]])[:n]  # a border stands before the first byte
    return before * SYMBOLS + symbol, np.repeat(np.arange(len(sizes)), sizes + 1)


class Spelling:
    """-log2 P(symbol | symbol before), averaged over Gibbs samples, from the customers of each cell."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        n = SYMBOLS
        cell = np.flatnonzero(counts)
        c, row, dish = counts[cell], cell // n, cell % n
        key = mix((cell + seed * n * n).astype(np.uint64))
        top = mix((np.arange(n) + (seed + 1) * n**3).astype(np.uint64))
        d1 = share(int((c == 1).sum()), int((c == 2).sum()))
        t = np.ones(len(cell), dtype=np.int64)
        c0, t0 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        total, sums = np.bincount(row, c, n), np.zeros((n, n))
        d0 = 0.5
        for k in range(BYTE_SWEEPS):
            now = np.bincount(dish, t, n).astype(np.int64)
            some = np.flatnonzero(now)
            others = np.maximum(t0.sum() - t0, 0)
            t0 = join(c0, t0, now, others, np.full(n, 1 / n), d0, top, 1000 * k + 500)
            c0 = now
            t0[some] = sweep(c0[some], t0[some], (t0.sum() - t0)[some], np.full(len(some), 1 / n), d0, top[some], 1000 * k)
            p0 = (c0 - d0 * t0 + (STRENGTH + d0 * t0.sum()) / n) / (c0.sum() + STRENGTH)
            tables = np.bincount(row, t, n).astype(np.int64)
            if k == 0:
                t = join(np.ones_like(c), t, c, tables[row] - t, p0[dish], d1, key, 500)
            tables = np.bincount(row, t, n).astype(np.int64)
            t = sweep(c, t, tables[row] - t, p0[dish], d1, key, 1000 * k + 100)
            if k >= BYTE_BURN_IN:
                tables = np.bincount(row, t, n)
                p1 = ((STRENGTH + d1 * tables) / (total + STRENGTH))[:, None] * p0[None, :]
                p1[row, dish] += (c - d1 * t) / (total[row] + STRENGTH)
                sums += p1
        self.bits = -np.log2(sums / (BYTE_SWEEPS - BYTE_BURN_IN)).ravel()

    def base(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """q of each word."""
        cell, owner = spelled(raw, sizes)
        return np.clip(np.rint(OCTAVE * np.bincount(owner, self.bits[cell], len(sizes))), 0, LAST).astype(np.int64)


def gathered(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``raw``, one after the other."""
    ends = np.cumsum(sizes)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


# Blocks ---------------------------------------------------------------------------------------------

WORDS, TEXTS = 0, 1


def encode(docs: DataFrame, id_col: str, text_col: str, held_col: str) -> DataFrame:
    """Two rows a block: its words by ascending hash (WORDS: keys, tokens, sizes, counts), and its texts as codes of them (TEXTS, with the keys once more; ``cnt``: all occurrences, by which codes are ranked)."""
    schema = T._parse_datatype_string("kind int, part long, keys binary, tokens binary, sizes binary, cnt binary, held array<boolean>, lens binary, codes binary")
    schema = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))])

    def run(batches):
        task, block = TaskContext.get().partitionId(), 0
        ids, held, lens, words = [], [], [], []

        def flush():
            coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
            book = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END, b""], pa.binary())])
            keys = np.fromiter(map(key_of, book.to_pylist()), dtype=np.uint64, count=len(book))
            order = np.argsort(keys)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            n = np.concatenate(lens) + 1  # with the end
            flat, last = np.empty(int(n.sum()), dtype=np.int64), np.zeros(int(n.sum()), dtype=bool)
            last[np.cumsum(n) - 1] = True
            flat[last], flat[~last] = rank[-2], rank[coded.indices.to_numpy()]
            taught = np.repeat(~np.array(held, dtype=bool), n)
            book = book.take(pa.array(order))
            none, part, packed = [None], [(task << 24) + block], pack_sorted(keys[order])
            empty = dict.fromkeys(schema.names, none)
            yield empty | {"kind": [WORDS], "part": part, "keys": [packed], "tokens": [b"".join(book.to_pylist())], "sizes": [pack(pc.binary_length(book).to_numpy())], "cnt": [pack(np.bincount(flat[taught], minlength=len(book)))]}
            often = np.bincount(flat, minlength=len(book))
            place = np.empty(len(book), dtype=np.int64)
            place[by_count(often)] = np.arange(len(book))
            yield empty | {"kind": [TEXTS], "part": part, "keys": [packed], "cnt": [pack(often)], "ids": [ids], "held": [held], "lens": [pack(n)], "codes": [pack(place[flat])]}

        for batch in batches:
            if not batch.num_rows:
                continue
            found = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(1).cast(pa.string())))
            flat, n = found.flatten(), pc.list_value_length(found).fill_null(0).to_numpy().astype(np.int64)
            some = pc.not_equal(pc.binary_length(flat), 0)
            upto, end = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))]), np.cumsum(n)
            words.append(flat.filter(some))
            lens.append(upto[end] - upto[end - n])
            ids += batch.column(0).to_pylist()
            held += [bool(h) for h in batch.column(2).to_pylist()]
            if sum(map(len, words)) >= BLOCK:
                yield from flush()
                ids, held, lens, words, block = [], [], [], [], block + 1
        if ids:
            yield from flush()

    return map_batches(docs.select(F.col(id_col), F.col(text_col), F.col(held_col)), run, schema)


def by_count(often: np.ndarray) -> np.ndarray:
    """Words, the most frequent first: their codes are small, and packed in less room."""
    return np.argsort(-often, kind="stable")


def decoded(cnt: bytes, codes: bytes) -> np.ndarray:
    """The words of the tokens, as places among the keys."""
    return by_count(unpack(cnt))[unpack(codes)]


class Pairs:
    """The pairs of a block by ascending hash: ``a`` and ``b`` (places of the words), ``h``, training count ``cnt``, and the pair of each token in ``at``."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, lens: np.ndarray, held: list[bool]):
        before = np.concatenate([[0], codes[:-1]])
        first = np.cumsum(lens) - lens
        before[first] = np.searchsorted(keys, _U(START))
        h = mix(mix(keys * _U(_GOLD) + _U(1))[before] + keys[codes])
        self.h, lead, self.at = distinct(h)
        self.a, self.b = before[lead], codes[lead]
        self.cnt = np.bincount(self.at[np.repeat(~np.array(held, dtype=bool), lens)], minlength=len(lead))


def by_key(batches, width: int):
    """(key, rows) of rows that come sorted by their first column."""
    at, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(width)), strict=True):
            if r[0] != at:
                if rows:
                    yield at, rows
                at, rows = r[0], []
            rows.append(r)
    if rows:
        yield at, rows


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def counted_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    """(part, bucket, c, own, one, two): for the pairs of a block in a bucket, counts over all training texts and whether the block speaks for the pair; pairs of one and of two, once a bucket."""

    def ask(batches):
        for b in batches:
            for part, keys, held, lens, codes, cnt in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                p = Pairs(unpack_sorted(keys), decoded(cnt, codes), unpack(lens), held)
                bucket, edge = cuts(p.h, bits)
                for k, lo, hi in zip(bucket.tolist(), edge, edge[1:], strict=False):
                    yield {"bucket": [k], "part": [part], "h": [pack_sorted(p.h[lo:hi])], "cnt": [pack(p.cnt[lo:hi])]}

    def answer(batches):
        for bucket, rows in by_key(batches, 4):
            h, cnt = [unpack_sorted(r[2]) for r in rows], [unpack(r[3]) for r in rows]
            n = np.cumsum([0, *map(len, h)])
            every, _, at = distinct(np.concatenate(h))
            c = np.bincount(at, np.concatenate(cnt), len(every)).astype(np.int64)
            speaker = np.full(len(every), -1)
            for i in range(len(rows) - 1, -1, -1):
                speaker[at[n[i] : n[i + 1]][cnt[i] > 0]] = i
            for i, r in enumerate(rows):
                mine = at[n[i] : n[i + 1]]
                first = i == 0
                yield {"part": [r[1]], "bucket": [bucket], "c": [pack(c[mine])], "own": [np.packbits(speaker[mine] == i).tobytes()], "one": [int((c == 1).sum()) if first else 0], "two": [int((c == 2).sum()) if first else 0]}

    asked = map_batches(blocks.filter(F.col("kind") == TEXTS).select("part", "keys", "held", "lens", "codes", "cnt"), ask, "bucket long, part long, h binary, cnt binary")
    return map_batches(dealt(asked, "bucket", "part"), answer, "part long, bucket long, c binary, own binary, one long, two long")


def with_replies(blocks: DataFrame, replies: list[tuple[int, DataFrame, list[str]]]) -> DataFrame:
    """Texts of blocks and replies by part: (part, kind, bucket, x0 ...), columns of each kind in its own order."""
    none = F.lit(None)
    ids = blocks.schema["ids"].dataType
    width = max(4, *(len(c) for _, _, c in replies))
    tail = lambda cols: cols + [none.cast("binary")] * (width - len(cols))
    rows = [blocks.filter(F.col("kind") == TEXTS).select("part", "kind", F.lit(0).cast("long").alias("bucket"), "held", "ids", *[c.alias(f"x{i}") for i, c in enumerate(tail([F.col("keys"), F.col("lens"), F.col("codes"), F.col("cnt")]))])]
    for kind, df, cols in replies:
        rows.append(df.select("part", F.lit(kind).alias("kind"), "bucket", none.cast("array<boolean>").alias("held"), none.cast(ids).alias("ids"), *[c.alias(f"x{i}") for i, c in enumerate(tail([F.col(c) for c in cols]))]))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return dealt(out, "part", "kind", "bucket")


# Words ----------------------------------------------------------------------------------------------

_STATE = "bucket long, kind int, part long, keys binary, tokens binary, sizes binary, c binary, k binary, t binary, idx binary, one long, two long, n_c long, n_types long, sum_k long, sum_t long, mass long"
#: Kinds of rows of the words' tables: the state of a bucket, a block's places in it, a block's replies, a block's tables.
STATE, PLACES, REPLY, TABLES = 0, 1, 2, 3


def state_row(bucket, **cols):
    return {c.split()[0]: [None] for c in _STATE.split(", ")} | {"bucket": [bucket], "kind": [STATE], "part": [-1]} | {c: [v] for c, v in cols.items()}


def word_buckets(blocks: DataFrame, tables: DataFrame, bits: int) -> DataFrame:
    """STATE rows (keys, tokens, training counts c, tables k of all contexts' restaurants) and PLACES rows of all words."""

    def ask(batches):
        for b in batches:
            for part, keys, tokens, sizes, cnt in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                keys, sizes, cnt = unpack_sorted(keys), unpack(sizes), unpack(cnt)
                end = np.concatenate([[0], np.cumsum(sizes)])
                bucket, edge = cuts(keys, bits)
                for k, lo, hi in zip(bucket.tolist(), edge, edge[1:], strict=False):
                    yield {"bucket": [k], "part": [part], "kind": [0], "x0": [pack_sorted(keys[lo:hi])], "x1": [tokens[end[lo] : end[hi]]], "x2": [pack(sizes[lo:hi])], "x3": [pack(cnt[lo:hi])]}

    def unite(batches):
        for bucket, rows in by_key(batches, 7):
            asks, ups = [r for r in rows if r[2] == 0], {r[1]: r for r in rows if r[2] == 1}
            keys, sizes = [unpack_sorted(r[3]) for r in asks], np.concatenate([unpack(r[5]) for r in asks])
            n = np.cumsum([0, *map(len, keys)])
            every, first, at = distinct(np.concatenate(keys))
            raw = np.frombuffer(b"".join(r[4] for r in asks), dtype=np.uint8)
            starts = np.cumsum(sizes) - sizes
            c = np.bincount(at, np.concatenate([unpack(r[6]) for r in asks]), len(every)).astype(np.int64)
            k = np.zeros(len(every), dtype=np.int64)
            for i, r in enumerate(asks):
                idx = at[n[i] : n[i + 1]]
                k[idx] += unpack(ups[r[1]][4])
                yield state_row(bucket, kind=PLACES, part=r[1], idx=pack(idx))
            zero = np.zeros(len(every), dtype=np.int64)
            yield state_row(bucket, keys=pack_sorted(every), tokens=gathered(raw, starts[first], sizes[first]).tobytes(), sizes=pack(sizes[first]), c=pack(c), k=pack(zero), t=pack(np.minimum(c, 1)), one=int((k == 1).sum()), two=int((k == 2).sum()), n_c=int(c.sum()), n_types=int((c > 0).sum()), sum_k=0, sum_t=int((c > 0).sum()), mass=0)

    asked = map_batches(blocks.filter(F.col("kind") == WORDS).select("part", "keys", "tokens", "sizes", "cnt"), ask, "bucket long, part long, kind int, x0 binary, x1 binary, x2 binary, x3 binary")
    none = F.lit(None).cast("binary")
    ups = tables.select("bucket", "part", F.lit(1).alias("kind"), F.col("ea"), F.col("eb"), none, none)
    return map_batches(dealt(asked.union(ups), "bucket", "kind", "part"), unite, _STATE)


def seated_words(words: DataFrame, places: DataFrame, tables: DataFrame, spelling: Spelling, total: int, d: float, k: int) -> DataFrame:
    """New STATE rows and, for each block, REPLY rows: customers ``k``, tables ``c`` as contexts (less than ``k``), tables ``t`` and base ``idx``; the first sweep's have the counts in ``keys``."""
    held = words.sparkSession.sparkContext.broadcast(spelling)  # 257 x 257 numbers

    def run(batches):
        for bucket, rows in by_key(batches, 11):
            s = next(r for r in rows if r[1] == STATE)
            keys, sizes, c, old, t = unpack_sorted(s[3]), unpack(s[5]), unpack(s[6]), unpack(s[7]), unpack(s[8])
            idx = {r[2]: unpack(r[9]) for r in rows if r[1] == PLACES}
            ka, kb = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            for r in rows:
                if r[1] == TABLES:
                    ka[idx[r[2]]] += unpack(r[3])
                    kb[idx[r[2]]] += unpack(r[4])
            q = held.value.base(np.frombuffer(s[4], dtype=np.uint8), sizes)
            some = np.flatnonzero(kb)
            o, p, key = np.maximum(total - t, 0)[some], np.exp2(-q[some] / OCTAVE), keys[some]
            now = join(old[some], t[some] * (old[some] > 0), kb[some], o, p, d, key, 1000 * (k + 1) + 500)
            t = np.zeros(len(keys), dtype=np.int64)
            t[some] = sweep(kb[some], now, o, p, d, key, 1000 * (k + 1))
            known = c > 0
            mass = int(np.sum(np.where(known & (q < 60 * OCTAVE), np.rint(np.exp2(60 - q / OCTAVE)), 0).astype(np.int64)))
            yield state_row(bucket, keys=s[3], tokens=s[4], sizes=s[5], c=s[6], k=pack(kb), t=pack(t), one=0, two=0, n_c=int(c.sum()), n_types=int(known.sum()), sum_k=int(kb.sum()), sum_t=int(t.sum()), mass=mass)
            for part, at in idx.items():
                yield state_row(bucket, kind=REPLY, part=part, keys=pack(c[at]) if k == 0 else None, c=pack_less(ka[at], kb[at]), k=pack(kb[at]), t=pack(t[at]), idx=pack(q[at]))

    cols = ["bucket", "kind", "part", "keys", "tokens", "sizes", "c", "k", "t", "idx"]
    none = F.lit(None).cast("binary")
    ups = tables.select("bucket", F.lit(TABLES).alias("kind"), "part", F.col("ea"), F.col("eb"), *[none] * 5)
    rows = words.select(*cols).union(places.select(*cols)).union(ups).withColumn("spare", F.lit(0))
    return map_batches(dealt(rows, "bucket", "kind", "part"), run, _STATE)


def spelling_of(words: DataFrame, seed: int) -> Spelling:
    """The spelling restaurants, whose customers are the tables of words."""

    def cells(batches):
        count = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for b in batches:
            for tokens, sizes, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                cell, owner = spelled(np.frombuffer(tokens, dtype=np.uint8), unpack(sizes))
                count += np.bincount(cell, unpack(t)[owner], SYMBOLS * SYMBOLS).astype(np.int64)
        some = np.flatnonzero(count)
        yield {"cell": some, "n": count[some]}

    got = map_batches(words.select("tokens", "sizes", "t"), cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 257 x 257 rows
    counts = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    for r in got:
        counts[r[0]] = r[1]
    return Spelling(counts, seed)


class Totals:
    """Of the restaurant of words: customers, tables, discount, and the base probability of all words never seen."""

    def __init__(self, row, d: float, spell: bool):
        self.customers, self.tables, self.d, self.spell = row["sum_k"] or 0, row["sum_t"] or 0, d, spell
        self.rest = max(1e-12, 1 - (row["mass"] or 0) * 2.0**-60)

    def word_prob(self, k: np.ndarray, t: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of words with customers ``k``, tables ``t`` and base ``q``; without customers a word was never seen."""
        base = np.exp2(-q / OCTAVE)
        if not self.spell:
            base = np.where(k > 0, base, self.rest)
        return (np.maximum(k - self.d * t, 0) + (STRENGTH + self.d * self.tables) * base) / (self.customers + STRENGTH)


# Blocks and their replies ---------------------------------------------------------------------------

#: Kinds of rows of a block's tables.
UP, MULTI, SEATED = 0, 1, 2
_BLOCK = "part long, kind int, bucket long, ea binary, eb binary, a binary, b binary, c binary, seed binary"


def block_row(part, kind, **cols):
    return {c: [None] for c in ("bucket", "ea", "eb", "a", "b", "c", "seed")} | {"part": [part], "kind": [kind]} | {c: [v] for c, v in cols.items()}


def first_tables(blocks: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """For each block: its tables by word and bucket, one a pair (UP), and the pairs of several customers it speaks for (MULTI; ``ea``, ``eb``: tables of the other pairs)."""

    def run(batches):
        for part, rows in by_key(batches, 9):
            texts, got = next(r for r in rows if r[1] == TEXTS), [r for r in rows if r[1] == 2]
            keys = unpack_sorted(texts[5])
            p = Pairs(keys, decoded(texts[8], texts[7]), unpack(texts[6]), texts[3])
            c = np.concatenate([unpack(r[5]) for r in got])
            own = spoken(got, 6)
            lone, several = own & (c == 1), np.flatnonzero(own & (c > 1))
            n = len(keys)
            la, lb = np.bincount(p.a[lone], minlength=n), np.bincount(p.b[lone], minlength=n)
            a, b = p.a[several], p.b[several]
            bucket, edge = cuts(keys, bits)
            ea, eb = la + np.bincount(a, minlength=n), lb + np.bincount(b, minlength=n)
            for k, lo, hi in zip(bucket.tolist(), edge, edge[1:], strict=False):
                yield block_row(part, UP, bucket=k, ea=pack(ea[lo:hi]), eb=pack(eb[lo:hi]))
            yield block_row(part, MULTI, bucket=-1, ea=pack(la), eb=pack(lb), a=pack(a), b=pack(b), c=pack(c[several]), seed=pack_sorted(p.h[several]))

    return map_batches(with_replies(blocks, [(2, counts, ["c", "own"])]), run, _BLOCK)


def spoken(replies: list[tuple], at: int) -> np.ndarray:
    """Flags of the pairs a block speaks for; ``at``: the column, after that of the counts."""
    return np.concatenate([np.unpackbits(np.frombuffer(r[at], dtype=np.uint8), count=len(unpack(r[at - 1]))).astype(bool) for r in replies])


def seated_pairs(multi: DataFrame, seated: DataFrame | None, replies: DataFrame, totals: Totals, d: float, k: int) -> DataFrame:
    """UP rows after sweep ``k`` and the tables of each block's MULTI pairs (SEATED, in ``c``)."""

    def run(batches):
        for part, rows in by_key(batches, 9):
            m, prior, got = None, None, []
            for r in rows:
                if r[1] == MULTI:
                    m = r
                elif r[1] == SEATED:
                    prior = unpack(r[7])
                else:
                    got.append(r)
            told = [told_words(r[3:7]) for r in got]
            n = [len(x[0]) for x in told]
            tu, p = np.concatenate([x[0] for x in told]), np.concatenate([totals.word_prob(*x[1:]) for x in told])
            a, b, c = unpack(m[5]), unpack(m[6]), unpack(m[7])
            t = chain(c, np.ones_like(c) if prior is None else prior, tu[a], p[b], d, unpack_sorted(m[8]), k)
            ea, eb = (unpack(m[i]) + np.bincount(x, t, len(tu)).astype(np.int64) for i, x in ((3, a), (4, b)))
            edge = np.cumsum([0, *n]).tolist()
            for r, lo, hi in zip(got, edge, edge[1:], strict=False):
                yield block_row(part, UP, bucket=r[2], ea=pack(ea[lo:hi]), eb=pack(eb[lo:hi]))
            yield block_row(part, SEATED, bucket=-1, c=pack(t))

    cols = ["part", "kind", "bucket", "ea", "eb", "a", "b", "c", "seed"]
    none = F.lit(None).cast("binary")
    rows = multi.select(*cols).union(replies.select("part", F.lit(9).alias("kind"), "bucket", "c", "k", "t", "idx", none, none))
    if seated is not None:
        rows = rows.union(seated.select(*cols))
    return map_batches(dealt(rows, "part", "kind", "bucket"), run, _BLOCK)


def told_words(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables as contexts, customers, tables and base of the words in a reply."""
    k = unpack(row[1])
    return unpack_less(row[0], k), k, unpack(row[2]), unpack(row[3])


def scores(blocks: DataFrame, counts: DataFrame, replies: list[DataFrame], totals: list[Totals], d: float, burn_in: int, tokens: int, types: int, taught: int) -> DataFrame:
    """The rows of all texts: sweeps are repeated for the pairs of each block, with the same numbers, and give the same tables."""
    id_type = blocks.schema["ids"].dataType.elementType
    scale, last = float(np.log10(tokens + types + 1)), len(replies) - 1

    def run(batches):
        for _, rows in by_key(batches, 10):
            texts, got = next(r for r in rows if r[1] == TEXTS), [r for r in rows if r[1] == 2]
            keys, lens = unpack_sorted(texts[5]), unpack(texts[6])
            codes = decoded(texts[8], texts[7])
            pairs = Pairs(keys, codes, lens, texts[3])
            c = np.concatenate([unpack(r[5]) for r in got])
            several = np.flatnonzero(c > 1)
            a, b, n, seed = pairs.a[several], pairs.b[several], c[several], pairs.h[several]
            t = np.ones_like(n)
            tables, mean = np.minimum(c, 1), np.zeros(len(c))
            for k in range(last + 1):
                mine = [r for r in rows if r[1] == 10 + k]
                told = [told_words(r[6:10]) for r in mine]
                tu, p = np.concatenate([x[0] for x in told]), np.concatenate([totals[k].word_prob(*x[1:]) for x in told])
                if k == 0:
                    cw = np.concatenate([unpack(r[5]) for r in mine])
                    cu = cw.copy()
                    cu[np.searchsorted(keys, _U(START))] = taught
                if k > burn_in:
                    tables[several] = t
                    mean += (np.maximum(c - d * tables, 0) + (STRENGTH + d * tu[pairs.a]) * p[pairs.b]) / (cu[pairs.a] + STRENGTH)
                if k < last:
                    t = chain(n, t, tu[a], p[b], d, seed, k)
                del told, tu, p
            s = np.log10(np.maximum(mean / (last - burn_in), 1e-300))[pairs.at]
            base, known = (np.log10(cw + 1.0) - scale)[codes], (cw > 0)[codes]
            end = np.cumsum(lens)
            spans = list(zip((end - lens).tolist(), end.tolist(), strict=True))
            for lo in range(0, len(spans), 5000):
                part = spans[lo : lo + 5000]
                yield {"id": texts[4][lo : lo + 5000], "held_out": texts[3][lo : lo + 5000], "n_tokens": [y - x for x, y in part], "n_known": [int(known[x:y].sum()) for x, y in part], "base_score": [float(base[x:y].sum()) for x, y in part], "score": [float(s[x:y].sum()) for x, y in part]}

    rows = with_replies(blocks, [(2, counts, ["c", "own"]), *((10 + k, r, ["keys", "c", "k", "t", "idx"]) for k, r in enumerate(replies))])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return map_batches(rows, run, schema).withColumn("train_tokens", F.lit(tokens).cast("long"))


def score(docs: DataFrame, held_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, spell: bool = False) -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score); rows with ``held_col`` teach nothing.

    ``score`` takes each word in its context, the word before it; ``base_score``
    has no context.  Base and model share their outcomes: each type of the
    training texts, and one for all others, whose base probability is what the
    spelling restaurants leave to them.  With ``spell`` a word never seen is
    spelled instead, so that the score is the probability of the string.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in is less than sweeps")
    spark = docs.sparkSession
    small_batches(spark)
    blocks = scratch(encode(docs, id_col, text_col, held_col), "blocks", by="kind")
    sizes = map_batches(blocks.select("kind", "sizes", "lens"), _entries, "words long, tokens long, docs long").agg(F.sum("words"), F.sum("tokens")).first()
    word_bits, pair_bits = bits_for(sizes[0] or 0), bits_for(sizes[1] or 0)
    release(spark)
    counts = scratch(counted_pairs(blocks, pair_bits), "pairs")
    release(spark)
    one, two = counts.agg(F.sum("one"), F.sum("two")).first()
    d2 = share(one or 0, two or 0)
    tables = scratch(first_tables(blocks, counts, word_bits), "tables", by="kind")
    multi, seated = tables.filter(F.col("kind") == MULTI), None
    release(spark)
    words = scratch(word_buckets(blocks, tables.filter(F.col("kind") == UP), word_bits), "words", by="kind")
    places = words.filter(F.col("kind") == PLACES)
    drop_kind(blocks, WORDS)
    release(spark)
    row = sums(words)
    d1, tokens, types = share(row["one"] or 0, row["two"] or 0), row["n_c"] or 0, row["n_types"] or 0
    ends = blocks.filter(F.col("kind") == TEXTS).select(F.size(F.filter("held", lambda x: ~x)).alias("n")).agg(F.sum("n")).first()[0] or 0
    now, ups, replies, totals = words.filter(F.col("kind") == STATE), tables, [], []
    for k in range(sweeps + 1):
        new = scratch(seated_words(now, places, ups.filter(F.col("kind") == UP), spelling_of(now, 7 * k), row["sum_t"] or 0, d1, k), f"words-{k}", by="kind")
        drop_kind(words if k == 0 else now.em_table, STATE)
        now = new.filter(F.col("kind") == STATE)
        now.em_table = new
        row = sums(new)
        replies.append(new.filter(F.col("kind") == REPLY))
        totals.append(Totals(row, d1, spell))
        if ups is not tables:
            drop_kind(ups, UP)
        release(spark)
        if k < sweeps:
            ups = scratch(seated_pairs(multi, seated, replies[k], totals[k], d2, k), f"seated-{k}", by="kind")
            seated = ups.filter(F.col("kind") == SEATED)
            release(spark)
    drop_kind(now.em_table, STATE)
    drop_kind(words, PLACES)
    discard(tables)
    release(spark)
    out = scores(blocks, counts, replies, totals, d2, burn_in, tokens, types, ends)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _entries(batches):
    for b in batches:
        for kind, sizes, lens in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield {"words": [len(unpack(sizes)) if kind == WORDS else 0], "tokens": [int(unpack(lens).sum()) if kind == TEXTS else 0], "docs": [0]}


def sums(words: DataFrame):
    names = ("one", "two", "n_c", "n_types", "sum_k", "sum_t", "mass")
    return words.filter(F.col("kind") == STATE).agg(*(F.sum(c).alias(c) for c in names)).first()


def drop_kind(table: DataFrame, kind: int) -> None:
    """Delete the rows of one kind, once nothing reads them any more."""
    remove(table.sparkSession.sparkContext, f"{table.em_path}/kind={kind}")
