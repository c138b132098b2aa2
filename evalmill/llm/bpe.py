"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (base64 token, rank).  The library works on
characters, so each byte stands as one printable character (the byte table);
merges are recovered from the ranks.  Each match of the split pattern is
encoded on its own and no special token is recognised, as tiktoken's
``encode_ordinary`` does.

Nulls encode as empty text (no tokens).  Long texts are cut at places where
the split pattern always ends a match, so memory stays bounded and ids are the
same.  Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalmill.llm.common import append_columns, small_batches

#: Characters after which a long text is cut at the next safe place.
CUT = 1 << 16
#: Entries after which the table of known matches starts anew; it bounds a worker's memory, not what is encoded.
KNOWN = 600_000
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_table() -> list[str]:
    """A printable character for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _split_by_rank(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``, found by merging with lower ranks only."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], b"".join(parts[1:])


class Codec:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        table = byte_table()
        text = lambda b: "".join(table[x] for x in b)
        merges = [tuple(map(text, _split_by_rank(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.tok = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges))
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(table)}
        self.pattern = regex.compile(pattern)
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in self.tok.get_vocab().items():
            self.bytes_of[r] = bytes(back[c] for c in t)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """``text`` in parts, cut before a single space between letters: a match of the pattern begins there in any case."""
        out, at = [], 0
        while len(text) - at > CUT and (m := _SAFE.search(text, at + CUT)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of matches not met before, each encoded by the library on its own."""
        if len(self.known) > KNOWN:
            self.known.clear()
        for lo in range(0, len(new), 2000):
            e = self.words.encode(new[lo : lo + 2000], is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.asarray(e.ids, dtype="<u4"), np.bincount(np.asarray(e.word_ids, dtype=np.int64), minlength=len(new[lo : lo + 2000])).cumsum().tolist()
            raw, at = ids.tobytes(), 0
            for w, end in zip(new[lo : lo + 2000], ends, strict=True):
                self.known[w] = raw[4 * at : 4 * end]
                at = end

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32.  A match met before has its ids from a bounded table."""
        out, known = [], self.known
        for part in self.pieces(text or ""):
            words = self.pattern.findall(part)
            got = list(map(known.get, words))
            if None in got:
                self._learn(list({w for w, g in zip(words, got, strict=True) if g is None}))
                got = list(map(self.known.get, words))
                if None in got:  # the table was emptied between
                    self._learn(list({w for w, g in zip(words, got, strict=True) if g is None}))
                    got = [self.known[w] for w in words]
            out += got
        return b"".join(out)

    def offsets(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids with start and end characters; the parts of a split character share its place."""
        ids, starts, ends, base = [], [], [], 0
        for p in self.pieces(text or ""):
            e = self.tok.encode(p, add_special_tokens=False)
            ids += e.ids
            starts += [base + a for a, _ in e.offsets]
            ends += [base + b for _, b in e.offsets]
            base += len(p)
        return ids, starts, ends

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as the ids come: bytes of a character that is split over ids wait for the rest."""
        dec = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if got := dec.decode(self.bytes_of[i]):
                yield got
        if got := dec.decode(b"", True):
            yield got


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` array<int>, and ``starts`` and ``ends`` in characters if ``offsets``."""
    small_batches(df.sparkSession)
    path, pat = ranks_path or default_ranks(), _pattern(pattern)
    ints = T.ArrayType(T.IntegerType())
    if not offsets:
        return append_columns(df, [text_col], lambda texts: {"ids": [np.frombuffer(codec(path, pat).encode(t), dtype="<u4") for t in texts]}, T.StructType([T.StructField("ids", ints)]))

    def run(texts):
        got = [codec(path, pat).offsets(t) for t in texts]
        return {"ids": [g[0] for g in got], "starts": [g[1] for g in got], "ends": [g[2] for g in got]}

    return append_columns(df, [text_col], run, T.StructType([T.StructField(c, ints) for c in ("ids", "starts", "ends")]))


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` binary: exactly the bytes that were encoded."""
    path, pat = ranks_path or default_ranks(), _pattern(pattern)
    return append_columns(df, [ids_col], lambda rows: {"decoded": [codec(path, pat).decode_bytes(r or ()) for r in rows]}, T.StructType([T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` (ids as little-endian uint32) and ``decoded_sha256``.

    Encodes and decodes in one pass over each batch, so that no id list is moved.
    """
    small_batches(df.sparkSession)
    path, pat = ranks_path or default_ranks(), _pattern(pattern)

    def run(texts):
        c = codec(path, pat)
        n, a, b = [], [], []
        for t in texts:
            raw = c.encode(t)
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(c.decode_bytes(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return append_columns(df, [text_col], run, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
