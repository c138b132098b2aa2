"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of
labelled rows, then applied to every byte of every text: texts are cut into
segments of ``SEGMENT`` bytes that run side by side, each position gets a
distribution over the languages, and a document's is the mean over its bytes.

Null texts and texts with no letter are ``und`` with score 0.  Labels that are
null teach nothing; with one label only, all texts get it.  Repeated rows get
equal results.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.llm.common import append_columns, small_batches

#: At most so many rows of each language are learned from.
ROWS_A_LANGUAGE = 300
#: Characters of a row that are learned from: a stretch whose place the hash gives.
STRETCH = 4096
HIDDEN = 8
SEGMENT = 128
LANES = 4096
TRAIN_LENGTH = 48
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """h' = n + z(h - n), n = tanh(a + r b), with z, r gates of byte and state; one net a direction, softmax over both states."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), dtype=np.float32)

    def _run(self, x: np.ndarray, d: str) -> list[tuple]:
        """States and gates of each step; x is steps by rows."""
        h, k, out = np.zeros((x.shape[1], self.hidden), dtype=np.float32), self.hidden, []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gx, gh = self.p[f"x{d}"][x[t]], h @ self.p[f"u{d}"]
            zr = _sigmoid(gx[:, : 2 * k] + gh[:, : 2 * k])
            z, r, b = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
            n = np.tanh(gx[:, 2 * k :] + r * b)
            new = n + z * (h - n)
            out.append((t, h, z, r, n, b, new))
            h = new
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, through time in both directions."""
        k, steps, rows = self.hidden, *x.shape
        runs = {d: self._run(x, d) for d in "fb"}
        states = np.zeros((steps, rows, 2 * k), dtype=np.float32)
        for i, d in enumerate("fb"):
            for t, *_, new in runs[d]:
                states[t, :, i * k : i * k + k] = new
        logits = states @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = float(-np.log(prob[:, np.arange(rows), y] + 1e-9).mean())
        prob[:, np.arange(rows), y] -= 1
        prob /= steps * rows
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        g["o"] = np.einsum("trh,trc->hc", states, prob)
        g["c"] = prob.sum(axis=(0, 1))
        back = prob @ self.p["o"].T
        for i, d in enumerate("fb"):
            u, dh = self.p[f"u{d}"], np.zeros((rows, k), dtype=np.float32)
            for t, h, z, r, n, b, _ in reversed(runs[d]):
                dh = dh + back[t, :, i * k : i * k + k]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * b * r * (1 - r)
                gates = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"u{d}"] += h.T @ gates
                np.add.at(g[f"x{d}"], x[t], np.concatenate([dz, dr, dn], axis=1))
                dh = dh * z + gates @ u.T
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = 300, rows: int = 128, rate: float = 0.03, seed: int = 11) -> float:
        """Adam over random segments, as many of each language."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == c and t] for c in range(len(self.languages))]
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(x) for n, x in self.p.items()}
        loss = 0.0
        classes = [c for c, b in enumerate(by) if b]
        for step in range(1, steps + 1):
            y = np.array([classes[i % len(classes)] for i in range(rows)])
            x = np.full((TRAIN_LENGTH, rows), 32, dtype=np.uint8)
            for i, c in enumerate(y):
                t = by[c][rng.integers(len(by[c]))]
                at = int(rng.integers(max(1, len(t) - TRAIN_LENGTH + 1)))
                piece = np.frombuffer(t[at : at + TRAIN_LENGTH], dtype=np.uint8)
                x[: len(piece), i] = piece
            loss, g = self.gradients(x, y)
            scale = rate * min(1.0, 4 * (1 - step / (steps + 1)))
            for n in self.p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] * g[n]
                self.p[n] -= (scale * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def _steps(self, x: np.ndarray, d: str):
        """(step, state) over segments side by side; states are features by rows, one buffer used again."""
        k, rows = self.hidden, x.shape[1]
        table, u = self.p[f"x{d}"].T.copy(), self.p[f"u{d}"].T.copy()
        table[: 2 * k] *= 0.5  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        u[: 2 * k] *= 0.5
        h = np.zeros((k, rows), dtype=np.float32)
        gx, gh, n, s = np.empty((3 * k, rows), np.float32), np.empty((3 * k, rows), np.float32), np.empty((k, rows), np.float32), np.empty((2 * k, rows), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=gx, mode="clip")
            np.matmul(u, h, out=gh)
            np.add(gx[: 2 * k], gh[: 2 * k], out=s)
            np.tanh(s, out=s)
            s *= 0.5
            s += 0.5
            np.multiply(s[k:], gh[2 * k :], out=n)
            n += gx[2 * k :]
            np.tanh(n, out=n)
            h -= n
            h *= s[:k]
            h += n
            yield t, h

    def pool(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the position distributions of each segment; segments are rows by SEGMENT bytes."""
        x, k = np.ascontiguousarray(segments.T), self.hidden
        forward = np.empty((len(x), len(self.languages), x.shape[1]), dtype=np.float32)
        a, b = self.p["o"][:k].T.copy(), self.p["o"][k:].T.copy()
        for t, h in self._steps(x, "f"):
            np.matmul(a, h, out=forward[t])
        total = np.zeros((len(self.languages), x.shape[1]), dtype=np.float32)
        for t, h in self._steps(x, "b"):
            e = b @ h
            e += forward[t]
            e += self.p["c"][:, None]
            np.exp(e, out=e)
            e *= (t < lengths) / e.sum(axis=0)
            total += e
        return total.T

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution of each text over all its bytes."""
        counts = [-(-len(t) // SEGMENT) for t in texts]
        out, rows, owner, lens = np.zeros((len(texts), len(self.languages))), [], [], []

        def flush() -> None:
            if rows:
                raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, SEGMENT)
                np.add.at(out, np.array(owner), self.pool(raw, np.array(lens)))
                rows.clear(), owner.clear(), lens.clear()

        for i, t in enumerate(texts):
            for j in range(counts[i]):
                piece = t[j * SEGMENT : (j + 1) * SEGMENT]
                rows.append(piece.ljust(SEGMENT))
                owner.append(i)
                lens.append(len(piece))
                if len(rows) == LANES:
                    flush()
        flush()
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows_a_language: int = ROWS_A_LANGUAGE, stretch: int = STRETCH, **fit) -> ByteGRU:
    """A net of all labels from at most ``rows_a_language`` rows of each: those with the least hash of the id, found by a threshold from counts.

    Of a longer text a stretch of ``stretch`` characters, anywhere, is learned from.
    """
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("y"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)).alias("h"), F.col(text_col).alias("t"))
    counts = known.groupBy("y").count().collect()  # a row a label
    if not counts:
        return ByteGRU(["und"])
    languages = sorted(r[0] for r in counts)
    edge = F.lit(-1)
    for r in counts:
        edge = F.when(F.col("y") == r[0], F.lit(min(1 << 40, int((1 << 40) * 1.5 * (rows_a_language + 30) / r[1])))).otherwise(edge)
    rows = known.filter(F.col("h") < edge).select("y", "h", F.expr(f"substring(t, cast(1 + pmod(h, greatest(1, length(t) - {stretch} + 1)) as int), {stretch})").alias("t")).orderBy("h", "y", "t").limit(4 * rows_a_language * len(languages)).collect()
    got: dict[str, list[bytes]] = {y: [] for y in languages}
    for y, _, t in rows:
        if len(got[y]) < rows_a_language:
            got[y].append(t.encode())
    net = ByteGRU(languages)
    if len(languages) > 1:
        net.fit([t for y in languages for t in got[y]], [k for k, y in enumerate(languages) for _ in got[y]], **fit)
    return net


def predict(df: DataFrame, net: ByteGRU, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    small_batches(df.sparkSession)

    def run(texts):
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if some:
            p = net.documents([texts[i].encode() for i in some])
            best = p.argmax(axis=1)
            for i, b, s in zip(some, best.tolist(), p.max(axis=1).tolist(), strict=True):
                pred[i], score[i] = net.languages[b], min(1.0, max(0.0, s))
        return {"lang_pred": pred, "score": score}

    return append_columns(df, [text_col], run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
