"""Every operator on empty tables, nulls, repeated ids, clashing columns and long texts; and against naive versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evalmill.llm import bpe, common, decontam, langid, minhash, pitman_yor, quality, secret_scan, suffix_repeats, toxicity, warc

LONG = " ".join(f"w{k % 997}" for k in range(60_000))
CLASHES = "kept lang_pred score ids spans n_bytes em_toxicity n_tokens component_id redacted em_redacted items_sha256 decoded n_words held_out"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (1, "another text under the same id", "en"), (None, None, None), (None, "one two three four five six seven", "de"), (2, "", "en"), (3, LONG, "en"), (4, None, "fr"), (5, "\x00 \n\t é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in CLASHES.split():
        df = df.withColumn(c, F.lit("clash"))
    return df


def judge_all(df):
    """Each operator's result, by name."""
    spark = df.sparkSession
    bench = spark.createDataFrame([("a", "one two three"), ("b", None), (None, "four"), ("c", "...")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    return {
        "op1": quality.assess(df), "op2": langid.predict(df, langid.train(df, steps=3)), "op3": warc.round_trip(df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "kept")), "op4": suffix_repeats.removal(df),
        "op5": toxicity.score(df, toxicity.train(df, labels)), "op6": bpe.digests(df), "op6 ids": bpe.encode(df, offsets=True), "op7": pitman_yor.score(df.withColumn("held_out", F.col("doc_id") == 4)), "op8": secret_scan.scan(df), "op8 redacted": secret_scan.redact(df), "op9": decontam.digests(df, bench), "op10": minhash.near_duplicates(df),
    }


def test_odd_rows(table):
    for name, got in judge_all(table).items():
        assert got.count() == table.count(), name
        assert len(set(map(str.lower, got.columns))) == len(got.columns), name
        key = "page_id" if "page_id" in got.columns else "doc_id"
        assert collections.Counter(r[key] for r in got.collect()) == {1: 3, None: 2, 2: 1, 3: 1, 4: 1, 5: 1}, name


def test_equal_rows_are_judged_alike(table):
    got = judge_all(table)
    for name, cols in {"op1": ("kept", "char_distance"), "op2": ("lang_pred", "score"), "op4": ("n_removed", "kept"), "op5": ("em_toxicity",), "op6": ("ids_sha256",), "op7": ("score",), "op8": ("spans",), "op9": ("n_hit",), "op10": ("n_shingles", "component_id")}.items():
        size = {"op4": ("n_bytes", 33), "op6": ("n_tokens", None), "op7": ("n_tokens", 8), "op10": ("n_shingles", 3), "op1": ("n_words", 7), "op9": ("n_words", 7)}.get(name)
        rows = [r for r in got[name].collect() if r["doc_id"] == 1 and (size is None or size[1] is None or r[size[0]] == size[1])]
        assert len({tuple(r[c] for c in cols) for r in rows}) <= (1 if size and size[1] else 2), name


def test_empty_tables(table):
    for name, got in judge_all(table.limit(0)).items():
        assert got.count() == 0, name


def test_pipeline_on_odd_rows(spark, table, tmp_path):
    docs = table.select("doc_id", "text", "lang")  # no n_chars
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    kept = corpus_pipeline.near_duplicate_filter(spark, docs, d)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, ""), (1, "another text under the same id"), (1, "one two three four five six seven"), (2, ""), (3, LONG), (4, ""), (5, "\x00 \n\t é")])
    for stage, n in ((corpus_pipeline.toxicity_filter, 9), (corpus_pipeline.decontaminate, 8), (corpus_pipeline.redact_secrets, 9)):
        assert stage(spark, docs, d).columns == docs.columns and stage(spark, docs, d).count() == n
        assert stage(spark, docs.limit(0), d).count() == 0
    assert corpus_pipeline.encode(spark, docs, d).count() == 9


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y z u v w"), ("a", "x y z u v w"), (None, "x y z u v w"), ("c", "alone")], "doc_id string, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}
    pages = spark.createDataFrame([("k/1 >", "u", "x" * 200), ("k/0", "u", "x" * 200), (None, None, None)], "page_id string, url string, html string")
    assert {(r["page_id"], r["refers_to"]) for r in warc.round_trip(pages).collect()} == {("k/1 >", "k/0"), ("k/0", None), (None, None)}


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 1])
def test_equal_payloads(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    html = ["a" * 150, "b" * 150, "a" * 150, "b" * 150, "c" * 150, "a" * 150, "s", "s", None]
    pages = spark.createDataFrame([(9 - k, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.decide(pages).collect()} == {9: 4, 8: 6, 7: 4, 6: None, 5: None, 4: None, 3: None, 2: None, 1: None}


def test_joins_of_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 3")
    got = common.joined_by_key(rows, side, "k", "n", hot=1000)
    assert got.count() == rows.filter("k <> 3").count() and got.select("id").distinct().count() == got.count()


def test_blocks_of_a_benchmark(spark):
    bench = spark.createDataFrame([(str(k), " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)], "item_id string, text string")
    df = spark.createDataFrame([(0, " ".join(f"w{k}x{j}" for k in (0, 5) for j in range(12))), (1, "w3x1 w3x2"), (2, None)], "doc_id long, text string")
    one = {tuple(r) for r in decontam.digests(df, bench).collect()}
    assert {tuple(r) for r in decontam.digests(df, bench, block_words=12).collect()} == one and {r[3] for r in one} == {24, 0}


# Naive versions -------------------------------------------------------------------------------------


def naive_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def test_quality_is_the_naive_one(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of and zebra Quick 12 #! été".split()) for _ in range(rng.choice((3, 80, 200)))) for _ in range(30)] + ["#$ 1" * 120]
    df = spark.createDataFrame([(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    refs = quality.references(quality.measure(df))
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    for k, t in enumerate(texts):
        c, w = quality.char_histogram(t).tolist(), quality.word_histogram(t).tolist()
        d = {y: (naive_distance(c, rc.tolist()), naive_distance(w, rw.tolist()) if sum(w) and sum(rw) else 1.0) for y, rc, rw in refs}
        near = min(d, key=lambda y: (sum(d[y]), y))
        assert math.isclose(got[k]["char_distance"], d[near][0], abs_tol=1e-9) and math.isclose(got[k]["word_distance"], d[near][1], abs_tol=1e-9)
        far = sum(c) >= quality.MIN_CHARS and d[near][0] > quality.MAX_CHAR_DISTANCE + quality.CHAR_NOISE / math.sqrt(sum(c)) or sum(w) >= quality.MIN_WORDS and d[near][1] > quality.MAX_WORD_DISTANCE
        assert got[k]["kept"] == (not got[k]["base_failed"] and not far)


def test_more_labels_than_a_few(spark):
    df = spark.createDataFrame([(k, " ".join(f"the w{k * 61 + j}" for j in range(60)), f"l{k:03}") for k in range(70)], "doc_id long, text string, lang string")
    assert len(quality.references(quality.measure(df))) == 70 and len(langid.train(df, steps=1).languages) == 70


def test_language_is_the_naive_one():
    net = langid.ByteGRU(["a", "b", "c"])
    text = "Größe und ähnliche Wörter, 12 mal.".encode() * 9
    total = np.zeros(3)
    for lo in range(0, len(text), langid.SEGMENT):
        piece = text[lo : lo + langid.SEGMENT]
        x = np.frombuffer(piece.ljust(langid.SEGMENT), dtype=np.uint8)
        states = {}
        for d in "fb":
            h = np.zeros(net.hidden)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                gx, gh, k = net.p[f"x{d}"][x[t]], h @ net.p[f"u{d}"], net.hidden
                z, r = 1 / (1 + np.exp(-(gx[:k] + gh[:k]))), 1 / (1 + np.exp(-(gx[k : 2 * k] + gh[k : 2 * k])))
                n = np.tanh(gx[2 * k :] + r * gh[2 * k :])
                h = n + z * (h - n)
                states[d, t] = h
        for t in range(len(piece)):
            e = np.exp(np.concatenate([states["f", t], states["b", t]]) @ net.p["o"] + net.p["c"])
            total += e / e.sum()
    assert np.allclose(net.documents([text])[0], total / len(text), atol=1e-4)


@given(st.text(alphabet="scum трash_7 .5ди", max_size=40))
@settings(max_examples=300, deadline=None)
def test_lexicon_is_the_naive_one(text):
    lexicon = toxicity.Lexicon({"scu": 2.0, "scum$": 3.0, "tra": 1.0}, exceptions=("scum tra",))
    t = toxicity.fold(text)
    free = [m.span() for m in re.finditer(r"(?=(scum tra))", t)]
    free = [(a, a + 8) for a, _ in free if not (a and t[a - 1].isalnum()) and not (a + 8 < len(t) and t[a + 8].isalnum())]
    want = []
    for a in range(len(t)):
        if a and t[a - 1].isalnum():
            continue
        fits = [(len(e.rstrip("$")), w) for e, w in lexicon.weights.items() if t.startswith(e.rstrip("$"), a) and not (e.endswith("$") and a + len(e) - 1 < len(t) and t[a + len(e) - 1].isalnum())]
        if fits:
            n, w = max(fits)
            if not any(x <= a and a + n <= y for x, y in free):
                want.append((a, a + n, w))
    assert [(a, b, w) for a, b, w in lexicon.hits(text)] == want


def naive_base(text):
    """The three base rules by scanning characters."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    digits, out = set("0123456789"), []
    low = "".join(c.lower() if c in letters else c for c in text)
    run = lambda at, allowed: next((k for k in range(at, len(text)) if text[k] not in allowed), len(text))

    def assign(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                k = at + len(word)
                for quote in (True, False):
                    j = k
                    if quote:
                        if j >= len(text) or text[j] not in "\"'":
                            continue
                        j += 1
                    j = run(j, {" "})
                    if j < len(text) and text[j] in ":=":
                        j = run(j + 1, {" "})
                        for skip in (1, 0):
                            if skip and (j >= len(text) or text[j] not in "\"'"):
                                continue
                            end = run(j + skip, letters | digits | set("+/_.=-"))
                            if end > j + skip:
                                return j + skip, end
        return None

    at = 0
    while at < len(text):
        got = assign(at)
        # after the mark an equal sign may be part of the value
        if got:
            if got[1] - got[0] >= 6:
                out.append((at, "assign", got[1]))
            at = got[1]
        else:
            at += 1
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | digits
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = run(at + 4, upper)
        if end > at + 4:
            if end - at >= 20:
                out.append((at, "access", end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, digits | set("abcdef"))
        if end - at >= 24:
            out.append((at, "hex", end))
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "API", "key", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "=", ":", " ", "'", '"', "x", "é", "\n", "_", "ſecret", "12345"]), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_secrets_are_the_naive_ones(text):
    assert [(a, secret_scan.KINDS[k], b) for a, k, b in secret_scan.base_spans(text)] == naive_base(text)


def test_long_names_values_and_chains():
    name, value = "a" * 150 + "_password", "Zx9" * 2000
    assert [(a, b) for a, _, b in secret_scan.lexed_spans(f'{name} = "{value}"')] == [(len(name) + 4, len(name) + 4 + len(value))]
    parts = "".join(f'p{k} = "Zx9{k:03}q"\n' for k in range(90))
    assert len(secret_scan.lexed_spans(parts + "client_secret = " + " + ".join(f"p{k}" for k in range(90)) + "\n")) == 90
    assert len(secret_scan.lexed_spans('client_secret = ("Zx9Kq" "qW8rT5")')) == 2
