"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from evalmill.plans import catalogue, more, sessions  # noqa: F401 - all register their queries

D, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries that are run on the larger tables, too: those whose small results say little.
AGAIN = ["success_share", "distractor_sample", "missing_parts", "dependency_levels", "bm25_topk", "bm25plus_topk", "latency_stats", "corpus_bleu", "online_elo", "stream_success_rate_30m", "synthesis_completion", "html_to_text", "relevance_entries", "agentic_entries", "sessions_files"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(D)


def key(rows, cols):
    return sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    got = df.collect()
    if name in catalogue.ORACLE:
        r = con.execute(catalogue.ORACLE[name])
        cols = [c[0] for c in r.description]
        assert key(got, df.columns) == key(r.fetchall(), cols)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
@pytest.mark.parametrize("name", AGAIN)
def test_query_on_more_rows(spark, name):
    df = catalogue.QUERIES[name](spark, LARGER)
    r = connect(LARGER).execute(catalogue.ORACLE[name])
    cols = [c[0] for c in r.description]
    assert key(df.collect(), df.columns) == key(r.fetchall(), cols)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
