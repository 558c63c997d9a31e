from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare

SMALL = Path("/root/testdata/sf0.001")
CHEAP = (
    "row_count", "chunk_lookup", "token_estimate", "sanitize_chunk", "heading_normalize",
    "docset_name_valid", "source_url_canonical", "package_url_gate", "docset_updates",
    "civil_date", "duration_seconds", "suite_composition", "page_reassemble", "dense_topk",
)


# A tokenizer, which SQL cannot express: test_token_chunks compares brute force.
WITHOUT_SQL = {"chunk_markdown_bpe"}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.registry.QUERIES) - set(entry.registry.ORACLES) == WITHOUT_SQL


@pytest.mark.skipif(not SMALL.exists(), reason="needs the provided tables")
@pytest.mark.parametrize("name", CHEAP)
def test_cheap_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    df = entry.queries()[name](spark, str(SMALL))
    assert compare(df.columns, [tuple(r) for r in df.collect()], columns, expected) == ""


@pytest.mark.skipif(not SMALL.exists(), reason="needs the provided tables")
def test_the_flagship_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "qid", "pos", "chunk_idx", "score", "answer_state", "tokens", "cum_tokens", "truncated"
    ]
    assert df.count() > 0
