"""Registered queries against their SQL; MSGSEARCH_ALL=1 takes every one of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect
from workload.registry import QUERIES as WORKLOAD

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
USUAL = """
scan_messages resolve_chats enrich_messages incremental_anti incremental_watermark ingest_counts
document_exists index_postings index_field_stats tokenize_mixed_script tokenize_queries
search_filtered_session search_match_all search_filtered_few search_cjk parse_flags search_indexed
context_range render_chunks split_texts stream_counts
""".split()
NAMES = sorted(set(ORACLES) & set(WORKLOAD)) if os.environ.get("MSGSEARCH_ALL") else USUAL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(WORKLOAD) <= set(ORACLES) and set(WORKLOAD) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert [r.date for r in rows] == sorted((r.date for r in rows), reverse=True)
