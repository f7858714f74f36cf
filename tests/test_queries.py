"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["token_count", "word_shape", "normalize_text", "page_status", "repetitive_lines", "segmentation_lines", "html_layout", "font_changes", "bio_islands", "citation_chained_match", "external_ids", "name_and_heading_parts",
        "section_assembly", "header_assembly", "tei_references", "box_union", "pages_to_render", "nearest_graphic_round", "training_round_trip", "session_events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if value is None or value != value else round(float(value), 9) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = lambda found: sorted(([plain(v) for v in r] for r in found), key=repr)
    assert rows(got.collect()) == rows([r[i] for i in at] for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
