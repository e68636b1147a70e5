import glob
import importlib
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUILLSTREAM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same(rows):
    def plain(v):
        return round(v, 5) if isinstance(v, float) else str(v) if isinstance(v, (list, bytes, bytearray)) else v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    places = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(places) == columns
    want = [tuple(r[places[c]] for c in columns) for r in cursor.fetchall()]
    assert same(tuple(r) for r in got.select(*columns).collect()) == same(want)


#: Least rows and columns of the queries that SQL can't express; their operators' tests decide whether the rows are right.
SHAPES = {
    "p2_found": (100, {"event_id", "stream", "first_line", "last_line", "ts_ms", "level", "component"}),
    "p2_unparsed": (1, {"event_id", "stream", "first_line", "last_line"}),
    "p5_variants": (5, {"variant", "child", "kind", "n", "n_records"}),
    "capture_events": (50, {"event_id", "type", "priority", "command", "exit_code", "trace_snippet", "latest_source", "history_source"}),
    "vocabulary_prose_stems": (100, {"source", "word", "doc_freq"}),
    "chunks_documents": (200, {"doc_id", "ordinal", "title", "content", "content_type", "format"}),
    "search_meta": (30, {"request_id", "budget_bytes", "hits_primary", "hits_trigram", "hit_count", "snippet_fallbacks", "byte_budget_used", "results_refused", "zero_match", "results_omitted", "budget_exceeded"}),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_others_have_rows_and_columns(spark, name):
    least, columns = SHAPES[name]
    got = entry.queries()[name](spark, DATA)
    assert columns <= set(got.columns)
    rows = got.collect()
    assert len(rows) >= least
    assert any(all(v is not None for v in r) for r in rows) or name == "capture_events"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.import_module("quillstream") is not None
