import pytest
from pyspark.sql import functions as F

from quillstream.functions import pieces as P
from quillstream.operators import chunking as C
from quillstream.operators import inorder
from quillstream.sources.tables import written

SCHEMA = "doc_id long, label string, text string, format string, content_type string"


def cut(spark, *docs):
    rows = [(k, "lab", text, fmt, kind) for k, (text, fmt, kind) in enumerate(docs)]
    out = {k: [] for k in range(len(docs))}
    for r in C.chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id", "ordinal").collect():
        out[r.doc_id].append((r.title, r.content, r.content_type, r.format))
    return [out[k] for k in range(len(docs))]


def test_pieces_reproduce_the_text():
    for text in ("a\n" * 5000, "é" * 9000, "x" * 4096 + "\n" + "y" * 10_000 + "\nz", "", "short"):
        parts = P.bounded(text)
        assert "".join(parts) == text
        assert all(len(p.encode()) <= 4096 for p in parts)
    assert [len(w) for w in P.windows("ab\n" * 2000)] == [2045, 3954]
    assert P.packed([1000, 1000, 1000, 5000, 10]) == [0, 0, 1, 2, 3]


def test_formats(spark):
    text, log, table, array, members, lines, trace, metrics, markdown, blank = cut(
        spark,
        ("one\n\n \ntwo\nmore\n\n" + "x" * 5000, "text", None),
        ("intro\n2026-01-02 03:04:05 a\n  more\n2026-01-02 03:04:06 b\n", "log", "prose"),
        ('h1,h2\na,"x\ny"\n\nb,c\n', "csv", None),
        ('[{"id": 7, "v": {"a": [1,  2]}}, 3]', None, None),
        ('{"a": {"b":  1}, "c": null}', None, "code"),
        ('{"message": "m", "n": 1}\n\n{"user_id": "u"}\n', None, None),
        ("Traceback (most recent call last):\n  x\nValueError: a\n\nDuring handling of the above exception, another\n\nTraceback (most recent call last):\n  y\nKeyError: 'b'\npanic: p\n\ngoroutine 1 [running]:\nf()\n\ngoroutine 2 [x]:\ng()", "stacktrace", None),
        ('# HELP m_t help\n# TYPE m_t counter\nm_t{a="1"} 2\n# TYPE h histogram\nh_bucket{le="1"} 1\nh_sum 2\nh_count 1\nnot a metric\n', "metrics", None),
        ("before\n\n# A\ntext\n## B\n```go\n# no heading\n```\nafter\n\n    code\n\n# C", None, None),
        (" \n", "text", None),
    )
    assert [t[0] for t in text[:2]] == ["one", "two"] and "".join(t[1] for t in text[2:]) == "x" * 5000
    assert [t[1] for t in log] == ["intro\n2026-01-02 03:04:05 a\n  more\n2026-01-02 03:04:06 b"]
    assert [(t[0], t[1]) for t in table] == [("rows 1-2", 'h1,h2\na,"x\ny"\nb,c')]
    assert [(t[0], t[1], t[3]) for t in array] == [("records 1-2", '{"id": 7, "v": {"a": [1,  2]}}\n3', "json")]
    assert [(t[0], t[1], t[2]) for t in members] == [("a", '"a": {"b":  1}', "code"), ("c", '"c": null', "code")]
    assert [t[0] for t in lines] == ["records 1-2"]
    assert [t[0] for t in trace] == ["KeyError: 'b'", "panic: p", "goroutine 2 [x]:"]
    assert [(t[0], t[1].count("\n")) for t in metrics] == [("metric:m_t", 2), ("metric:h", 3), ("metric:unparsed", 0)]
    assert [(t[0], t[1], t[2]) for t in markdown] == [("lab", "before", "prose"), ("A", "# A\ntext", "prose"), ("A > B", "## B", "prose"), ("A > B", "```go\n# no heading\n```", "code"), ("A > B", "after", "prose"), ("A > B", "    code", "code"), ("C", "# C", "prose")]
    assert blank == []


@pytest.mark.parametrize(("record", "title"), [('{"id": 3, "name": "n"}', "name=n"), ('{"name": "%s", "x_id": 4}' % ("n" * 70), "x_id=4"), ('{"model": "m", "b": true}', "b=true"), ("[1]", "record 2"), ('{"a": {}}', "record 2"), ('{"level": null}', "level=null"), ('{"score": 1.50}', "score=1.5")])
def test_record_titles(record, title):
    assert P.record_title(record, 2) == title


def test_sections_of_a_summary_and_refused_texts(spark):
    docs = [(1, "l", "\n\n".join(f"part {k} " + "x" * 300 for k in range(60)), "text", None), (2, "l", "y" * (C.BODY_MOST + 1), "text", None), (3, "l", None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = C.sections(df).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(50)) and all(r.doc_id == 1 and len(r.preview) == 200 and r.n_bytes > 300 for r in got)
    told = {r.doc_id: (r.sections_total, r.sections_indexed, r.summary_truncated, r.refused) for r in C.summaries(df).collect()}
    assert told == {1: (60, 60, True, False), 2: (0, 0, False, True)}


def test_pages_in_order(spark):
    chunks = written(C.chunks(spark.createDataFrame([(1, "lab", "\n\n".join("é" * 100 for _ in range(40)), "text", None), (2, "lab", "y" * 4000, "text", None), (3, None, None, None, None)], SCHEMA)), "chunks").withColumn("label", F.lit("lab"))
    page = inorder.pages(chunks, 1000)
    rows = {k: sorted((r.ordinal, len(r.snippet), r.truncated, r.used_bytes) for r in page.where(F.col("doc_id") == k).collect()) for k in (1, 2)}
    size = len('{"title":"","snippet":"","source":"lab","match_layer":"document"}') + 60 * 2 + 200
    assert [r[3] for r in rows[1]] == [size, 2 * size]
    assert rows[2][0][2] is True and rows[2][0][3] == 1000
    cursor = {r.doc_id: r for r in inorder.cursors(chunks, page).collect()}
    assert cursor[1].next_offset == 2 and cursor[2].next_offset is None
    assert inorder.pages(chunks, 50).count() == 0
    again = inorder.pages(chunks, 1000, offset=39)
    assert [r.ordinal for r in again.where("doc_id = 1").collect()] == [39]


def test_all_pages(spark):
    rows = [(1, k, "", "é" * 100, "lab") for k in range(5)] + [(2, 0, "", "y" * 4000, "lab"), (2, 1, "", "z", "lab"), (3, 0, "", "a", "lab"), (3, 1, "t" * 2000, "b" * 10, "lab"), (3, 2, "", "c", "lab")]
    read = inorder.all_pages(spark.createDataFrame(rows, "doc_id long, ordinal int, title string, content string, label string"), 600)
    got = sorted((r.doc_id, r.page_no, r.offset, r.ordinal, r.truncated, r.next_offset) for r in read.where("snippet is not null").collect())
    assert got == [(1, 1, 0, 0, False, 2), (1, 1, 0, 1, False, 2), (1, 2, 2, 2, False, 4), (1, 2, 2, 3, False, 4), (1, 3, 4, 4, False, None), (2, 1, 0, 0, True, 1), (2, 2, 1, 1, False, None), (3, 1, 0, 0, False, 1)]
    ends = {(r.doc_id, r.page_no): (r.n_hits, r.next_offset) for r in inorder.all_cursors(read).collect()}
    assert ends[3, 2] == (0, 1) and (3, 3) not in ends and ends[1, 3] == (1, None)
    assert all(r.used_bytes <= 600 for r in read.collect())


def test_summaries_count_before_the_cap(spark):
    texts = ["\n\n".join("x" * 2000 for _ in range(505)), "\n\n".join("x" * 2000 for _ in range(60)), "y" * ((1 << 20) + 1)]
    df = spark.createDataFrame([(k, "lab", text, "text", None) for k, text in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.sections_total, r.sections_indexed, r.summary_truncated, r.n_bytes, r.indexed_bytes, r.refused) for r in C.summaries(df).collect()}
    assert got == {0: (505, 500, True, 505 * 2000, 500 * 2000, False), 1: (60, 60, True, 120_000, 120_000, False), 2: (0, 0, False, (1 << 20) + 1, 0, True)}
    assert C.chunks(df).count() == 560
