import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from quillstream.operators import delivery as D

SCHEMA = "id long, session_id long, type string, priority int, data string, data_hash binary, file string, row long, n long"


def real_hash(kind, data):
    a, b = (kind or "").encode(), (data or "").encode()
    return hashlib.sha256(struct.pack(">Q", len(a)) + a + struct.pack(">Q", len(b)) + b).digest()


def table(spark, tmp_path, rows, files=3):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return path


def row(i, session=1, kind="a", data="{}", stored=True, **kw):
    return (i, session, kind, 1, data, real_hash(kind, data) if stored is True else stored, kw.get("file", "x"), 0, 0)


def dropped(rows):
    seen, out = set(), set()
    for r in sorted(rows):
        key = (r[1], r[2], r[5] or real_hash(r[2], r[4]))
        if key in seen:
            out.add(r[0])
        seen.add(key)
    return out


def test_against_brute_force(spark, tmp_path):
    rows = [row(i, i % 7 if i % 3 else None, "ab"[i % 2], '{"k": %d}' % (i % 11), None if i % 5 == 0 else True) for i in range(1, 400)]
    path = table(spark, tmp_path, rows)
    gone = {r.id for r in D.deduplicated_events(spark, path, ["id"], deleted=True).collect()}
    assert gone == dropped(rows)
    kept = D.deduplicated_events(spark, path)
    assert {r.id for r in kept.collect()} == {r[0] for r in rows} - gone
    assert kept.columns == spark.read.parquet(path).columns


def test_nulls_and_clashing_columns(spark, tmp_path):
    rows = [row(1, None, None, None, None), row(2, None, None, None, None), row(3, None, None, "", None), row(4, 1, "", "é<>&", None), row(5, 1, "", "é<>&", True)]
    gone = {r.id for r in D.deduplicated_events(spark, table(spark, tmp_path, rows), ["id"], deleted=True).collect()}
    assert gone == {2, 3, 5}


def test_hot_key_in_several_files(spark, tmp_path):
    rows = [row(i, 1, "a", "same") for i in range(1, 3000)]
    path = table(spark, tmp_path, rows, 5)
    assert [r.id for r in D.deduplicated_events(spark, path, ["id"]).collect()] == [1]


def test_empty_table(spark, tmp_path):
    path = table(spark, tmp_path, [])
    assert D.deduplicated_events(spark, path).count() == 0
    assert D.deduplicated_events(spark, path, ["id"], deleted=True).count() == 0


@pytest.mark.parametrize("bound", [1, 8192])
def test_file_groups_below_the_bound(spark, tmp_path, bound):
    rows = [row(i, i % 50, "a", "x") for i in range(1, 500)]
    path = table(spark, tmp_path, rows, 4)
    scan = spark.read.parquet(path)
    losers = D.losing_positions(scan, {c: F.col(c) for c in ("session_id", "type", "data_hash")}, "id")
    vectors = D.deletion_vectors(losers)
    kept = D.apply_deletion_vectors(spark, path, vectors, ["id"], broadcast_bytes=bound)
    assert sorted(r.id for r in kept.collect()) == sorted(set(range(1, 500)) - dropped(rows))


def test_many_rows_in_one_file_cross_buckets(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(100_000).selectExpr("id", "id % 40000 as session_id", "'t' as type", "cast('h' as binary) as data_hash", "'' as data").coalesce(1).write.parquet(path)
    kept = D.deduplicated_events(spark, path, ["id"])
    assert kept.agg(F.count("id"), F.max("id")).first() == (40_000, 39_999)
