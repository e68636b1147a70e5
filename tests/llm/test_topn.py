import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm.topn import SortKey, first_n_per_group, foremost_events

SCHEMA = "session_id long, priority int, created_at timestamp_ntz, id long, rank_no string, extra string"


def rows(n, groups, seed=1):
    import datetime as dt

    rng = random.Random(seed)
    return [(rng.choice(groups), rng.choice([1, 2, 3, None]), rng.choice([None, dt.datetime(2026, 1, rng.randint(1, 28), rng.randint(0, 3))]), i, "old", "x") for i in range(n)]


def brute(data, n):
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    out = set()
    for g, own in by.items():
        own.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, -(r[2].timestamp()) if r[2] else 0, r[3]))
        out |= {(g, k + 1, r[3]) for k, r in enumerate(own[:n])}
    return out


@pytest.mark.parametrize("n", [1, 5, 40])
def test_against_brute_force(spark, n):
    data = rows(2000, [1] * 10 + [2, 3, None] + list(range(10, 60)))
    got = foremost_events(spark.createDataFrame(data, SCHEMA), n)
    assert {(r.session_id, r.rank_no, r.id) for r in got.collect()} == brute(data, n)


def test_one_bucket_of_ties(spark):
    data = [(1, 1, None, i, "old", "x") for i in range(5000)]
    got = foremost_events(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_repeated_rows_all_count(spark):
    data = [(1, 1, None, 7, "old", "x")] * 9
    assert foremost_events(spark.createDataFrame(data, SCHEMA)).count() == 5


def test_empty_and_no_rows_wanted(spark):
    df = spark.createDataFrame(rows(20, [1]), SCHEMA)
    assert foremost_events(df.where(F.lit(False))).count() == 0
    assert foremost_events(df, 0).count() == 0


def test_threshold_prunes_heavy_groups(spark):
    df = spark.range(10_000).select(F.lit(1).alias("g"), F.col("id"))
    got = first_n_per_group(df, ["g"], [SortKey("id", False, -F.floor(F.col("id") / 100))], 3)
    assert sorted(r.id for r in got.collect()) == [9997, 9998, 9999]
    assert "__top_limit" in got._jdf.queryExecution().toString()


def test_several_group_columns(spark):
    df = spark.createDataFrame([("a", None, 3), ("a", None, 1), ("a", 1, 2)], "x string, y int, v int")
    assert {tuple(r) for r in first_n_per_group(df, ["x", "y"], [SortKey("v")], 1).collect()} == {("a", None, 1, 1), ("a", 1, 2, 1)}
