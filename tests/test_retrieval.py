import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.functions.stem import stem
from quillstream.operators import hits as H
from quillstream.operators import textindex as T

CORPUS = "id long, cls string, title string, content string"


@pytest.mark.parametrize(("word", "out"), [("caching", "cach"), ("cached", "cach"), ("relational", "relat"), ("ponies", "poni"), ("hopping", "hop"), ("falling", "fall"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("generalizations", "gener"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("größe", "größe"), ("is", "is")])
def test_stems(word, out):
    assert stem(word) == out


def hits(*rows):
    return pd.DataFrame(rows, columns=["qi", "rank", "size", "relevance", "snippet"])


def test_rank_round_passes_over_misfits():
    rows = hits((0, 1, 50, 1, "a"), (0, 2, 40, 1, "b"), (1, 1, 60, 1, "c"), (1, 2, 10, 1, "d"))
    assert H.rank_round(rows, 100) == [0, 1, 3]


def test_equal_budget_shares():
    rows = hits((0, 1, 51, 1, "a"), (0, 2, 50, 1, "b"), (1, 1, 51, 1, "c"), (1, 2, 9, 1, "d"))
    assert H.equal_budget(rows, 101) == [0, 3]


def test_score_proportional_moves_what_is_left():
    # Shares are 75 and 25 bytes: a hit of 60 fits the first, none the second; the 40 that are left go to the next hit of the first query.
    rows = hits((0, 1, 60, 0.75, "a"), (0, 2, 30, 0.5, "b"), (1, 1, 30, 0.25, "c"))
    assert H.score_proportional(rows, 100) == [0, 1]
    assert H._shares([1.0, 1.0, 1.0], 100) == [34, 33, 33]


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(30):
        rows = hits(*[(0, k, rng.randint(1, 30), rng.choice([0.1, 0.2, 0.5]), "x") for k in range(8)])
        chosen = H.knapsack(rows, 60)
        best = max((sum(rows.relevance[list(c)]) for n in range(9) for c in itertools.combinations(range(8), n) if sum(rows["size"][list(c)]) <= 60), default=0)
        assert sum(rows["size"][chosen]) <= 60 and abs(sum(rows.relevance[chosen]) - best) < 1e-9


def test_diverse_avoids_likeness():
    rows = hits((0, 1, 10, 1.0, "a b c"), (0, 2, 10, 0.9, "a b c"), (0, 3, 10, 0.8, "x y z"))
    assert H.diverse(rows, 20) == [0, 2]


def test_snippets():
    text = "Start here. " + "filler words and more. " * 40 + "The needle lies here. " + "tail text. " * 60
    cut, fallback = H.snippet(text, "needle?", False)
    assert "needle" in cut and cut in text and len(cut) <= 400 and not fallback
    assert H.snippet(text, "absent", False) == (H.snippet(text, "absent", False)[0], True)
    assert H.snippet("short", "x", False) == ("short", False)
    assert H.snippet(None, None, True) == ("", False)
    code = "\n".join(f"line {k}" for k in range(200))
    cut, _ = H.snippet(code, "line 150", True)
    assert cut in code and all(x.startswith("line") for x in cut.strip().split("\n"))
    assert len(H.snippet("İ" * 500 + "x", "i", False)[0]) <= 400


def test_fullest_window_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        sites = sorted({(a, rng.randint(0, 3), a + rng.randint(1, 12)) for a in (rng.randint(0, 80) for _ in range(rng.randint(1, 25)))})
        last, most = rng.randint(0, 90), rng.randint(8, 40)
        held = lambda at: [s for s in sites if s[0] >= at and s[2] <= at + most]  # noqa: E731, B023
        places = [min(s[0], last) for s in sites]  # noqa: B023
        assert H._fullest(sites, last, most) == max(places, key=lambda at: (len({s[1] for s in held(at)}), len(held(at)), -at))  # noqa: B023
    began = time.perf_counter()
    H.snippet("alpha beta " * 100_000, "alpha beta", False)
    assert time.perf_counter() - began < 20


def test_budgets_and_allocators_of_requests(spark):
    cases = [(None, 4096), (0, 4096), (-5, 4096), (100, 100), (70_000, 65_536)]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, asked int")
    assert [r.b for r in rows.select("k", H.budget(F.col("asked")).alias("b")).orderBy("k").collect()] == [b for _, b in cases]
    assert spark.range(1).select(H.budget(70_000, 0)).first()[0] == 70_000
    assert H.allocator(None, None, True) == "rank-round" and H.allocator("mmr", "knapsack-greedy", True) == "knapsack-greedy"
    assert H.allocator("mmr", "knapsack-greedy", False) == "mmr" and H.allocator("mmr", "unknown", True) == "mmr" and H.allocator("unknown", None, False) == "rank-round"


def test_meta_of_responses(spark):
    schema = "request_id long, query_id long, qi int, rank int, id long, size int, relevance double, snippet string, layer string, fallback boolean"
    rows = [(1, 10, 0, 1, 1, 60, 0.9, "a", "primary", False), (1, 11, 1, 1, 2, 30, 0.4, "b", "trigram", True), (1, 11, 1, 2, 3, 50, 0.3, "c", "trigram", False), (1, 19, 12, 1, 4, 1, 0.9, "d", "primary", False)]
    hits_ = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 19), (2, 20)], "request_id long, query_id long")
    budgets = spark.createDataFrame([(1, 100)], "request_id long, budget_bytes int")
    chosen = H.allocate(hits_.join(budgets, "request_id"), None)
    assert sorted((r.id, r.taken) for r in chosen.collect()) == [(1, 1), (2, 2)]
    got = {r.request_id: r.asDict() for r in H.search_meta(hits_, chosen, asked, budgets).collect()}
    assert got[1] == {"request_id": 1, "budget_bytes": 100, "hits_primary": 1, "hits_trigram": 1, "hit_count": 2, "snippet_fallbacks": 1, "byte_budget_used": 90, "results_refused": 1, "zero_match": 1, "results_omitted": 1, "budget_exceeded": True}
    assert got[2]["hit_count"] == 0 and got[2]["zero_match"] == 1 and got[2]["budget_bytes"] == 4096 and not got[2]["budget_exceeded"]
    assert [r.id for r in H.refused(hits_).collect()] == [4]


def test_responses_as_text(spark):
    schema = "query_id long, rank int, title string, source string, snippet string, layer string"
    hits_ = spark.createDataFrame([(1, 2, "b", "s", "two", "primary"), (1, 1, "a", None, "one", "primary"), (2, 1, "c", "s", "é" * 6_000, "trigram")], schema)
    asked = spark.createDataFrame([(1, 1, 'q "x"\n'), (1, 3, "none"), (2, 2, "long"), (3, 4, "nothing")], "request_id long, query_id long, query string")
    got = {r.request_id: (r.text, r.whole_bytes) for r in H.response_texts(hits_, asked).collect()}
    first = '2 hits across 2 queries:\n\n# "q \\"x\\"\\n" — 2 hits\n[primary] a  ()\none\n[primary] b  (s)\ntwo\n\n# "none" — 0 hits\n'
    assert got[1] == (first, len(first.encode())) and set(got) == {1, 2}
    assert got[2][0].endswith("é…") and 8190 <= len(got[2][0].encode()) - 3 <= 8192 and got[2][1] > 12_000
    sizes = {r.query_id: r.n_bytes for r in H.compact_bytes(hits_, asked).collect()}
    assert sizes[1] == len('query: q "x"\n\nsource: \ntitle: a\nmatch_layer: primary\nsnippet: one\nsource: s\ntitle: b\nmatch_layer: primary\nsnippet: two') and sizes[3] == len("query: none")


def test_tiers_weights_and_empty(spark):
    docs = spark.createDataFrame([(1, "prose", "", "alpha beta"), (2, "prose", "alpha", "x"), (3, "code", "", "alpha"), (4, "prose", "", "none here"), (5, "prose", "", "")], CORPUS)
    queries = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha"), (3, "absent")], "query_id long, term string")
    best = T.fused(T.class_ranks(T.bm25_scores(docs, queries)))
    order = {}
    for r in best.orderBy("query_id", "position").collect():
        order.setdefault(r.query_id, []).append(r.id)
    assert order[1][0] == 1 and order[2][0] in (2, 3) and order[2].index(2) < order[2].index(1) and 3 not in order
    assert T.bm25_scores(docs.limit(0), queries).count() == 0


def test_partial_hits_stay_in_the_response(spark):
    docs = spark.createDataFrame([(1, "prose", "", "alpha beta"), (2, "prose", "", "alpha only"), (3, "prose", "", "alphabet betas"), (4, "prose", "", "gamma")], CORPUS)
    queries = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma"), (2, "absent")], "query_id long, term string")
    both = T.layered(docs, T.fused(T.class_ranks(T.bm25_scores(docs, queries))), queries)
    got = sorted((r.query_id, r.position, r.id, r.layer, r.matches_all) for r in T.banded(both, "query_id").collect())
    assert got == [(1, 1, 1, "primary", True), (1, 2, 2, "primary", False), (1, 3, 3, "trigram", False), (2, 1, 4, "primary", False)]


def test_whole_queries_and_fallback_terms(spark, tmp_path):
    from quillstream.plans import retrieval

    docs = [(1, "a fox", "prose", "s"), (2, "handlelinkererror stands here", "prose", "s"), (3, "seventh", "prose", "s"), (4, "nothing", "prose", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, content_type string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "first second third fourth fifth sixth seventh fox"), (2, "the linkererror, (here)")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(r.query_id, r.id, r.layer) for r in retrieval.search_response(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "primary"), (1, 3, "primary"), (2, 2, "primary")}
    terms = T.fallback_terms(spark.createDataFrame([(2, "the linkererror, (stands)")], "query_id long, text string"), "text")
    corpus = T.corpus(spark.createDataFrame(docs, "doc_id long, text string, content_type string, source string"))
    assert [r.id for r in T.trigram_hits(corpus, terms).collect()] == [2]


def test_prose_is_searched_by_stems_and_code_is_not(spark):
    docs = spark.createDataFrame([(1, "prose", "", "cached"), (2, "code", "", "cached"), (3, "code", "", "the caching"), (4, "prose", "", "the")], CORPUS)
    queries = spark.createDataFrame([(1, "the"), (1, "caching"), (2, "the")], "query_id long, term string")
    got = {(r.query_id, r.id, r.matches_all) for r in T.bm25_scores(docs, queries, stems=True).collect()}
    assert got == {(1, 1, True), (1, 3, True), (2, 3, True)}


def test_similar_words(spark):
    words = spark.createDataFrame([("handlelinkererror",), ("sessionpoolwrapper",), ("openconnectionpool",)], "word string")
    terms = spark.createDataFrame([("linkererror",), ("userpoolwrapper",), ("connectionpool",)], "term string")
    got = {(r.term, r.word): round(r.similarity, 3) for r in T.similar_words(words, terms).collect()}
    assert got == {("linkererror", "handlelinkererror"): 0.5, ("connectionpool", "openconnectionpool"): 0.619}


def test_bands(spark):
    rows = [(1, "primary", True, 2.0), (1, "primary", True, 1.0), (1, "trigram", False, 0.7)]
    got = T.banded(spark.createDataFrame(rows, "r long, layer string, matches_all boolean, score double"), "r")
    assert sorted(r.relevance for r in got.collect()) == [0.5, 0.85, 1.0]


def test_vocabulary(spark):
    texts = spark.createDataFrame([("s", 1, "caching cached widget"), ("s", 2, "widget gizmo"), ("s", 3, None), ("s", 4, "")], "g string, k long, t string")
    prose = {(r.word, r.doc_freq) for r in T.prose_vocabulary(texts, "g", "k", "t").collect()}
    assert prose == {("cach", 1), ("widget", 2), ("gizmo", 1)}
    delta = {(r.word, r.delta) for r in T.vocabulary_delta(texts, texts.where("t like '%gizmo%'"), "g", "t").collect()}
    assert delta == {("caching", -1), ("cached", -1), ("widget", -1)}
    held = T.maintained(T.vocabulary(texts, "g", "t"), T.vocabulary_delta(texts, texts.where("t like '%gizmo%'"), "g", "t"), "g")
    assert {(r.word, r.doc_freq) for r in held.collect()} == {("widget", 1), ("gizmo", 1)}
