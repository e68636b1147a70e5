import numpy as np
import pytest

from quillstream.operators import bestfirst as S
from quillstream.operators import textindex as T
from quillstream.plans import retrieval

CORPUS = "id long, cls string, title string, content string"


def shuffled_records(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_related_documents_shuffle_no_postings(spark, tmp_path):
    words = "amber basalt cedar delta ember".split()
    docs = [(k, f"common {words[k % 5]} {k % 7}\ncommon text {k}", "code" if k % 3 else "prose", "s") for k in range(2_000)]
    spark.createDataFrame(docs, "doc_id long, text string, content_type string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled_records(spark)
    got = retrieval.search_related(spark, str(tmp_path)).collect()
    assert len(got) == 100 * 5 and {r.query_id for r in got} == set(range(0, 2_000, 20))
    assert shuffled_records(spark) - before < len(docs)  # of each text several terms are asked for
    texts = {k: set(t.lower().split()) for k, t, _, _ in docs}
    titles = {k: set(t.split("\n")[0].split()) for k, t, _, _ in docs}
    assert all(r.matches_all == (titles[r.query_id] <= texts[r.id]) for r in got)


def random_corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(40)])
    p = 1 / np.arange(1, 41) / (1 / np.arange(1, 41)).sum()
    text = lambda most: " ".join(rng.choice(words, rng.integers(0, most), p=p))
    docs = [(int(k), "code" if rng.random() < 0.3 else "prose", text(6), text(30)) for k in rng.permutation(n)]
    docs += [(n + k, *docs[k][1:]) for k in range(n // 4)]  # copies, whose scores tie
    queries = sorted({(q, str(w)) for q in range(60) for w in rng.choice(words, rng.integers(1, 7), p=p)} | {(60, "absent"), (61, "absent"), (61, "w0")})
    return docs, queries


@pytest.mark.parametrize("seed", [1, 2])
def test_best_hits_are_those_of_all_scores(spark, seed):
    docs, queries = random_corpus(300, seed)
    docs = spark.createDataFrame(docs, CORPUS).repartition(3)
    queries = spark.createDataFrame(queries, "query_id long, term string")
    columns = ["query_id", "cls", "id", "score", "matches_all", "class_rank"]
    want = {tuple(r) for r in T.class_ranks(T.bm25_scores(docs, queries)).select(columns).collect()}
    hits, members = S.best_hits(docs, queries)
    got = T.class_ranks(hits.join(members, "set")).select(columns).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_corpus_and_no_queries(spark):
    docs, queries = spark.createDataFrame([(1, "prose", "a", "a b")], CORPUS), spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert S.best_hits(docs.limit(0), queries)[0].count() == 0
    assert S.best_hits(docs, queries.limit(0))[0].count() == 0
    assert [(r.id, r.matches_all) for r in S.best_hits(docs, queries)[0].collect()] == [(1, True)]


def test_a_text_without_an_id_is_found(spark):
    docs = spark.createDataFrame([(1, "prose", "a", "a b"), (None, "prose", "a", "a b"), (2, "code", "", "")], CORPUS)
    hits, _ = S.best_hits(docs, spark.createDataFrame([(1, "a")], "query_id long, term string"))
    assert {(r.id, r.score) for r in hits.collect()} == {(k, hits.first().score) for k in (1, None)}


@pytest.mark.parametrize("most", [1, 3, 10])
def test_blocks_with_bounds_give_what_all_sums_give(most):
    rng = np.random.default_rng(most)
    n_terms, n = 30, 4_000
    p = 1 / np.arange(1, n_terms + 1)
    held = rng.random((n, n_terms)) < p
    parts = np.where(held, np.round(rng.random((n, n_terms)) ** 3 * 8 / p, 1) + 0.01, 0)
    ids = rng.permutation(n)
    blocks = []
    for a, z in ((0, 50), (50, 400), (400, 3_999), (3_999, 4_000)):
        owner, codes = np.nonzero(held[a:z])
        blocks.append(S.Postings(ids[a:z], owner, codes, parts[a:z][owner, codes], n_terms))
    for _ in range(200):
        terms = rng.choice(n_terms, rng.integers(1, 8), replace=False)
        best = None
        for b in blocks:
            best = b.search(terms, best, most)
        sums = np.zeros(n)
        for t in terms:
            sums += parts[:, t]
        found = np.flatnonzero(held[:, terms].any(1))
        keys, want = S._joined(None, S._rounded(sums[found]) + S.ALL * held[found][:, terms].all(1), ids[found], most)
        assert best[1].tolist() == want.tolist() and np.allclose(best[0], keys)
