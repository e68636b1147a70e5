import pytest
from pyspark.sql import functions as F

from quillstream.llm import mixing as M

TARGETS = "source string, target_weight double, max_repeats int, slot int"


def corpus(spark, counts):
    rows = [(i, s, " word" * n) for s, (docs, n) in counts.items() for i in range(hash_free(s), hash_free(s) + docs)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit(1))


def hash_free(s):
    return sum(map(ord, s)) * 10_000


def slot_sizes(rows):
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, {}).setdefault(r.slot, 0)
        sizes[r.source][r.slot] += r.n_tokens
    return sizes


def check_slots(rows, block):
    """Every slot has one source; of a source all slots are full but one at most, and there are as many as blocks."""
    sizes = slot_sizes(rows)
    slots = [slot for by in sizes.values() for slot in by]
    assert sorted(slots) == list(range(len(slots)))
    for by in sizes.values():
        assert sum(n != block for n in by.values()) <= 1 and max(by.values()) <= block
        assert len(by) == -(-sum(by.values()) // block)


@pytest.mark.parametrize(("total", "want"), [(None, {"a": 12_713, "b": 6_300, "c": 3_300}), (40_000, {"a": 20_000, "b": 6_300, "c": 3_300}), (5_000, {"a": 2_500, "b": 1_500, "c": 1_000})])
def test_shares_and_repeats(spark, total, want):
    # The default total are the 25,425 tokens of all documents; b and c may give 6,300 and 3,300.
    docs = corpus(spark, {"a": (400, 50), "b": (30, 70), "c": (300, 11), "loose": (5, 5)})
    targets = spark.createDataFrame([("a", 0.5, 2, 0), ("b", 0.3, 3, 0), ("c", 0.2, 1, 0)], TARGETS)
    rows = M.mixture(spark, docs, targets, block_tokens=256, total_tokens=total).collect()
    assert {s: sum(r.n_tokens for r in rows if r.source == s) for s in "abc"} == want
    used = {}
    for r in rows:
        used.setdefault((r.source, r.doc_id, r.repeat_no), []).append((r.token_from, r.n_tokens))
    size = {"a": 50, "b": 70, "c": 11}
    partial = 0
    for (s, _, _), pieces in used.items():
        pieces.sort()
        ends = [f + n for f, n in pieces]
        assert pieces[0][0] == 0 and [f for f, _ in pieces[1:]] == ends[:-1]
        partial += ends[-1] != size[s]
    assert partial <= 3
    assert max(r.repeat_no for r in rows if r.source == "a") <= 2
    assert max(r.repeat_no for r in rows if r.source == "b") <= 3
    check_slots(rows, 256)


def test_small_weights_beside_large_ones_lose_no_block(spark):
    weights = {"a": 4000, "b": 1, "c": 10, "d": 4000, "e": 5, "f": 1}
    docs = corpus(spark, {s: (40, 40 * w // 40 + 1) for s, w in weights.items()})
    targets = spark.createDataFrame([(s, w / sum(weights.values()), 1, 0) for s, w in weights.items()], TARGETS)
    rows = M.mixture(spark, docs, targets, block_tokens=16, total_tokens=40 * sum(weights.values())).collect()
    assert {s: sum(by.values()) for s, by in slot_sizes(rows).items()} == {s: 40 * w for s, w in weights.items()}
    check_slots(rows, 16)


def test_every_block_has_a_slot(spark):
    blocks = [("a", 70_000), ("b", 1), ("c", 66_001), ("d", 3)]
    placed = M.schedule(spark, blocks)
    want = spark.createDataFrame(blocks, "source string, n long").select("source", F.explode(F.expr("sequence(0, n - 1)")).alias("block"))
    assert want.join(placed, ["source", "block"], "left_anti").count() == 0
    assert placed.count() == placed.select("slot").distinct().count() == sum(n for _, n in blocks)


def test_places_without_overflow(spark):
    size = (1 << 40) - 87
    step = M.golden_step(size)
    slots = [0, 1, 12_345, size - 1, size // 2]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select(M._place(F.col("slot"), step, size)).collect()
    assert [g[0] for g in got] == [s * step % size for s in slots]


def test_schedule_spreads_sources(spark):
    docs = corpus(spark, {"a": (200, 64), "b": (200, 64)})
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 1, 0)], TARGETS)
    order = [r.source for r in M.mixture(spark, docs, targets, block_tokens=64).select("slot", "source").distinct().orderBy("slot").collect()]
    assert len(order) == 400
    for k in range(len(order) - 20):
        assert 8 <= order[k : k + 20].count("a") <= 12


def test_report_texts_and_edges(spark):
    rows = [(1, "a", "one two three"), (2, "a", None), (3, "a", ""), (4, None, "x"), (5, "b", "naïve 猫と犬 😀 " * 5_000), (6, "a", "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 4, 0), ("b", 0.5, 1, 0), ("none", 0.2, 3, 0), ("zero", 0.0, 3, 0), ("null", None, None, 0)], TARGETS)
    sizes = M.token_counts(docs)
    mixed = M.mixture(spark, docs, targets)
    shares = {r.source: r for r in M.mixture_shares(mixed, sizes, targets).collect()}
    total = sum(r.n_tokens for r in sizes.collect())
    assert shares["a"].n_tokens == 24 and shares["a"].most_repeats == 4 and shares["a"].shortfall == (total + 1) // 2 - 24
    assert shares["b"].n_tokens == shares["b"].wanted_tokens and shares["b"].shortfall == 0
    assert shares["b"].actual_share == shares["b"].n_tokens / (shares["b"].n_tokens + 24)
    assert shares["none"].actual_share == shares["zero"].n_tokens == shares["null"].n_tokens == 0
    texts = M.with_texts(mixed.where("source = 'b'"), docs).orderBy("repeat_no", "token_from").collect()
    assert len(texts) > 5 and rows[4][2].startswith("".join(t.text for t in texts))
    assert M.mixture(spark, docs.where(F.lit(False)), targets).count() == 0
    assert M.mixture(spark, docs, targets.where(F.lit(False))).count() == 0
