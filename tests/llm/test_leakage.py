import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import leakage as L

RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(300)]
ITEM = [RNG.choice(VOCABULARY) for _ in range(120)]
HAN = "".join(chr(0x4E00 + RNG.randint(0, 2000)) for _ in range(120))


def noise(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def cases(doc_words, item_words):
    """Brute force over all offsets."""
    for o in range(-len(item_words), len(doc_words)):
        same = [0 <= k + o < len(doc_words) and doc_words[k + o] == w for k, w in enumerate(item_words)]
        if any(all(same[k : k + 16]) for k in range(len(same) - 15)):
            return True
        for k in range(len(same) - 21):
            inside = all(0 <= k + i + o < len(doc_words) for i in range(22))
            if inside and sum(same[k : k + 22]) >= 21:
                return True
    return False


def search(docs, items):
    """By shared MinHashes, then exactly; all pairs that brute force finds must share one."""
    found = set()
    for k, own in items:
        part, units = L.partition_of(" ".join(own)) or (None, None)
        for d, doc in enumerate(docs):
            if part and set(L.signature_set(units, part)) & set(L.signature_set(doc, part)) and L.contained(L.Units(doc), L.Units(units), part):
                found.add((d, k))
    return found


def test_against_brute_force():
    items = [(k, [RNG.choice(VOCABULARY[:40]) for _ in range(RNG.choice([10, 16, 19, 21, 22, 30, 80]))]) for k in range(25)]
    docs = []
    for _ in range(120):
        words = noise(RNG.randint(0, 60))
        for _ in range(RNG.randint(0, 3)):
            own = list(RNG.choice(items)[1])
            at, n = RNG.randint(0, len(own)), RNG.randint(8, 30)
            piece = own[at : at + n]
            for _ in range(RNG.randint(0, 2)):
                if piece:
                    piece[RNG.randrange(len(piece))] = RNG.choice([*VOCABULARY[:40], "new"])
            words += piece + noise(RNG.randint(0, 9))
        docs.append(words)
    want = {(d, i) for d, doc in enumerate(docs) for i, own in items if cases(doc, own)}
    assert len(want) > 10
    assert search(docs, items) == want


@pytest.mark.parametrize(("n", "hit"), [(15, False), (16, True), (40, True)])
def test_unchanged_run(n, hit):
    assert bool(search([noise(50) + ITEM[30 : 30 + n] + ["zz"]], [(7, ITEM)])) == hit


@pytest.mark.parametrize("place", range(22))
def test_one_word_replaced(place):
    piece = ITEM[40:62]
    piece[place] = "other"
    assert search([["zz", *piece, "zz"]], [(7, ITEM)]) == {(0, 7)}
    assert (search([["zz", *piece[1:], "zz"]], [(7, ITEM)]) == set()) == (1 <= place < 17 and place - 1 < 16 and 21 - place < 16)


@pytest.mark.parametrize(("n", "hit"), [(29, False), (30, True)])
def test_characters(n, hit):
    part, units = L.partition_of(HAN)
    doc = L.characters("x" + HAN[50 : 50 + n] + "。")
    assert part is L.CHARACTERS and L.contained(L.Units(doc), L.Units(units), part) == hit
    assert not hit or set(L.signature_set(units, part)) & set(L.signature_set(doc, part))


def test_candidates_are_few_and_hold_all_cases(spark):
    items = [(k, " ".join(RNG.choice(VOCABULARY[:60]) for _ in range(RNG.choice([16, 20, 25, 70])))) for k in range(40)]
    docs = []
    for d in range(150):
        own = RNG.choice(items)[1].split()
        at = RNG.randint(0, max(0, len(own) - 22))
        docs.append((d, " ".join(noise(40) + (own[at : at + 22] if d % 3 == 0 else own[at : at + 8]) + noise(20))))
    want = {(d, k) for d, t in docs for k, own in items if cases(t.split(), own.split())}
    pairs = {tuple(r) for r in L.candidate_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 40 and want <= pairs
    assert len(pairs - want) < 25  # of a hundred documents with eight words of an item in a row


def test_repeated_words_stay_linear():
    item = ["a"] * 200
    assert not L.contained(L.Units((["a"] * 15 + ["b"]) * 2_000), L.Units([*(["a"] * 15), "c", "d"] * 5), L.WORDS)
    assert L.contained(L.Units(["a"] * 100_000), L.Units(item), L.WORDS)


def test_on_spark(spark):
    text = " ".join(ITEM)
    altered = "# " + "**" + ", ".join(w.upper() for w in ITEM[20:40]) + "**\n> x"
    rows = [(1, altered, 9), (2, " ".join(noise(100)), 9), (3, None, 9), (4, "  ", 9), (5, "a " * 300_000 + " ".join(ITEM[:16]), 9), (1, altered, 9), (None, text, 9), (6, HAN[10:35] + "\n" + HAN[35:45], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, text, "s", True), (8, HAN, None, False), (9, None, None, None), (10, "short", None, None), (7, text, "s", True)], "item_id long, text string, suite string, is_required boolean")
    want = {(1, 7), (5, 7), (None, 7), (6, 8)}
    pairs = L.leaked_pairs(docs, items)
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in L.leaked_pairs(docs, items, batch_chars=50).collect()} == want
    assert {(r.item_id, r.n_docs) for r in L.leaked_items(pairs, items).collect()} == {(7, 3), (8, 1), (9, 0), (10, 0)}
    assert L.leaked_pairs(docs.where(F.lit(False)), items).count() == 0
    assert L.leaked_pairs(docs, items.where(F.lit(False))).count() == 0


def test_letter_case_of_any_script():
    item = ["straße", "größe", *ITEM[:20]]
    shouted = L.words(" ".join(item).upper())
    assert search([shouted], [(1, L.words(" ".join(item)))]) == {(0, 1)}
