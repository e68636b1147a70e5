import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import sentences as S

PLAIN = ["The queue was empty. We read {n} rows. Is it late? No.", "It took {n} s. The run began at 4 a.m. UTC in the sweep.", "The team stopped at 5 p.m. Then it went idle.", "See Fig. {n} for the queue.", "We checked rows, pages etc. under load.", "The sweep waited... and then moved on. It affects rows, etc.", "Still cold... The rest is fine!"]
GERMAN = ["Am {n}. Juli fehlten Titel. Das gilt für Blöcke usw.", "Der {n}. Lauf war u. a. zu langsam. Das betrifft z. B. die Datei.", "Warum fehlt die Datei? Bitte nicht!", "„Die Datei ist leer.“ stand im Bericht."]
OTHERS = ["缓存被移动。“缓存是空的吗？”这个问题没有人回答。", "索引被移动了……然后被合并。（报告被移动。）缓存被移动。", "สำเนาถูกลบ แคชถูกลบ พบ 26 รายการ", "पंक्ति हटाई गई। क्या यह सही है? समय था।", "لماذا حفظت الجلسة؟ وردت عبارة «القائمة.» في الفهرس. انظر."]


@pytest.fixture(scope="module")
def counts():
    digest = S.Digest()
    for n in range(1, 40):
        for t in PLAIN + GERMAN:
            for part in (t.format(n=n), re.split(r"(?<=\w\w\w[.?!]) ", t.format(n=n))[-1]):  # a text, and its last sentence alone
                digest.add(n, part, False)
        for t in OTHERS:
            digest.add(n, t, False)
            for part in ("缓存被移动。", "（报告被移动。）", "索引被移动了。", "แคชถูกลบ", "समय था।", "انظر.", "The queue was empty.", "Really?", "Then it went idle."):
                digest.add(n, part, False)
    out = np.zeros(S.ARRAYS * S.BUCKETS, np.int64)
    for k, v in digest.counts().items():
        out[k] = v
    return out


def parts(text, counts, code=False):
    return [text[a:b] for a, b in S.text_units(text, counts, code)]


@pytest.mark.parametrize(
    "units",
    [
        ["The queue was empty.", "Is it late?", "Then it went idle."],
        ["The run began at 4 a.m. UTC in the sweep.", "We read 9 rows."],
        ["The team stopped at 5 p.m.", "The queue was empty."],
        ["See Fig. 8 for the queue.", "No.", "The queue was empty."],
        ["The sweep waited... and then moved on.", "Still cold...", "The rest is fine!"],
        ["„Die Datei ist leer.“ stand im Bericht.", "Am 7. Juli fehlten Titel.", "Der 5. Lauf war u. a. zu langsam."],
        ["Das betrifft z. B. die Datei.", "Bitte nicht!"],
        ["It took 3.5 s on v2.4.1 at 192.0.2.4 with main.go.", "The queue was empty."],
    ],
)
def test_prose(units, counts):
    assert parts(" ".join(units), counts) == units
    assert parts("> " + "\n> ".join(units), counts) == units
    assert parts("  ".join(units) + " \n", counts) == units


@pytest.mark.parametrize(
    "units",
    [["缓存被移动。", "“缓存是空的吗？”这个问题没有人回答。", "（报告被移动。）", "索引被移动了……然后被合并。"]],
)
def test_without_blanks(units, counts):
    assert parts("".join(units), counts) == units


def test_thai_blanks(counts):
    assert parts("สำเนาถูกลบ แคชถูกลบ พบ 26 รายการ", counts) == ["สำเนาถูกลบ", "แคชถูกลบ", "พบ 26 รายการ"]


def test_layout(counts):
    text = "# The queue was empty. Really?\nThe queue was\nempty. Is it late?\n- We read 9 rows. Then it went idle.\n- two\n\n| a. B | c |\n| d | e |\n```go\nfmt.Errorf(\"x\")\n\n  }\n```\n1. The queue was empty\n> Is it late?\nThen it went idle."
    assert parts(text, counts) == [
        "The queue was empty. Really?", "The queue was\nempty.", "Is it late?", "We read 9 rows.", "Then it went idle.", "two", "| a. B | c |", "| d | e |", 'fmt.Errorf("x")', "}",
        "The queue was empty", "Is it late?", "Then it went idle.",
    ]
    assert parts("# a. B\n\n- c\r\n", counts, code=True) == ["# a. B", "- c"]
    assert parts("", counts) == parts(" \n\t\n", counts) == []


def test_wrapped_ordinal_and_bare_quote_mark(counts):
    assert parts("Der\n5. Lauf war u. a. zu langsam.", counts) == ["Der\n5. Lauf war u. a. zu langsam."]
    assert parts("> Is it late\n>\n> The queue was empty.", counts) == ["Is it late", "The queue was empty."]


@pytest.mark.parametrize(
    "units",
    [
        ["ສຳເນົາຖືກລຶບ", "ແຄດຖືກລຶບ"],  # Lao
        ["ឯកសារត្រូវបានលុប", "ឃ្លាំងត្រូវបានលុប"],  # Khmer
        ["ဖိုင်ကိုဖျက်ခဲ့သည်", "မှတ်တမ်းကိုဖျက်ခဲ့သည်"],  # Burmese
        ["ឯកសារត្រូវបានលុប។", "ឃ្លាំងត្រូវបានលុប។"],
        ["缓存被移动", "索引被合并"],
    ],
)
def test_scripts_without_marks_or_blanks(units, counts):
    assert parts(" ".join(units), counts) == units


def test_events_between_all_words_of_a_text_without_marks():
    digest = S.Digest()
    for n in range(60):
        digest.add(n, f"The queue was empty. Then the cursor moved {n} rows on. We read the whole file again. The run ended late. Really? We saw that the cursor was slow again.", False)
    out = np.zeros(S.ARRAYS * S.BUCKETS, np.int64)
    for k, v in digest.counts().items():
        out[k] = v
    assert parts("The queue was empty Then the cursor was slow again We read the whole file again", out) == ["The queue was empty", "Then the cursor was slow again", "We read the whole file again"]
    assert parts("the queue and the whole file", out) == ["the queue and the whole file"]


def test_counts_are_sums_whatever_the_tasks():
    texts = [t.format(n=n) for n in range(9) for t in PLAIN + GERMAN] + OTHERS
    whole, parted = S.Digest(), []
    for k, t in enumerate(texts):
        whole.add(k, t, False)
        one = S.Digest()
        one.add(k, t, False)
        parted.append(one.counts())
    total = {}
    for c in parted:
        for k, n in c.items():
            total[k] = total.get(k, 0) + n
    assert {k: n for k, n in whole.counts().items() if n} == {k: n for k, n in total.items() if n}
    assert min(total.values()) >= 0


def test_long_words_and_tokens_stay_linear(counts):
    import time

    began = time.perf_counter()
    assert len(parts("A.B" * 100_000, counts)) >= 1 and len(parts("x" * 500_000 + ". The queue was empty.", counts)) == 2
    assert len(parts("word " * 100_000, counts)) >= 1
    assert time.perf_counter() - began < 60


def test_forward_backward_is_exact():
    odds, near = np.array([0.3, -0.2, 1.0, 0.5, -1.0]), np.array([False, True, True, False, True])
    w, short = np.exp(odds), np.exp(S.SHORT)
    total, yes = 0.0, np.zeros(5)
    for states in np.ndindex(2, 2, 2, 2, 2):
        p = np.prod([w[k] for k in range(5) if states[k]]) * np.prod([short for k in range(1, 5) if near[k] and states[k - 1] and states[k]])
        total += p
        yes += p * np.array(states)
    assert np.allclose(S.posteriors(odds, near), np.log(yes / (total - yes)))


def test_on_spark(spark):
    long = "The queue was empty. " * 30_000
    rows = [(1, "The queue was empty. Is it late?", "prose", 9), (2, None, "prose", 9), (3, " ", None, 9), (4, "a.\nb", "code", 9), (5, long, None, 9), (None, "The queue was empty.", "prose", 9), (1, "The queue was empty. Is it late?", "prose", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_type string, char_start int")
    got = S.sentence_units(docs)
    by = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert by == {1: 4, 4: 2, 5: 30_000, None: 1}
    assert {(r.char_start, r.char_end) for r in got.where("doc_id = 1").collect()} == {(0, 20), (21, 32)}
    assert S.sentence_units(docs.where(F.lit(False))).count() == 0
