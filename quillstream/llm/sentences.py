"""Sentence units in many scripts, by a hidden-event n-gram language model.

Layout first: blank lines, headings, list items, quoted blocks, table rows and
fenced code part a text into blocks, with offsets into the text as it stands.
Inside a block a hidden event, boundary or none, is inserted between tokens:
after every mark that may end a sentence (with its closing quotes), at every
blank between letters of a script that has no sentence marks and writes words
without blanks, and in a block that has no mark at all between all its words.

The n-gram before an event (the word with its mark and closers, numbers and
lone letters with the word before them; without a mark the word) and the token
after it decide, together with the events beside it.  The model knows how often
such an n-gram ends a block, which kinds of tokens follow it, how often a token
begins a block, stands inside a sentence or ends one; all counts come from all
documents (`fit_model`), and abbreviations are what they show to be such: words
with a full stop that hardly ever end a block, or after which tokens of a kind
come more often than boundaries explain.  Rare n-grams lean on all those of
their shape.  A forward-backward pass over the events of each block gives the
posterior of each boundary, and those of 0.5 or more part the block.

The texts are read once: that pass writes blocks and events as numbers beside
the counts.  Counts are sums hashed into arrays of fixed size, so the model is
the same however the texts lie in tasks and has the same size for any corpus;
the events are then decided in whole batches.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.sources.tables import written

BUCKETS = 1 << 18
#: Count arrays: n-gram seen, n-gram at the end of a block, token at a block's begin, token inside a sentence, word before a full stop,
#: n-gram with the class of the token after it; and in the last array classes at the begin and inside, shapes of n-grams seen, at the end of a block and with the class of the token after them.
ARRAYS = 7
SEEN, ENDED, BEGINS, INSIDE, LAST, FOLLOWED, SMALL = range(ARRAYS)
BEGIN_CLASS, INSIDE_CLASS, SEEN_SHAPE, ENDED_SHAPE, SHAPE_CLASS = 0, 64, 128, 192, 256

OPENERS = "\"'“„«‘‹([{（「『【《¿¡`"
CJK_MARKS = "。！？｡．"
MARKS = ".!?…؟۔।॥" + "។៕" + "။" + "།༎" + "።፧" + "։" + CJK_MARKS
OTHERS = MARKS.replace(".", "")
#: Letters of scripts that write words without blanks and mark no sentences (Thai, Lao, Khmer, Burmese) ...
UNMARKED = "\u0e01-\u0e7f\u0e81-\u0eff\u1780-\u17d3\u1000-\u1049"
# ... and of those that mark them (kana, Han).
SOLID_SCRIPTS = UNMARKED + "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
GAP = re.compile(
    rf"(\.(?![.0-9a-z,;:/_=&%'-])|[{MARKS}]{{2,}}|[{OTHERS}])((?:[\"'”“’)\]»›）」』】》`*_]|[ \u00a0\u202f](?=[»›])[»›])*)|(?<=[{UNMARKED}])(?:\s+)(?=[{UNMARKED}])"
)
WORD_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
UNMARKED_LETTER = re.compile(f"[{UNMARKED}]")
SOLID_LETTER = re.compile(f"[{SOLID_SCRIPTS}]")
MARK = re.compile(rf"\.(?![.0-9a-z,;:/_=&%'-])|[{MARKS}]{{2,}}|[{OTHERS}]")
BLANKS = re.compile(r"\s*")
SOLID = re.compile(r"\S*")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?=\s|$)")
ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])(?=\s)")
QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
TABLE = re.compile(r"[ \t]*\|")
DIGITS = re.compile(r"\d[\d.,:]*")
TRAILERS = ".,;:!?\"'”“’»›)]）」』】》،؛؟。，、！？…"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())


def blocks(text: str, code: bool) -> Iterator[tuple[str, int, int, str | None]]:
    """(kind, start, end, masked text) of the blocks of a text.

    kind is `line` for what is one unit whatever it holds, else `prose`.  The
    masked text of prose has blanks in place of the markers of quoted lines.
    """
    at, fence = 0, None
    held: list[tuple[str, int, int, str]] = []  # lines of the open block: kind, start, end, masked line

    def closed() -> Iterator[tuple[str, int, int, str | None]]:
        if held:
            yield "prose", held[0][1], held[-1][2], "\n".join(x[3] for x in held)
            held.clear()

    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        if not line or line.isspace():
            if fence is None:
                yield from closed()
            continue
        if code:
            yield "line", start, end, None
            continue
        head = line.lstrip(" \t")[:1]
        if head in "`~" and (m := FENCE.match(line)):
            if fence is None:
                yield from closed()
                fence = m[1]
                continue
            if m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = None
                continue
        if fence is not None:
            yield "line", start, end, None
            continue
        if head == "#" and (m := HEADING.match(line)):
            yield from closed()
            yield "line", start + m.end(), end, None
        elif head == "|" and TABLE.match(line):
            yield from closed()
            yield "line", start, end, None
        elif head == ">" and (m := QUOTE.match(line)):
            if held and held[-1][0] != "quote" or not line[m.end() :].strip():
                yield from closed()
            if line[m.end() :].strip():
                held.append(("quote", start, end, " " * m.end() + line[m.end() :]))
        elif (head in "-*+•" or head.isdigit()) and (m := ITEM.match(line)) and not (held and held[-1][0] == "text" and head.isdigit() and m[0].strip()[:-1] != "1"):
            # Within a paragraph only a 1 begins a numbered list: other figures are a wrapped line's.
            yield from closed()
            yield "prose", start, end, " " * m.end() + line[m.end() :]
        else:
            if held and held[-1][0] != "text":
                yield from closed()
            held.append(("text", start, end, line))
    yield from closed()


def token_class(token: str) -> int:
    """0 title case, 1 capitals, 2 lower case, 3 figure, 4 identifier, 5 letters without case, 6 others."""
    body = token.lstrip(OPENERS)
    if not body:
        return 6
    first = body[0]
    if first.isdigit():
        return 3
    if not first.isalpha():
        return 6
    if token[0] == "`" or "_" in body or "(" in body or (first.islower() and not body.islower() and body.isascii()):
        return 4
    if first.isupper():
        return 1 if len(body) > 1 and body.isupper() else 0
    return 2 if first.islower() else 5


CHUNK = re.compile(rf"[{re.escape(OPENERS)}]*(?:([{UNMARKED}]{{1,4}})|([\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff].?)|[^\s{OTHERS}]*)")


def token_at(text: str, at: int) -> str:
    """The token that begins at a place: a word with its opening marks; a few letters where words have no blanks."""
    m = CHUNK.match(text, at)
    return m[0] if m.lastindex else normal(m[0])


def normal(chunk: str) -> str:
    word = chunk.rstrip(TRAILERS)
    if word[:1].isdigit():
        return "0"
    return word or chunk[:2]


def bucket(kind: int, key: str) -> int:
    return kind * BUCKETS + (zlib.crc32(key.encode("utf-8", "surrogatepass")) & (BUCKETS - 1))


def gaps(block: str) -> Iterator[tuple[int, int, str, str]]:
    """(end of the sentence, begin of the next, context before, token after) of the possible boundaries of a block.

    The mark at the block's end comes last, with the block's length as both
    places and an empty token.  Without any mark all blanks are such places.
    """
    n = len(block)
    if not MARK.search(block) and not UNMARKED_LETTER.search(block):
        yield from word_gaps(block)
        return
    for m in GAP.finditer(block):
        mark, close, end = m[1], m[2], m.end()
        if mark is None:
            yield m.start(), end, "฀" + block[max(0, m.start() - 4) : m.start()], token_at(block, end)
            continue
        if mark[-1] in CJK_MARKS + "।॥" or mark[0] == "…" and close[:1] == "“":
            if "“" in close:  # there an opening quote
                end = m.end(1) + close.index("“")
                close = close[: close.index("“")]
        elif close and close[-1] in "\"'`*_" and end < n and block[end].isalnum():
            # a quote right before a word opens, unless one is open
            if block.count(close[-1], 0, end - 1) % 2 == 0:
                end -= 1
                close = close[:-1]
        begin = BLANKS.match(block, end).end()
        if begin >= n:
            yield n, n, context(block, m.start(), mark, close), ""
            return
        if begin == end and mark[-1] not in CJK_MARKS:
            after, before = block[begin], block[m.start() - 1] if m.start() else " "
            opened = after in OPENERS and begin + 1 < n and block[begin + 1].isalpha()
            word = after.isupper() and begin + 1 < n and (block[begin + 1].islower() or block[begin + 1] == " ")
            foreign = after.isalpha() and not after.isascii() and not before.isascii() and after.islower() == after.isupper()
            digit_mark = mark[-1] in "।॥؟۔" and after.isalnum()
            if not (digit_mark or foreign or (before.isalnum() or close) and (word or opened and before.islower())):
                continue
        yield end, begin, context(block, m.start(), mark, close), token_at(block, begin)


def word_gaps(block: str) -> Iterator[tuple[int, int, str, str]]:
    """The blanks of a block without marks; those between letters of a script without blanks stand for marks."""
    at = 0
    for m in WORD_GAP.finditer(block):
        if SOLID_LETTER.match(block, m.start() - 1) and SOLID_LETTER.match(block, m.end()):
            yield m.start(), m.end(), "\u0e00" + block[max(0, m.start() - 4) : m.start()], token_at(block, m.end())
        else:
            yield m.start(), m.end(), "\u2423" + normal(block[at : m.start()].lstrip(OPENERS)).lower(), token_at(block, m.end())
        at = m.end()


def context(block: str, at: int, mark: str, close: str) -> str:
    """The n-gram before a gap: mark and closers, after a lone full stop with the word."""
    tail = "".join("”" if c in "\"'”“’»›」』" else ")" if c in ")]）】》" else "" for c in close if not c.isspace())[:1]
    if mark != ".":
        kind = "…" if len(mark) > 1 and set(mark) <= {".", "…"} or mark[0] == "…" else mark[-1]
        return kind + tail
    if tail:
        return "." + tail
    if at and block[at - 1].isspace():
        return "."
    start = word_start(block, at)
    word = block[start:at].lstrip(OPENERS).lower().rpartition("'")[2].rpartition("’")[2]
    if not word or len(word) > 2 and not word[0].isdigit():
        return word + "."
    before = len(block[:start].rstrip()) if start and block[start - 1].isspace() else 0
    earlier = block[word_start(block, before) : before].lstrip(OPENERS).lower()
    earlier = earlier[max(map(earlier.rfind, ".!?")) + 1 :] or earlier  # a blank may be missing
    if DIGITS.fullmatch(word):
        return f"{'0' if earlier[:1].isdigit() else earlier} 0."
    if earlier.endswith(".") and len(earlier) <= 3:
        return f"{earlier}{word}."
    return f"{word}."


def word_start(block: str, end: int) -> int:
    """Where the word before a place begins: behind a blank, or behind the fourth full stop to the left."""
    stops = 0
    at = end
    while at and not block[at - 1].isspace():
        if block[at - 1] == ".":
            stops += 1
            if stops == 4:
                break
        at -= 1
    return at


# ---- the model ---------------------------------------------------------------------

#: Shapes of n-grams: full stops by the letters of the word (five or more: 4) and whether it holds a full stop itself, then figures, nothing, other marks, blanks, words without a mark, words of scripts without case.
FIGURE, BARE, OTHER_MARK, BLANK, WORD, CASELESS = range(10, 16)


def shape_of(context: str) -> int:
    if context[0] == "\u0e00":
        return BLANK
    if context[0] == "\u2423":
        return WORD
    if not context.endswith(".") or len(context) > 1 and context[0] in MARKS:
        return OTHER_MARK
    word = context[:-1]
    if not word:
        return BARE
    letter = next(filter(str.isalpha, word), "A")
    if letter.upper() == letter.lower():
        return CASELESS
    if word[0].isdigit() or word.endswith(" 0"):
        return FIGURE
    last = word.split()[-1]
    return min(sum(map(str.isalpha, last)) or 1, 5) * 2 - 2 + ("." in last)


@lru_cache(maxsize=200_000)
def context_code(context: str) -> int:
    """Shape and bucket of an n-gram in one number; a word without a mark has the bucket of the word."""
    shape = shape_of(context)
    return shape * BUCKETS + bucket(0, context[1:] if shape == WORD else context)


@lru_cache(maxsize=200_000)
def lowered(token: str) -> int:
    """Bucket of a token in lower case, if it begins with a capital; else -1."""
    low = token.lstrip(OPENERS).lower()
    return bucket(0, low) if token_class(token) == 0 else -1


@lru_cache(maxsize=200_000)
def last_word(context: str) -> int:
    """Bucket of the word of an n-gram `word.`"""
    return bucket(0, context[:-1])


def followed(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Buckets of n-grams with the class of the token after them."""
    mixed = (contexts % BUCKETS * 8 + classes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 18)).astype(np.int64)


@lru_cache(maxsize=200_000)
def token_code(token: str) -> int:
    """Class and bucket of a token in one number."""
    return token_class(token) * BUCKETS + bucket(0, token)


NEAR = 8 * BUCKETS  # added to a token's code: at most a word behind the gap before


class Digest:
    """Blocks and events of documents as flat lists, and the counts of a task."""

    def __init__(self) -> None:
        self.begins: Counter = Counter()
        self.inside: Counter = Counter()
        self.seen: Counter = Counter()
        self.ended: Counter = Counter()
        self.last: Counter = Counter()
        self.followed: Counter = Counter()
        self.clear()

    def clear(self) -> None:
        self.docs: list[int | None] = []
        self.lines: list[list[int]] = []  # start and end of each unit that is a line
        self.spans: list[list[int]] = []  # start and end of each block of prose
        self.gaps: list[list[int]] = []  # stop, begin, n-gram code, token code, bucket of the token in lower case of each event

    def add(self, doc: int | None, text: str, code: bool) -> None:
        lines: list[int] = []
        spans: list[int] = []
        found: list[int] = []
        contexts: list[int] = []
        pairs: list[int] = []
        for kind, start, end, block in blocks(text, code):
            if kind == "line":
                a, b = trimmed(text, start, end)
                if b > a:
                    lines += (a, b)
                continue
            body = block.lstrip()
            start += len(block) - len(body)
            body = body.rstrip()
            if not body:
                continue
            spans += (start, start + len(body))
            self.begins[token_at(body, 0)] += 1
            self.inside.update(body.split()[1:])
            maybe, last = [], -100
            for stop, begin, before, after in gaps(body):
                known = context_code(before)
                if not after:
                    contexts.append(known)
                    self.ended[known] += 1
                    break
                token = token_code(after)
                shape = known // BUCKETS
                if shape != WORD:
                    contexts.append(known)
                    pairs.append(known * 8 + token // BUCKETS)
                    if shape in (4, 6, 8):  # a word of three letters or more with a full stop
                        self.last[last_word(before)] += 1
                    if begin > stop:  # it may begin a sentence: not a token inside one for sure
                        maybe.append(SOLID.match(body, begin)[0])
                near = shape == WORD or (stop - last <= 12 and not any(map(str.isspace, body[last:stop])))
                found += (start + stop, start + begin, known, token + near * NEAR, lowered(after))
                last = begin
            self.inside.subtract(maybe)
        self.seen.update(contexts)
        self.followed.update(pairs)
        self.docs.append(doc)
        self.lines.append(lines)
        self.spans.append(spans)
        self.gaps.append(found)

    def counts(self) -> Counter:
        """Counts by array and bucket since the last call; sums of them count, whatever texts they are of."""
        out: Counter = Counter()
        for array, shapes, known in ((SEEN, SEEN_SHAPE, self.seen), (ENDED, ENDED_SHAPE, self.ended)):
            for code, n in known.items():
                out[array * BUCKETS + code % BUCKETS] += n
                out[SMALL * BUCKETS + shapes + code // BUCKETS] += n
        for at, n in self.last.items():
            out[LAST * BUCKETS + at] += n
        if self.followed:
            keys = np.fromiter(self.followed.keys(), np.int64, len(self.followed))
            small = keys // 8 // BUCKETS * 8 + keys % 8
            for at, shape, n in zip(followed(keys // 8, keys % 8).tolist(), small.tolist(), self.followed.values(), strict=True):
                out[FOLLOWED * BUCKETS + at] += n
                out[SMALL * BUCKETS + SHAPE_CLASS + shape] += n
        for array, classes, tokens in ((BEGINS, BEGIN_CLASS, self.begins), (INSIDE, INSIDE_CLASS, self.inside)):
            for token, n in tokens.items():
                if n:
                    code = token_code("0" if token[0].isdigit() else token_at(token, 0))
                    out[array * BUCKETS + code % BUCKETS] += n
                    out[SMALL * BUCKETS + classes + code // BUCKETS] += n
        for tokens in (self.seen, self.ended, self.begins, self.inside, self.last, self.followed):
            tokens.clear()
        return out


#: Log odds of two boundaries with at most one word between them, beside the sum of each: sentences of a word are rare.
SHORT = -0.5


#: How many sightings what is known of an n-gram's shape weighs, by itself and with the token after it; the share of unknown tokens; least and most chance of a boundary.
SHAPE_WEIGHT, CLASS_WEIGHT, UNKNOWN, LEAST, MOST = 6.0, 30.0, 0.002, 0.02, 0.9995


class Model:
    """What the counts say of boundaries; counts: ARRAYS x BUCKETS."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ARRAYS, BUCKETS).astype(np.float64)
        small = lambda k, n: c[SMALL][k : k + n]
        seen, ended = small(SEEN_SHAPE, 16), small(ENDED_SHAPE, 16)
        # Sentences per block, from question marks, which always end one, or from all marks, of which most do.
        asked = bucket(0, "?")
        per_block = max((c[SEEN][asked] + 8) / (c[ENDED][asked] + 2), 0.8 * (seen.sum() - seen[BLANK]) / (ended.sum() + 2))
        # Fewer block ends than a fifth of what sentence ends would have speak against one.
        self.ends = np.minimum(c[SEEN], 5 * c[ENDED] * per_block)
        self.seen, self.followed, self.inside = c[SEEN], c[FOLLOWED], c[INSIDE]
        self.shapes = (np.minimum(seen, 2 * ended * per_block) + 2.0) / (seen + 2.5)
        self.shapes[BLANK] = 0.999
        self.tokens = {k: c[k] / max(1.0, c[k].sum()) for k in (BEGINS, INSIDE, LAST)}
        self.classes = {k: (small(x, 7) + 1) / (small(x, 7).sum() + 7) for k, x in ((BEGINS, BEGIN_CLASS), (INSIDE, INSIDE_CLASS))}
        after = small(SHAPE_CLASS, 128).reshape(16, 8)[:, :7]
        self.after = (after + self.classes[BEGINS] * 2) / (after.sum(axis=1, keepdims=True) + 2)
        # Classes at a sentence's begin after words with and without case: letters of the other kind of script hardly come.
        begin = self.classes[BEGINS]
        letters = begin[[0, 1, 2, 5]].sum()
        cased, caseless = begin.copy(), begin.copy()
        cased[:3] *= letters / begin[:3].sum()
        caseless[5] = letters
        self.begin_after = np.stack([cased, caseless])
        # Boundaries per word, for words without marks between them.
        sentences = max(1.0, seen.sum() - seen[BLANK])
        self.per_word = min(0.2, max(0.02, sentences / max(1.0, c[INSIDE].sum() + sentences)))

    def odds(self, contexts: np.ndarray, tokens: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Log odds of a boundary at events, each by itself: n-gram before it, token after it."""
        shape, at = contexts // BUCKETS, contexts % BUCKETS
        cls, token = tokens // BUCKETS % 8, tokens % BUCKETS
        weight = np.where(shape == BLANK, 1000.0, SHAPE_WEIGHT)
        p = (self.ends[at] + self.shapes[shape] * weight) / (self.seen[at] + weight)
        # A word without a mark: how much more often it ends a sentence than it stands inside of one.
        last = (self.tokens[LAST][at] + 1e-6) / (self.tokens[INSIDE][at] + 1e-6)
        p = np.where(shape == WORD, self.per_word * last / (1 + self.per_word * last), p).clip(LEAST, MOST)
        begin, inside = self.classes[BEGINS][cls], self.classes[INSIDE][cls]
        token_begin, token_inside = self.tokens[BEGINS][token] + UNKNOWN * begin, self.tokens[INSIDE][token] + UNKNOWN * inside
        plain = np.log(p / (1 - p)) + np.log(token_begin / token_inside)
        # A word with a full stop: of the tokens of a class that follow it, how many do boundaries explain?
        sure = self.followed[followed(contexts, cls)]
        sure = np.maximum(0.0, sure - 2 * np.sqrt(sure))  # less two standard deviations
        known = (sure + CLASS_WEIGHT * self.after[shape, cls]) / (self.seen[at] + CLASS_WEIGHT)
        explained = p * self.begin_after[(shape == CASELESS).astype(int), cls]
        q = (explained / known).clip(LEAST, MOST)
        # A capital where the word mostly has none inside of sentences speaks for a boundary.
        small = np.where(low >= 0, self.inside[low], 0.0)
        capital = np.log((self.inside[token] + small + 1) / (self.inside[token] + 1))
        stopped = np.log(q / (1 - q)) + np.maximum(np.log(token_begin / token_inside * inside / begin), np.where(small > 0, capital, -np.inf))
        return np.where(np.isin(shape, (OTHER_MARK, BLANK, WORD)), plain, stopped)

    def boundaries(self, contexts: np.ndarray, tokens: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each event is a boundary, by the posteriors of the chains of events of blocks."""
        return posteriors(self.odds(contexts, tokens, low), tokens >= NEAR) >= 0


def posteriors(odds: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Posterior log odds of boundaries by forward-backward over chains of events.

    near: whether at most a word lies between an event and the one before; only
    then do the two depend on each other (`SHORT`), so chains begin where it is
    false.  The n-th events of all chains are taken together.
    """
    n = len(odds)
    if not n:
        return odds
    heads = np.flatnonzero(~near) if not near[0] else np.concatenate([[0], np.flatnonzero(~near)])
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    order = np.argsort(place, kind="stable")
    steps = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
    w, short = np.exp(np.clip(odds, -30, 30)), math.exp(SHORT)
    forward, backward = np.ones((n, 2)), np.ones((n, 2))
    forward[:, 1] = w
    for at in steps[1:]:
        no, yes = forward[at - 1, 0], forward[at - 1, 1]
        a, b = no + yes, (no + yes * short) * w[at]
        forward[at, 0], forward[at, 1] = a / (a + b), b / (a + b)
    for at in steps[:0:-1]:
        no, yes = backward[at, 0], backward[at, 1] * w[at]
        a, b = no + yes, no + yes * short
        backward[at - 1, 0], backward[at - 1, 1] = a / (a + b), b / (a + b)
    both = np.maximum(forward * backward, 1e-300)
    return np.log(both[:, 1] / both[:, 0])


# ---- on Spark ----------------------------------------------------------------------

DIGESTED = "doc_id long, lines array<int>, spans array<int>, gaps array<int>, bucket int, n long"


def digested(docs: DataFrame) -> DataFrame:
    """One row per text with its blocks and gaps, and rows of counts (bucket, n) of each task."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("lines", ints), ("spans", ints), ("gaps", ints), ("bucket", pa.int32()), ("n", pa.int64())])

    def counted(counts: Counter) -> pa.RecordBatch:
        k = len(counts)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), *(pa.nulls(k, ints) for _ in range(3)), pa.array(list(counts.keys()), pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digest()
        for batch in batches:
            for doc, text, kind in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "content_type")), strict=True):
                if text:
                    digest.add(doc, text, kind == "code")
            k = len(digest.docs)
            yield pa.RecordBatch.from_arrays([pa.array(digest.docs, pa.int64()), *(pa.array(x, ints) for x in (digest.lines, digest.spans, digest.gaps)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], schema=schema)
            digest.clear()
            if len(digest.inside) > 1_000_000:
                yield counted(digest.counts())
        yield counted(digest.counts())

    return docs.select("doc_id", "text", "content_type").mapInArrow(run, DIGESTED)


def fit_model(digest: DataFrame) -> np.ndarray:
    """The model's counts from all rows of counts; at most 7 x 262,144 sums reach the driver."""
    sums = digest.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ARRAYS * BUCKETS, np.int64)
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return counts


def batch_units(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """Sentence units of a batch of digests."""
    docs = batch.column("doc_id")
    where, starts, ends = [], [], []

    def flat(name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        sizes = np.diff(column.offsets.to_numpy()) // width
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), np.repeat(np.arange(len(sizes)), sizes)

    lines, owner = flat("lines", 2)
    where.append(owner)
    starts.append(lines[:, 0])
    ends.append(lines[:, 1])
    spans, owner = flat("spans", 2)
    gaps_, gap_owner = flat("gaps", 5)
    parts = model.boundaries(gaps_[:, 2], gaps_[:, 3], gaps_[:, 4])
    cut = gaps_[parts]
    own = np.concatenate([owner, gap_owner[parts]])
    first, last = np.concatenate([spans[:, 0], cut[:, 1]]), np.concatenate([spans[:, 1], cut[:, 0]])
    where.append(np.sort(own))
    starts.append(first[np.lexsort((first, own))])
    ends.append(last[np.lexsort((last, own))])
    taken = pa.array(np.concatenate(where))
    return pa.RecordBatch.from_arrays([docs.take(taken), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())], names=["doc_id", "char_start", "char_end"])


def sentence_units(docs: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """(doc_id, char_start, char_end) of all sentence units of rows (doc_id, text, content_type).

    The texts are read once: their blocks, gaps and counts are written, the
    model is summed from the counts, and the gaps are decided by it (or by the
    counts of another corpus, as `fit_model` gives them).  Null, empty and
    blank texts have no units; a null content_type counts as prose; repeated
    rows give their units each.  Other columns don't matter.
    """
    digest = written(digested(docs), "sentence-digests")
    shared = docs.sparkSession.sparkContext.broadcast(fit_model(digest) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            yield batch_units(batch, model)

    return digest.where("bucket is null").select("doc_id", "lines", "spans", "gaps").mapInArrow(run, "doc_id long, char_start int, char_end int")


def text_units(text: str, counts: np.ndarray, code: bool = False) -> list[tuple[int, int]]:
    """The units of one text, for use outside of Spark."""
    digest = Digest()
    digest.add(0, text, code)
    ints = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(digest.docs, pa.int64()), *(pa.array(x, ints) for x in (digest.lines, digest.spans, digest.gaps))], names=["doc_id", "lines", "spans", "gaps"])
    out = batch_units(batch, Model(counts))
    return sorted(zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True))
