"""Evaluation passages inside a training corpus, by size-partitioned MinHash containment.

Items are partitioned by their size, and each partition has its own window, the
longest that any leaked passage of such an item must hold unchanged: 16 words
(12 shingles of five words) for items too short for a passage with a replaced
word, 11 words (7 shingles; the larger side of 22 with one replaced) for longer
ones, and 30 characters (21 shingles of ten) for scripts without blanks.
Containment of an item's window in a document is what is searched: for each
partition that has items the document is covered by windows of its size.  The
signature of a window are its MinHashes under three hash functions, which make
one band: a contained window equals one of the document's, so that its
signature is found for sure, and windows that share only some of their shingles
hardly agree in all three.

Signatures of items and documents are tables that are joined: the documents are
read once, whatever the number of items, and no item passes the driver.  Pairs
with a common signature meet their texts again and are decided exactly: the
shingles of a passage must be contained in the document one after the other, or
those around one replaced word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.textindex import small
from quillstream.sources.tables import written

WORD = re.compile(r"[^\W_]+")
HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
NO_BLANKS = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿]")
NEVER = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Partition:
    """One size class of windows, with the lengths of a case: `run` units unchanged, or `near` with one replaced."""

    shingle: int
    window: int
    run: int
    near: int  # 0: a replaced unit is no case
    number: int

    @property
    def units(self) -> int:
        return self.shingle + self.window - 1


SHORT = Partition(shingle=5, window=12, run=16, near=0, number=0)  # items of 16 to 21 words
WORDS = Partition(shingle=5, window=7, run=16, near=22, number=1)
CHARACTERS = Partition(shingle=10, window=21, run=30, near=0, number=2)
PARTITIONS = (SHORT, WORDS, CHARACTERS)
#: Odd factors of the hash functions of a signature beside the first.
FUNCTIONS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def normalised(text: str) -> str:
    return (text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).casefold()


def words(text: str) -> list[str]:
    return WORD.findall(normalised(text))


def characters(text: str) -> list[str]:
    return list("".join(words(text)))


def word_hashes(units: list[str]) -> np.ndarray:
    """64-bit hashes of units, the same in every process; never 0."""
    coded = pa.array(units, pa.string()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(u) | 1 for u in coded.dictionary.to_pylist()], np.uint64)
    return hashes[coded.indices.to_numpy()]


def shingle_hashes(ids: np.ndarray, shingle: int) -> np.ndarray:
    """64-bit hashes of the shingles of a row of unit hashes; NEVER where a shingle has a unit 0."""
    n = len(ids) - shingle + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for k in range(shingle):
        part = ids[k : k + n]
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part != 0
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == NEVER] = 0
    h[~known] = NEVER
    return h


def signatures(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all windows that have no NEVER, and where they begin: their smallest hashes under three functions, in one number."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(hashes == NEVER)])
    whole = np.flatnonzero(gaps[window:] == gaps[:-window])
    value = np.zeros(n, np.uint64)
    for factor in (None, *FUNCTIONS):
        h = hashes if factor is None else (hashes * factor) ^ ((hashes * factor) >> np.uint64(31))
        low = h[:n].copy()
        for k in range(1, window):
            np.minimum(low, h[k : k + n], out=low)
        value = (value * np.uint64(0x9E3779B97F4A7C15)) ^ low
    return value[whole], whole


def signature_set(units: list[str], part: Partition) -> np.ndarray:
    """The signatures of all windows of a text, each once."""
    return np.unique(signatures(shingle_hashes(word_hashes(units), part.shingle), part.window)[0])


def partition_of(text: str) -> tuple[Partition, list[str]] | None:
    """The partition of an item's text and its units; None if it is shorter than a passage."""
    letters = sum(map(str.isalpha, text))
    if letters and 2 * len(NO_BLANKS.findall(text)) > letters:
        part, units = CHARACTERS, characters(text)
    else:
        units = words(text)
        part = WORDS if len(units) >= WORDS.near else SHORT
    return (part, units) if len(units) >= part.run else None


class Units:
    """The units of a text with their hashes, and the sorted hashes of its runs of n units."""

    def __init__(self, units: list[str]):
        self.units = units
        self.hashes = word_hashes(units)
        self._runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self._runs:
            h = shingle_hashes(self.hashes, n)
            order = np.argsort(h, kind="stable")
            self._runs[n] = h[order], order
        return self._runs[n]


def contained(doc: Units, item: Units, part: Partition) -> bool:
    """Whether a document holds a passage of an item: all its shingles one after the other, or those around one replaced word."""
    values, order = doc.runs(part.units)
    own, places = item.runs(part.units)
    left, right = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    tried: set[int] = set()
    for k in np.flatnonzero(right > left).tolist():
        for offset in (order[left[k] : right[k]] - places[k]).tolist():
            if offset not in tried:
                tried.add(offset)
                if _along(doc, item, offset, part):
                    return True
    return False


def _along(doc: Units, item: Units, offset: int, part: Partition) -> bool:
    """Whether a passage lies where item place p is document place p + offset: by hashes, and where they say so by the units."""
    first, end = max(0, -offset), min(len(item.units), len(doc.units) - offset)
    if end - first < part.run:
        return False
    if not _passage(doc.hashes[first + offset : end + offset] == item.hashes[first:end], part):
        return False
    return _passage(np.array([a == b for a, b in zip(doc.units[first + offset : end + offset], item.units[first:end], strict=True)]), part)


def _passage(same: np.ndarray, part: Partition) -> bool:
    """Whether units that are the same at their places hold all shingles of a passage, or those around one replaced word."""
    wrong = np.concatenate([[0], np.cumsum(~same)])
    held = np.concatenate([[0], np.cumsum(wrong[part.shingle :] == wrong[: -part.shingle])])  # shingles that are contained
    n = part.run - part.shingle + 1
    if (held[n:] - held[:-n] == n).any():
        return True
    if not part.near or len(same) < part.near:
        return False
    n = part.near - part.shingle + 1  # one replaced word takes at most `shingle` of a passage's shingles
    return bool(((held[n:] - held[:-n] >= n - part.shingle) & (wrong[part.near :] - wrong[: -part.near] <= 1)).any())


@lru_cache(maxsize=4_096)
def passage_of(text: str) -> tuple[Partition, Units] | None:
    found = partition_of(text)
    return found and (found[0], Units(found[1]))


# ---- on Spark ----------------------------------------------------------------------


def item_signatures(items: DataFrame) -> DataFrame:
    """(item_id, part, signature): the signatures of each item in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, found = [], [], [np.empty(0, np.int64)]
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if own := partition_of(text):
                    s = signature_set(own[1], own[0]).view(np.int64)
                    ids += [item] * len(s)
                    parts += [own[0].number] * len(s)
                    found.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(np.concatenate(found))], names=["item_id", "part", "signature"])

    return items.select("item_id", "text").where("text is not null").mapInArrow(run, "item_id long, part int, signature long")


def document_signatures(docs: DataFrame, parts: list[int], batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, part, signature): the signatures of each document's windows in the given partitions, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in sliced(b, batch_chars):
                for cut, kinds in ((words, (SHORT, WORDS)), (characters, (CHARACTERS,))):
                    wanted = [k for k in kinds if k.number in parts]
                    if not wanted:
                        continue
                    chosen = [(d, cut(t)) for d, t in zip(ids, texts, strict=True) if cut is not characters or NO_BLANKS.search(t)]
                    # All documents of a slice at once, with a unit 0 between them that no window may hold.
                    flat = word_hashes([u for _, units in chosen for u in units])
                    lengths = np.array([len(units) for _, units in chosen], np.int64)
                    joined = np.zeros(len(flat) + len(lengths), np.uint64)
                    joined[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
                    h = shingle_hashes(joined, wanted[0].shingle)
                    owners = pa.array([d for d, _ in chosen], pa.int64())
                    for part in wanted:
                        value, at = signatures(h, part.window)
                        new = np.ones(len(value), bool)
                        new[1:] = (value[1:] != value[:-1]) | (np.diff(at) > 1)  # windows in a row mostly share theirs
                        of = np.searchsorted(np.cumsum(lengths + 1), at[new], "right")
                        yield pa.RecordBatch.from_arrays([owners.take(pa.array(of)), pa.array(np.full(len(of), part.number, np.int32)), pa.array(value[new].view(np.int64))], names=["doc_id", "part", "signature"])

    return docs.select("doc_id", "text").where("length(trim(text)) > 0").mapInArrow(run, "doc_id long, part int, signature long")


def sliced(b: pa.RecordBatch, most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in slices of at most most_chars characters (or one text)."""
    ids, texts, size = [], [], 0
    for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
        if texts and size + len(t) > most_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(d)
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, texts


def candidate_pairs(docs: DataFrame, items: DataFrame, batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) with a signature in common, each pair once."""
    own = written(item_signatures(items).distinct(), "item-signatures")
    parts = [r["part"] for r in own.select("part").distinct().collect()]  # three at most
    return document_signatures(docs, parts, batch_chars).join(small(own), ["part", "signature"]).select("doc_id", "item_id").distinct()


def leaked_pairs(docs: DataFrame, items: DataFrame, batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of all documents that hold a passage of an item, each pair once.

    Null and blank texts and items shorter than a passage have no cases.
    Repeated documents and items count once by id; a null doc_id comes out as
    null.  Other columns don't matter.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts = None, {}
        for b in batches:
            found = []
            for doc, item, text, passage in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "passage")), strict=True):
                part, own = passage_of(passage) or (None, None)
                if part is None:
                    continue
                if text != last:
                    last, texts = text, {}
                cut = characters if part == CHARACTERS else words
                if cut not in texts:
                    texts[cut] = Units(cut(text))
                if contained(texts[cut], own, part):
                    found.append((doc, item))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

    pairs = written(candidate_pairs(docs, items, batch_chars), "leak-candidates")
    texts = docs.select(F.col("doc_id").alias("__doc"), "text").where("length(trim(text)) > 0")
    passages = items.select("item_id", F.col("text").alias("passage")).where("passage is not null")
    met = texts.join(small(pairs), F.col("__doc").eqNullSafe(F.col("doc_id"))).join(small(passages), "item_id").select("doc_id", "item_id", "text", "passage")
    return met.mapInArrow(decide, "doc_id long, item_id long").distinct()


def leaked_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that leak it; those without are kept with 0."""
    counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "suite", "is_required").join(counts, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
