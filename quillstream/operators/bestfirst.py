"""The best hits of very many queries over a corpus, without a score for every pair of query and text.

What `textindex.class_ranks(textindex.bm25_scores(...))` gives, for queries whose
number grows with the corpus.  Texts become rows of their queries' terms, written
once.  Each task reads its texts in blocks, looks for every query in each block
and hands on only the best per query and class: what is shuffled grows with the
queries and the tasks, not with the pairs.

A block's postings lie in layers by their share of the score.  A query goes
through the layers of its terms from the highest on, until the rest can't lift
an unseen text to the best ones so far (MaxScore); only texts that may still get
there are looked up in the rest.  Texts with all terms, which rank before all
others, are found by intersection.  No text is left out that could be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.textindex import B, K1, LIMIT, WEIGHTS, tokens
from quillstream.sources.tables import written

#: Texts of a task's first block (it gives a first bound) and of the others (a worker holds one: about 100 terms of 60 bytes a text); queries of one pass; layers of a term.
FIRST_BLOCK, BLOCK, SLICE, LAYERS = 16_384, 49_152, 100_000, 2
#: Scores are rounded to six digits: what is nearer than this to the bound is looked at.
NEAR = 2e-6
#: Added to the score of a text with all terms, far above any score.
ALL = 2.0**20
#: Stands for a missing id, which comes first.
NO_ID = -(2**63)

ROWS = "id long, cls string, dl_title int, dl_content int, terms array<int>, title array<int>, content array<int>"


def term_rows(docs: DataFrame, names) -> DataFrame:
    """One row per text: its length and, of the asked terms (a broadcast array; a term's code is its place) it holds, codes and counts by field."""
    kept = docs.select("id", "cls", *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f) for f in WEIGHTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = names.value
        width = max(len(asked), 1)
        for b in batches:
            sizes, found = [], []
            for f in WEIGHTS:
                column = b.column(f)
                size = np.diff(column.offsets.to_numpy())
                coded = column.flatten().dictionary_encode()
                places = pc.fill_null(pc.index_in(coded.dictionary, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = places[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64)
                keys = (np.repeat(np.arange(b.num_rows), size) * width + terms)[terms >= 0]
                sizes.append(size)
                found.append(np.unique(keys, return_counts=True))
            every = np.union1d(found[0][0], found[1][0])
            ends = np.concatenate([[0], np.cumsum(np.bincount(every // width, minlength=b.num_rows))]).astype(np.int32)
            counts = []
            for keys, n in found:
                tf = np.zeros(len(every), np.int32)
                tf[np.searchsorted(every, keys)] = n
                counts.append(tf)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in ((every % width).astype(np.int32), *counts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cls"), *(pa.array(k.astype(np.int32)) for k in sizes), *lists], names=["id", "cls", "dl_title", "dl_content", "terms", "title", "content"])

    return kept.mapInArrow(run, ROWS)


def frequencies(rows: DataFrame, n_terms: int) -> DataFrame:
    """(cls, code, df_title, df_content): in how many texts of a class each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            classes = b.column("cls").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), np.diff(b.column("terms").offsets.to_numpy()))
            codes, tfs = b.column("terms").flatten().to_numpy(), [b.column(f).flatten().to_numpy() for f in WEIGHTS]
            for c in set(classes):
                own = (classes == c)[owner]
                total = sums.setdefault(c, [np.zeros(n_terms, np.int64) for _ in WEIGHTS])
                for n, tf in zip(total, tfs, strict=True):
                    n += np.bincount(codes[own & (tf > 0)], minlength=n_terms)
        for c, total in sums.items():
            code = np.flatnonzero(sum(total))
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(code), pa.string()), pa.array(code), *(pa.array(n[code]) for n in total)], names=["cls", "code", *(f"df_{f}" for f in WEIGHTS)])

    parts = rows.select("cls", "terms", *WEIGHTS).mapInArrow(run, "cls string, code long, df_title long, df_content long")
    return parts.groupBy("cls", "code").agg(*[F.sum(f"df_{f}").alias(f"df_{f}") for f in WEIGHTS])


class Postings:
    """Postings of the texts of one class in a block, ordered by term and text, and by term and layer."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, codes: np.ndarray, parts: np.ndarray, n_terms: int):
        self.ids, self.n = ids, len(ids)
        order = np.argsort(codes, kind="stable")  # texts go up within a term, as they do in the rows
        codes = codes[order]
        self.docs, self.parts = owner[order].astype(np.int32), parts[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_terms))])
        self.sums = np.zeros(self.n)
        top = np.zeros(n_terms)
        if len(codes):
            held = np.flatnonzero(np.diff(self.starts))
            top[held] = np.maximum.reduceat(self.parts, self.starts[held])
            # Each layer ends at half of the one above it.
            layer = np.minimum(-np.log2(np.maximum(self.parts / top[codes], 1e-9)), LAYERS - 1).astype(np.int32)
            key = codes * LAYERS + layer
            self.layer_starts = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n_terms * LAYERS))])
            by = np.argsort(key, kind="stable")
            del layer, key, codes, order  # a block's arrays are most of a worker's memory
            self.layer_docs, self.layer_parts = self.docs[by], self.parts[by]
            self.tops = np.zeros(n_terms * LAYERS)
            held = np.flatnonzero(np.diff(self.layer_starts))
            self.tops[held] = np.maximum.reduceat(self.layer_parts, self.layer_starts[held])
            self.tops = self.tops.reshape(n_terms, LAYERS)
            # What a term adds at most when its layers above are done.
            self.below = np.maximum.accumulate(self.tops[:, ::-1], axis=1)[:, ::-1]

    def at(self, code: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the texts hold a term that the block holds, and its places in `parts`."""
        a, z = self.starts[code], self.starts[code + 1]
        place = self.docs[a:z].searchsorted(docs)
        place += a
        np.minimum(place, z - 1, out=place)
        return self.docs[place] == docs, place

    def search(self, terms: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """best: keys (scores, raised by ALL for texts with all terms) and ids of the best texts so far; returned with those of the block."""
        length = self.starts[terms + 1] - self.starts[terms]
        if not length.any():
            return best
        held = terms[length > 0]
        below = self.below[held]
        rest = below[:, 0].sum()
        bound = best[0][-1] - NEAR if best is not None and len(best[0]) == most else -np.inf
        whole = None
        if len(held) == len(terms) and rest + ALL >= bound:
            by = terms[length.argsort()]
            a, z = self.starts[by[0]], self.starts[by[0] + 1]
            whole, total = self.docs[a:z], self.parts[a:z]
            for t in by[1:]:
                there, place = self.at(t, whole)
                whole, total = whole[there], total[there] + self.parts[place[there]]
                if not len(whole):
                    break
            if len(whole):
                best = _joined(best, _rounded(total) + ALL, self.ids[whole], most)
                bound = best[0][-1] - NEAR if len(best[0]) == most else -np.inf
        if bound >= ALL / 2 or rest < bound:
            return best
        tops = self.tops[held].ravel()
        order = (-tops).argsort(kind="stable")[: np.count_nonzero(tops)]
        places = (held[:, None] * LAYERS + np.arange(LAYERS)).ravel()[order]
        begins, ends = self.layer_starts[places].tolist(), self.layer_starts[places + 1].tolist()
        # By term what its layers from each on, and at last none, add at most; the first layer that isn't done.
        most_left, left = [[*x, 0.0] for x in below.tolist()], [0] * len(held)
        sums = self.sums
        for k, a, z in zip(order.tolist(), begins, ends, strict=True):
            if rest < bound:
                break
            i, layer = divmod(k, LAYERS)
            sums[self.layer_docs[a:z]] += self.layer_parts[a:z]
            rest += most_left[i][layer + 1] - most_left[i][left[i]]
            left[i] = layer + 1
        if bound == -np.inf and self.n > most:
            bound = np.partition(sums, self.n - most)[self.n - most] - NEAR
        found = (sums >= max(bound - rest, 1e-12)).nonzero()[0]
        total = sums[found]
        if len(found):
            # The terms with layers left, those that add most first: a text goes as soon as they can't lift it.
            for more, i in sorted(((most_left[i][k], i) for i, k in enumerate(left) if most_left[i][k]), reverse=True):
                there, place = self.at(held[i], found)
                part = self.parts[place]
                there &= part <= more  # what is larger lies in a layer that is done
                total[there] += part[there]
                rest -= more
                keep = total >= bound - max(rest, 0.0)
                found, total = found[keep], total[keep]
        sums.fill(0.0)
        if whole is not None and len(whole) and len(found):
            fresh = ~np.isin(found, whole)
            found, total = found[fresh], total[fresh]
        return _joined(best, _rounded(total), self.ids[found], most) if len(found) else best


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _joined(best: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if best is not None:
        keys, ids = np.concatenate([best[0], keys]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -keys))[:most]
    return keys[order], ids[order]


class Corpus:
    """What holds for the whole corpus: by class the number of texts, mean lengths and, by term, idf in each field."""

    def __init__(self, stats: list, df: pa.Table, n_terms: int):
        self.n_terms, self.of = n_terms, {}
        classes = df["cls"].to_numpy(zero_copy_only=False)
        for r in stats:
            own = classes == r.cls
            code, idfs = df["code"].to_numpy()[own], []
            for f in WEIGHTS:
                n = np.zeros(n_terms)
                n[code] = df[f"df_{f}"].to_numpy()[own]
                idfs.append(np.log(1 + (r.n_docs - n + 0.5) / (n + 0.5)))
            self.of[r.cls] = (idfs, [r[f"mean_{f}"] for f in WEIGHTS])

    def postings(self, rows: pa.Table) -> dict[str, Postings]:
        """Postings of a block by class."""
        out = {}
        classes = rows["cls"].to_numpy()
        for c, (idfs, means) in self.of.items():
            own = rows.filter(pa.array(classes == c)).combine_chunks()
            if not own.num_rows:
                continue
            lists = [own[f].combine_chunks() for f in ("terms", *WEIGHTS)]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            owner = np.repeat(np.arange(own.num_rows), np.diff(lists[0].offsets.to_numpy()))
            codes = lists[0].flatten().to_numpy()
            parts = np.zeros(len(codes))
            for (f, weight), tf, idf, mean in zip(WEIGHTS.items(), lists[1:], idfs, means, strict=True):
                tf, dl = tf.flatten().to_numpy().astype(float), own[f"dl_{f}"].to_numpy()
                norm = K1 * (1 - B + B * (dl / mean if mean else np.zeros(len(dl))))
                parts += np.where(tf > 0, weight * idf[codes] * tf * (K1 + 1) / (tf + norm[owner]), 0.0)
            out[c] = Postings(pc.fill_null(own["id"], NO_ID).to_numpy(), owner, codes, parts, self.n_terms)
        return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to a small first block and to large ones."""
    held, n, most = [], 0, FIRST_BLOCK
    for b in batches:
        while b.num_rows:
            head, b = b.slice(0, most - n), b.slice(min(most - n, b.num_rows))
            held.append(head)
            n += head.num_rows
            if n == most:
                yield pa.Table.from_batches(held)
                held, n, most = [], 0, BLOCK
    if held:
        yield pa.Table.from_batches(held)


def best_hits(docs: DataFrame, queries: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Hits (set, cls, id, score, matches_all), among them the best 2 * limit of each set of terms and class, and the sets of the queries (query_id, set).

    docs: a corpus with one row per id.  queries: rows (query_id, term).  Queries
    with the same terms have one set; BM25 is that of `textindex.bm25_scores`.
    """
    spark = docs.sparkSession
    asked = written(queries.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "asked")
    sets = written(asked.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "term-sets")
    members = asked.join(sets, "terms").select("query_id", "set")
    known = sets.toArrow().combine_chunks()  # a few numbers per query
    lists = known["terms"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    numbers, ends, codes, n_terms = known["set"].to_numpy(), lists.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    names = spark.sparkContext.broadcast(coded.dictionary)
    rows = written(term_rows(docs, names), "term-rows")
    stats = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg(f"dl_{f}").alias(f"mean_{f}") for f in WEIGHTS]).collect()  # one row per class
    whole = spark.sparkContext.broadcast(Corpus(stats, frequencies(rows, n_terms).toArrow(), n_terms))
    few = rows.coalesce(spark.sparkContext.defaultParallelism)  # each task hands on its best hits of every query
    found = None
    for k in range(0, max(len(numbers), 1), SLICE):
        z = min(k + SLICE, len(numbers))
        own = spark.sparkContext.broadcast((numbers[k:z], ends[k : z + 1], codes[ends[k] : ends[z]]))
        part = few.mapInArrow(_searching(whole, own, 2 * limit), "set long, cls string, id long, score double, matches_all boolean")
        found = part if found is None else found.unionByName(part)
    return found, members


def _searching(whole, own, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ends, codes = own.value
        best: dict[str, list] = {}
        for block in blocks(batches):
            for c, postings in whole.value.postings(block).items():
                kept = best.setdefault(c, [None] * len(numbers))
                for q in range(len(numbers)):
                    terms = codes[ends[q] - ends[0] : ends[q + 1] - ends[0]]
                    kept[q] = postings.search(terms, kept[q], most)
        for c, kept in best.items():
            held = [q for q, x in enumerate(kept) if x is not None]
            for k in range(0, len(held), 10_000):
                some = held[k : k + 10_000]
                keys, ids = (np.concatenate([kept[q][j] for q in some]) for j in (0, 1))
                sets = np.repeat(numbers[some], [len(kept[q][0]) for q in some])
                full = keys >= ALL / 2
                yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array([c] * len(sets), pa.string()), pa.array(ids, mask=ids == NO_ID), pa.array(np.where(full, _rounded(keys - ALL), keys)), pa.array(full)], names=["set", "cls", "id", "score", "matches_all"])

    return run
