"""Vocabulary, ranked search and its fallback over a corpus of titled texts.

A corpus has the columns (id, cls, title, content); cls is the token class
(`prose` or `code`).  Queries are rows (query_id, term): a bounded set that is
sent to the executors behind a check of its size, so that the corpus is
scanned where it lies and only postings of query terms are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.stem import STOP_WORDS, stem
from quillstream.sources.tables import written

#: Weights of the fields, BM25's parameters, the fusion constant, limits.
WEIGHTS = {"title": 2.0, "content": 1.0}
K1, B, FUSION, LIMIT, DISTINCTIVE, SIMILAR, MOST_TERMS, LEAST_TERM = 1.2, 0.75, 60, 5, 40, 0.5, 8, 3
#: Relevance bands by (layer, all terms matched).
BANDS = {("primary", True): (0.85, 1.0), ("primary", False): (0.6, 0.8), ("trigram", False): (0.1, 0.5)}
# Words without weight for the fallback.
FALLBACK_STOP_WORDS = "the an of and or in on at to for with is are was were be been do did does done by as from into than what where when why how who which that this it its".split()
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(word: str) -> Column:
    return F.pandas_udf(_stems, "string")(word)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def corpus(docs: DataFrame) -> DataFrame:
    """documents as a corpus: the first line, at most 60 characters, is the title."""
    title = F.substring(F.regexp_replace(F.split("text", "\n", 2)[0], r"^\s+|\s+$", ""), 1, 60)
    cls = F.when(F.col("content_type") == "code", "code").otherwise("prose")
    return docs.where("text is not null").select(F.col("doc_id").alias("id"), cls.alias("cls"), F.coalesce(title, F.lit("")).alias("title"), F.col("text").alias("content"), "source")


def vocabulary(texts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, word, doc_freq): in how many texts of a group a word stands; blank texts have none."""
    words = texts.select(group, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    return words.groupBy(group, "word").agg(F.count(F.lit(1)).alias("doc_freq"))


def prose_vocabulary(texts: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """As `vocabulary`, over stems without stop words, of texts with a key; each distinct word is stemmed once, not each token."""
    words = texts.select(group, key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    stems = words.select("word").distinct().withColumn("lexeme", stemmed("word"))
    pairs = words.join(stems, "word").select(group, key, "lexeme").distinct()
    return pairs.groupBy(group, F.col("lexeme").alias("word")).agg(F.count(F.lit(1)).alias("doc_freq"))


def distinctive(vocab: DataFrame, group: str, n: int = DISTINCTIVE) -> DataFrame:
    """The n rarest words of each group, ties by word."""
    order = Window.partitionBy(group).orderBy("doc_freq", "word")
    return vocab.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def vocabulary_delta(old: DataFrame, new: DataFrame, group: str, text: str) -> DataFrame:
    """Changes of the vocabulary when texts are replaced: signed counts, without those that cancel out."""
    minus = vocabulary(old, group, text).withColumn("doc_freq", -F.col("doc_freq"))
    both = vocabulary(new, group, text).unionByName(minus)
    return both.groupBy(group, "word").agg(F.sum("doc_freq").alias("delta")).where("delta <> 0")


def maintained(vocab: DataFrame, delta: DataFrame, group: str) -> DataFrame:
    """A vocabulary (group, word, doc_freq) with the changes (group, word, delta) applied; words without texts are pruned."""
    both = vocab.unionByName(delta.withColumnRenamed("delta", "doc_freq"))
    return both.groupBy(group, "word").agg(F.sum("doc_freq").alias("doc_freq")).where("doc_freq > 0")


def in_sources(docs: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Texts of the given sources; all if None."""
    return docs if sources is None else docs.join(small(sources.select("source").distinct()), "source", "left_semi")


def query_terms(queries: DataFrame, text: str, least: int = 1) -> DataFrame:
    """(query_id, term) of rows (query_id, text): all distinct tokens (of at least `least` letters)."""
    return queries.select("query_id", F.explode(F.array_distinct(F.filter(tokens(F.col(text)), lambda t: F.length(t) >= least))).alias("term"))


def class_words(text: Column) -> Column:
    """Tokens that count in a text's class: of prose those that are no stop words, of code all."""
    words = tokens(text)
    return F.when(F.col("cls") == "prose", F.filter(words, lambda t: ~t.isin(*STOP_WORDS))).otherwise(words)


def class_terms(terms: DataFrame) -> DataFrame:
    """(query_id, cls, term) of (query_id, term): for prose stems without stop words, for code the terms as they are."""
    prose = terms.where(~F.col("term").isin(*STOP_WORDS)).select("query_id", F.lit("prose").alias("cls"), stemmed("term").alias("term"))
    return prose.unionByName(terms.select("query_id", F.lit("code").alias("cls"), "term")).distinct()


POSTINGS = "id long, cls string, term string, title int, content int, dl_title int, dl_content int"


def doc_terms(docs: DataFrame, stems: bool = False) -> DataFrame:
    """(id, cls, term, title, content, dl_title, dl_content): how often each term stands in the fields of a text, and the fields' lengths.

    A text lies in one row, so its terms are counted where it lies; each text
    also has a row without a term.  stems: terms of prose are stems of words that
    are no stop words.
    """
    kept = docs.select("id", "cls", *[F.coalesce(class_words(F.col(f)) if stems else tokens(F.col(f)), F.array().cast("array<string>")).alias(f) for f in WEIGHTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            fields = [b.column(f) for f in WEIGHTS]
            sizes = [np.diff(f.offsets.to_numpy()) for f in fields]
            rows = [np.repeat(np.arange(n), k) for k in sizes]
            coded = pa.concat_arrays([f.flatten() for f in fields]).dictionary_encode()
            names = coded.dictionary.to_pylist()
            as_is = np.arange(len(names))
            if stems:
                vocabulary = {w: k for k, w in enumerate(names)}
                stemmed_ = np.array([vocabulary.setdefault(stem(w), len(vocabulary)) for w in names], np.int64)
                names = list(vocabulary)
                prose = np.array([c == "prose" for c in b.column("cls").to_pylist()], bool)
            codes = np.split(coded.indices.to_numpy().astype(np.int64), [len(rows[0])])
            width = len(names) + 1  # the last code: no term
            keys, counts = [], []
            for row, code in zip(rows, codes, strict=True):
                term = np.where(prose[row], stemmed_[code], as_is[code]) if stems and len(code) else code
                k, c = np.unique(row * width + term, return_counts=True)
                keys.append(k)
                counts.append(c)
            every = np.unique(np.concatenate([*keys, np.arange(n) * width + width - 1]))
            tf = [np.zeros(len(every), np.int32) for _ in fields]
            for t, k, c in zip(tf, keys, counts, strict=True):
                t[np.searchsorted(every, k)] = c
            owner = pa.array(every // width)
            terms = pa.array([*names, None], pa.string()).take(pa.array(every % width))
            lengths = [pa.array(k.astype(np.int32)).take(owner) for k in sizes]
            yield pa.RecordBatch.from_arrays([b.column("id").take(owner), b.column("cls").take(owner), terms, *(pa.array(t) for t in tf), *lengths], names=["id", "cls", "term", "title", "content", "dl_title", "dl_content"])

    return kept.mapInArrow(run, POSTINGS)


def bm25_scores(docs: DataFrame, queries: DataFrame, stems: bool = False) -> DataFrame:
    """(query_id, cls, id, score, matches_all): BM25 over title and content with statistics of each class and field.

    stems: prose is searched by stems without stop words, as its queries are; else both classes by their tokens.
    """
    terms = queries.select("query_id", "term").distinct()
    terms, on = (class_terms(terms), ["cls", "term"]) if stems else (terms, ["term"])
    asked = small(terms.select(*on).distinct().withColumn("__asked", F.lit(True)))
    # Used three times; the texts are read and cut once for it.
    found = written(doc_terms(docs, stems).join(asked, on, "left").where("__asked or term is null").drop("__asked").select("id", "cls", "term", *WEIGHTS, "dl_title", "dl_content"), "postings")
    stats = found.where("term is null").groupBy("cls").agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg(f"dl_{f}").alias(f"mean_{f}") for f in WEIGHTS])
    found = found.where("term is not null")
    df = found.groupBy("cls", "term").agg(*[F.sum((F.col(f) > 0).cast("int")).alias(f"df_{f}") for f in WEIGHTS]).join(F.broadcast(stats), "cls")  # stats: one row per class
    part = F.lit(0.0)
    for f, weight in WEIGHTS.items():
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df_{f}") + 0.5) / (F.col(f"df_{f}") + 0.5))
        norm = F.col(f) + K1 * (1 - B + B * F.coalesce(F.try_divide(F.col(f"dl_{f}"), F.col(f"mean_{f}")), F.lit(0.0)))
        part = part + F.when(F.col(f) > 0, weight * idf * F.col(f) * (K1 + 1) / norm).otherwise(0.0)
    by_term = found.join(small(df), ["cls", "term"]).select("cls", "id", "term", part.alias("part")).repartition("cls", "id")
    # By text from here on: what queries of many terms share with a text is summed where it lies.
    per_query = ["query_id", *on[:-1]]
    counts = terms.groupBy(*per_query).agg(F.count(F.lit(1)).alias("n_terms"))
    wanted = small(terms.join(counts, per_query))
    return (
        by_term.join(wanted, on).groupBy("query_id", "cls", "id", "n_terms")
        .agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("hit"))
        .select("query_id", "cls", "id", "score", (F.col("hit") == F.col("n_terms")).alias("matches_all"))
    )


def class_ranks(scores: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best 2 * limit of each query and class: all terms before some, then score, then id."""
    order = Window.partitionBy("query_id", "cls").orderBy(F.col("matches_all").desc(), F.col("score").desc(), "id")
    return scores.withColumn("class_rank", F.row_number().over(order)).where(F.col("class_rank") <= 2 * limit)


def fused(ranked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Reciprocal rank fusion of the classes: all terms before some, then 1 / (60 + rank), then id."""
    order = Window.partitionBy("query_id").orderBy(F.col("matches_all").desc(), (1 / (FUSION + F.col("class_rank"))).desc(), "id")
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


# ---- the fallback ------------------------------------------------------------------


def trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def fallback_terms(queries: DataFrame, text: str) -> DataFrame:
    """(query_id, term) for the fallback: at least three bytes, no stop words, each once, the first eight."""
    kept = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: (F.octet_length(t) >= LEAST_TERM) & ~t.isin(FALLBACK_STOP_WORDS))
    return queries.select("query_id", F.explode(F.slice(F.array_distinct(kept), 1, MOST_TERMS)).alias("term"))


def _rare_first(grams: Column, least: float) -> Column:
    """As many of a word's trigrams, in one order for all words with those of word beginnings last, as two words with that similarity can't both do without."""
    ordered = F.array_sort(F.transform(grams, lambda g: F.struct(g.startswith("  ").alias("begins"), F.xxhash64(g).alias("hash"), g.alias("gram"))))
    return F.transform(F.slice(ordered, 1, F.size(grams) - F.ceil(F.size(grams) * F.lit(least)).cast("int") + 1), lambda x: x["gram"])


def similar_words(words: DataFrame, terms: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(term, word, similarity) of all words that share at least `least` of their trigrams with a term.

    Each distinct word meets only the terms of fitting length with which it
    shares one of the trigrams that such a pair must share (a prefix filter);
    what they share is then counted.
    """
    of_words = F.array_distinct(F.flatten(F.transform(tokens(F.col("term")), trigrams)))  # a term may hold marks
    wanted = terms.select("term").distinct().withColumn("term_grams", of_words).where(F.size("term_grams") > 0)
    wanted = small(wanted.select("term", "term_grams", F.explode(_rare_first(F.col("term_grams"), least)).alias("gram")))
    own = words.select("word").distinct().withColumn("grams", trigrams(F.col("word")))
    met = own.select("word", "grams", F.explode(_rare_first(F.col("grams"), least)).alias("gram")).join(wanted, "gram")
    fits = (F.size("grams") >= least * F.size("term_grams")) & (F.size("term_grams") >= least * F.size("grams"))
    both = F.size(F.array_intersect("grams", "term_grams"))
    similarity = both / (F.size("grams") + F.size("term_grams") - both)
    found = met.where(fits).select("term", "word", similarity.alias("similarity")).where(F.col("similarity") >= least)
    return found.dropDuplicates(["term", "word"])


def trigram_hits(docs: DataFrame, terms: DataFrame, exclude: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(query_id, id, relevance, position): texts in which every term of a query has a similar word in title or content.

    relevance: the mean over terms of twice the best similarity in the title and
    once that in the content.  exclude: pairs (query_id, id) that were found
    already; their number per query is taken off the limit.
    """
    fields = [docs.select("id", F.lit(f).alias("field"), F.explode(F.array_distinct(tokens(F.col(f)))).alias("word")) for f in WEIGHTS]
    words = fields[0].unionByName(fields[1])
    near = small(written(similar_words(words, terms), "similar-words"))
    by_term = words.join(near, "word").groupBy("term", "id").agg(*[F.max(F.when(F.col("field") == f, F.col("similarity"))).alias(f) for f in WEIGHTS])
    value = 2 * F.coalesce("title", F.lit(0.0)) + F.coalesce("content", F.lit(0.0))
    counts = terms.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    wanted = small(terms.distinct().join(counts, "query_id"))
    found = by_term.withColumn("value", value).join(wanted, "term").groupBy("query_id", "id", "n_terms").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("hit"))
    found = found.where("hit = n_terms").select("query_id", "id", F.round(F.col("total") / F.col("n_terms"), 6).alias("relevance"))
    room = F.lit(limit)
    if exclude is not None:
        found = found.join(exclude.select("query_id", "id"), ["query_id", "id"], "left_anti")
        taken = exclude.groupBy("query_id").agg(F.count(F.lit(1)).alias("taken"))
        found = found.join(taken, "query_id", "left")
        room = limit - F.coalesce("taken", F.lit(0))
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= room).select("query_id", "id", "relevance", "position")


def layered(docs: DataFrame, first: DataFrame, terms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, id, score, matches_all, position, layer): all fused hits of a query, filled up to the limit by the fallback over `terms`."""
    first = written(first.select("query_id", "id", "score", "matches_all", "position"), "hits")
    taken = first.groupBy("query_id").agg(F.max("position").alias("taken"))
    open_terms = terms.join(taken.where(F.col("taken") >= limit), "query_id", "left_anti")
    more = trigram_hits(docs, open_terms, first, limit)
    more = more.join(taken, "query_id", "left").select("query_id", "id", F.col("relevance").alias("score"), F.lit(False).alias("matches_all"), (F.col("position") + F.coalesce("taken", F.lit(0))).alias("position"))
    return first.withColumn("layer", F.lit("primary")).unionByName(more.withColumn("layer", F.lit("trigram")))


def banded(hits: DataFrame, response: str) -> DataFrame:
    """Relevance of hits (layer, matches_all, score) spread over the band of their layer, per response; a lone score gets the band's top."""
    over = Window.partitionBy(response, "layer", "matches_all")
    low, high = F.min("score").over(over), F.max("score").over(over)
    pick = lambda k: F.coalesce(*[F.when((F.col("layer") == layer) & (F.col("matches_all") == full), F.lit(b[k])) for (layer, full), b in BANDS.items()])
    spread = F.when(high > low, pick(0) + (pick(1) - pick(0)) * (F.col("score") - low) / (high - low)).otherwise(pick(1))
    return hits.withColumn("relevance", F.round(spread, 6))
