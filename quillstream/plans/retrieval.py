"""Queries of vocabulary, ranked search, fallback, selection and reading in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.wire import hit_wire_size
from quillstream.operators import hits as H
from quillstream.operators import textindex as T
from quillstream.operators.bestfirst import best_hits
from quillstream.operators.numbering import numbered
from quillstream.plans.registry import query
from quillstream.sources.tables import read_table, spread, written

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_TITLE = "coalesce(substr(trim(split_part(text, chr(10), 1), ' ' || chr(9) || chr(13) || chr(160)), 1, 60), '')"
_CORPUS = f"SELECT doc_id AS id, CASE WHEN content_type = 'code' THEN 'code' ELSE 'prose' END AS cls, {_TITLE} AS title, text AS content, source FROM documents WHERE text IS NOT NULL"
_FIELDS = f"""SELECT id, cls, field, len(words) AS dl, words FROM (
  SELECT id, cls, 'title' AS field, {_WORDS.format('title')} AS words FROM ({_CORPUS}) UNION ALL
  SELECT id, cls, 'content' AS field, {_WORDS.format('content')} AS words FROM ({_CORPUS}))"""
_TERMS = f"SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM eval_items"
_TITLES = f"SELECT DISTINCT doc_id AS query_id, unnest({_WORDS.format(_TITLE)}) AS term FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0"


def _scores_sql(queries: str) -> str:
    return f"""WITH fields AS ({_FIELDS}), terms AS ({queries}),
  found AS (SELECT cls, field, id, dl, term, count(*) AS tf FROM (SELECT cls, field, id, dl, unnest(words) AS term FROM fields)
    WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  stats AS (SELECT cls, field, count(*) AS n, avg(dl) AS mean_dl FROM fields GROUP BY ALL),
  dfs AS (SELECT cls, field, term, count(*) AS df FROM found GROUP BY ALL),
  parts AS (SELECT cls, id, term, sum((CASE field WHEN 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))) AS part FROM found JOIN dfs USING (cls, field, term) JOIN stats USING (cls, field) GROUP BY ALL),
  counts AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
  scores AS (SELECT query_id, cls, id, round(sum(part), 6) AS score, count(*) = max(n_terms) AS matches_all FROM parts JOIN terms USING (term) JOIN counts USING (query_id) GROUP BY 1, 2, 3)"""


_SCORES = _scores_sql(_TERMS)
_RANKED = """SELECT *, row_number() OVER (PARTITION BY query_id, cls ORDER BY matches_all DESC, score DESC, id) AS class_rank FROM scores QUALIFY class_rank <= 10"""
_FUSED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches_all DESC, 1 / (60 + class_rank) DESC, id) AS position FROM ({_RANKED}) QUALIFY position <= 5"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.corpus(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "content_type", "source")))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25_scores(_corpus(spark, sf_dir), T.query_terms(_queries(spark, sf_dir), "text"))


def _built(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What several queries of a session begin with, written once: the table `what` of the data in sf_dir."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _TABLES:
        _TABLES[key] = written(build(), what)
    return _TABLES[key]


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


@query(f"SELECT source, word, count(*) AS doc_freq FROM (SELECT source, unnest(list_distinct({_WORDS.format('text')})) AS word FROM documents) GROUP BY ALL")
def vocabulary_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vocabulary(read_table(spark, sf_dir, "documents"), "source", "text")


@query(f"""SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_freq, word) AS INTEGER) AS position, word, doc_freq FROM (
  SELECT source, word, count(*) AS doc_freq FROM (SELECT source, unnest(list_distinct({_WORDS.format('text')})) AS word FROM documents) GROUP BY ALL) QUALIFY position <= 40""")
def vocabulary_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distinctive(T.vocabulary(read_table(spark, sf_dir, "documents"), "source", "text"), "source").select("source", "position", "word", "doc_freq")


@query()
def vocabulary_prose_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prose_vocabulary(read_table(spark, sf_dir, "documents").where("content_type <> 'code'"), "source", "doc_id", "text")


@query(f"""SELECT source, word, delta FROM (SELECT source, word, sum(n)::BIGINT AS delta FROM (
  SELECT source, unnest(list_distinct({_WORDS.format("split_part(text, chr(10) || chr(10), 1)")})) AS word, 1 AS n FROM documents UNION ALL
  SELECT source, unnest(list_distinct({_WORDS.format('text')})) AS word, -1 AS n FROM documents) GROUP BY ALL) WHERE delta <> 0""")
def vocabulary_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when every document is replaced by its first paragraph."""
    docs = read_table(spark, sf_dir, "documents")
    return T.vocabulary_delta(docs, docs.withColumn("text", F.split("text", "\n\n", 2)[0]), "source", "text")


@query(f"""SELECT source, word, count(*) AS doc_freq FROM (SELECT source, unnest(list_distinct({_WORDS.format("split_part(text, chr(10) || chr(10), 1)")})) AS word FROM documents) GROUP BY ALL""")
def vocabulary_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vocabulary after every document was replaced by its first paragraph: changes applied, words without texts pruned."""
    docs = read_table(spark, sf_dir, "documents")
    held = T.vocabulary(docs, "source", "text")
    return T.maintained(held, T.vocabulary_delta(docs, docs.withColumn("text", F.split("text", "\n\n", 2)[0]), "source", "text"), "source")


@query(f"{_SCORES} SELECT query_id, id, cls, score, matches_all, CAST(class_rank AS INTEGER) AS class_rank FROM ({_RANKED})")
def search_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.class_ranks(_scores(spark, sf_dir)).select("query_id", "id", "cls", "score", "matches_all", "class_rank")


@query(f"{_SCORES} SELECT query_id, CAST(position AS INTEGER) AS position, id, score, matches_all FROM ({_FUSED})")
def search_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fused(T.class_ranks(_scores(spark, sf_dir))).select("query_id", "position", "id", "score", "matches_all")


@query(f"""{_scores_sql(_TITLES)} SELECT query_id, CAST(position AS INTEGER) AS position, id, score, matches_all FROM ({_FUSED})""")
def search_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found with the titles of the documents whose id is divisible by 20, among all documents."""
    corpus = _corpus(spark, sf_dir)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "title")
    hits, members = best_hits(corpus, T.query_terms(queries, "title"))
    best = T.fused(T.class_ranks(hits.withColumnRenamed("set", "query_id"))).withColumnRenamed("query_id", "set")
    return best.join(members, "set").select("query_id", "position", "id", "score", "matches_all")


_SOURCE = "SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1"


@query(f"""{_SCORES}, own AS (SELECT * FROM scores WHERE id IN (SELECT id FROM ({_CORPUS}) WHERE source = ({_SOURCE})))
  SELECT query_id, CAST(position AS INTEGER) AS position, id, score, matches_all FROM ({_FUSED.replace("FROM scores", "FROM own")})""")
def search_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with a filter on one source, the one with the most documents; statistics stay those of the whole corpus."""
    docs = read_table(spark, sf_dir, "documents").where("source is not null")
    largest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(1)  # one row
    own = T.in_sources(_corpus(spark, sf_dir), largest)
    return T.fused(T.class_ranks(_scores(spark, sf_dir).join(own.select("id"), "id", "left_semi"))).select("query_id", "position", "id", "score", "matches_all")


_GRAMS = "list_distinct(flatten(list_transform({1}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_STOP = ", ".join(f"'{w}'" for w in T.FALLBACK_STOP_WORDS)
_LAST_TERMS = f"""SELECT query_id, unnest(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8]) AS term FROM (
  SELECT item_id AS query_id, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda w: octet_length(encode(w)) >= 3 AND NOT list_contains([{_STOP}], w)) AS ws FROM eval_items)"""
_SIMILAR = f"""WITH terms AS (SELECT DISTINCT query_id, term FROM ({_LAST_TERMS})), fields AS ({_FIELDS}),
  words AS (SELECT DISTINCT id, field, unnest(words) AS word FROM fields), own AS (SELECT word, {_GRAMS.format('word', '[word]')} AS g FROM (SELECT DISTINCT word FROM words)),
  wanted AS (SELECT term, {_GRAMS.format('term', _WORDS.format('term'))} AS g FROM (SELECT DISTINCT term FROM terms)),
  shared AS (SELECT term, word, count(*) AS n_both FROM (SELECT word, unnest(g) AS gram FROM own) JOIN (SELECT term, unnest(g) AS gram FROM wanted) USING (gram) GROUP BY ALL),
  near AS (SELECT term, word, n_both / (len(wanted.g) + len(own.g) - n_both) AS similarity FROM shared JOIN own USING (word) JOIN wanted USING (term)
    WHERE n_both / (len(wanted.g) + len(own.g) - n_both) >= 0.5),
  by_term AS (SELECT term, id, max(CASE WHEN field = 'title' THEN similarity END) AS t, max(CASE WHEN field = 'content' THEN similarity END) AS c FROM words JOIN near USING (word) GROUP BY ALL),
  counts AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
  found AS (SELECT query_id, id, round(sum(2 * coalesce(t, 0) + coalesce(c, 0)) / max(n_terms), 6) AS relevance FROM by_term JOIN terms USING (term) JOIN counts USING (query_id)
    GROUP BY 1, 2 HAVING count(*) = max(n_terms))"""


@query(f"{_SIMILAR} SELECT term, word, round(similarity, 6) AS similarity FROM near")
def words_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    words = corpus.select(F.explode(F.array_distinct(F.concat(T.tokens(F.col("title")), T.tokens(F.col("content"))))).alias("word"))
    return T.similar_words(words, T.fallback_terms(_queries(spark, sf_dir), "text")).withColumn("similarity", F.round("similarity", 6))


@query(f"""{_SIMILAR} SELECT query_id, id, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INTEGER) AS position FROM found QUALIFY position <= 5""")
def search_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trigram_hits(_corpus(spark, sf_dir), T.fallback_terms(_queries(spark, sf_dir), "text"))


def _response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers: ranked hits, those with all terms before those with some, filled up by the fallback."""
    return _built(spark, sf_dir, "response", lambda: _searched(spark, sf_dir))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    first = T.fused(T.class_ranks(T.bm25_scores(corpus, T.query_terms(queries, "text"), stems=True)))
    both = T.layered(corpus, first, T.fallback_terms(queries, "text"))
    both = both.withColumns({"request_id": F.expr("query_id div 10"), "qi": F.expr("cast(query_id % 10 as int)")})
    return T.banded(both, "request_id")


@query()
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response(spark, sf_dir).select("request_id", "qi", "query_id", "position", "id", "layer", "matches_all", "relevance")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a response with snippet and size on the wire."""
    return _built(spark, sf_dir, "sized-hits", lambda: _cut(spark, sf_dir))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _response(spark, sf_dir)
    texts = _corpus(spark, sf_dir).join(T.small(found.select("id").distinct()), "id", "left_semi")
    joined = found.join(texts, "id").join(T.small(_queries(spark, sf_dir).withColumnRenamed("text", "query")), "query_id")
    cut = H.with_snippets(joined)
    return cut.withColumn("size", hit_wire_size(F.col("title"), F.col("snippet"), F.coalesce("source", F.lit("")), F.col("layer")).cast("int")).withColumn("rank", F.col("position"))


@query()
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("query_id", "id", "snippet", "fallback", "size")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: hits, bytes, and success, degraded or retry (a required item without hits).

    It is a success if any hit's source, title or snippet holds any of the item's terms of at least five letters.
    """
    hits = _sized(spark, sf_dir).select("query_id", "source", "title", "snippet", "size", "layer")
    terms = T.query_terms(_queries(spark, sf_dir), "text", least=5).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    text = F.lower(F.concat_ws(" ", "source", "title", "snippet"))
    told = hits.join(T.small(terms), "query_id").withColumn("told", F.exists("terms", lambda t: F.contains(text, t)))
    by = told.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("size").alias("n_bytes"), F.max("told").alias("told"))
    items = read_table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.coalesce("suite", F.lit("")).alias("suite"), "is_required")
    joined = items.join(by, "query_id", "left").fillna(0, ["n_hits", "n_bytes"])
    outcome = F.when((F.col("n_hits") == 0) & F.coalesce("is_required", F.lit(False)), "retry").when(F.coalesce("told", F.lit(False)), "success").otherwise("degraded")
    return joined.withColumn("outcome", outcome)


@query()
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("query_id", "suite", "n_hits", "n_bytes", "outcome")


@query()
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: items by outcome, bytes shown, and how many times larger the corpus is."""
    raw = read_table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]  # one number
    by = _outcomes(spark, sf_dir).groupBy("suite").agg(F.count(F.lit(1)).alias("n_items"), *[F.sum((F.col("outcome") == o).cast("int")).alias(f"n_{o}") for o in ("success", "degraded", "retry")], F.sum("n_bytes").alias("shown_bytes"))
    return by.withColumn("raw_bytes", F.lit(raw).cast("long")).withColumn("compression", F.round(F.try_divide("raw_bytes", "shown_bytes"), 2))


def _allocation(variant: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return H.allocate(_sized(spark, sf_dir), 4096, variant)

    run.__name__ = "allocate_" + variant.replace("-", "_")
    return query()(run)


for _variant in H.ALLOCATORS:
    _allocation(_variant)


@query()
def search_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request, whose budget is asked for to hold all of its hits and clamped to the ceiling: hits by layer, what was left out, queries without hits."""
    hits = _sized(spark, sf_dir)
    asked = _queries(spark, sf_dir).select(F.expr("query_id div 10").alias("request_id"), "query_id")
    budgets = hits.groupBy("request_id").agg(H.budget(F.sum("size")).alias("budget_bytes"))
    return H.search_meta(hits, H.allocate(hits.join(budgets, "request_id"), None, "rank-round"), asked, budgets)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select(F.expr("query_id div 10").alias("request_id"), "query_id", F.col("text").alias("query"))


@query()
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as they are shown."""
    return H.response_texts(_sized(spark, sf_dir), _asked(spark, sf_dir))


@query()
def search_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each query's answer in plain lines."""
    return H.compact_bytes(_sized(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""SELECT source, count(*) AS n_docs, count(DISTINCT label) AS n_labels, sum(CASE WHEN content_type = 'code' THEN 1 ELSE 0 END)::BIGINT AS n_code,
  sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS n_bytes, epoch_us(max(indexed_at)) AS last_us FROM documents GROUP BY 1""")
def sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    last = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', max(cast(indexed_at as timestamp_ntz)))").alias("last_us")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("label").alias("n_labels"), F.sum(F.when(F.col("content_type") == "code", 1).otherwise(0)).alias("n_code"),
        F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n_bytes"), last,
    )


@query("""SELECT label, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY indexed_at DESC NULLS LAST, doc_id DESC) AS age FROM documents WHERE label IS NOT NULL) WHERE age = 1""")
def sources_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by (source, label): the document that was indexed last stays."""
    docs = read_table(spark, sf_dir, "documents").where("label is not null").select("source", "label", "indexed_at", "doc_id")
    newest = docs.groupBy("source", "label").agg(F.max(F.struct(F.col("indexed_at").isNotNull().alias("dated"), "indexed_at", "doc_id")).alias("newest"))
    return newest.select("label", F.col("newest.doc_id").alias("doc_id"))


@query("""SELECT source, doc_id, CAST(position AS INTEGER) AS position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY indexed_at DESC NULLS LAST, doc_id) AS position FROM documents)""")
def sources_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source, those indexed last first."""
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id", "indexed_at")
    day = F.coalesce(F.expr("-timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(indexed_at as timestamp_ntz))"), F.lit(2**40))
    listed = numbered(docs, ["source"], day, [F.col("indexed_at").desc_nulls_last(), "doc_id"], "position")
    return listed.select("source", "doc_id", F.col("position").cast("int").alias("position"))
