"""Mixing sources to target weights by a low-discrepancy schedule.

Every document's size is its number of tokens.  The mixture is a row of slots,
each of which takes one block of `block_tokens` tokens of a source.  A source
with b blocks owns b places in the cumulative weights 0 .. M (M: all blocks);
slot i looks at place i * g mod M, with g / M the golden ratio as nearly as
whole numbers allow and g without a divisor in common with M.  So the points of
the first slots, of any stretch of slots and of all slots lie evenly, every
place is met exactly once, and each source gets just as many slots as it has
blocks.  The slots of a source are ranked, and slot k takes the k-th block of
the source: its documents in shuffled order, one pass after the other up to the
permitted number of repeats, cut into blocks of equal tokens.

Ranks and running totals are taken in two steps, within buckets and over the
buckets' sums, so that no task ever holds a whole source.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.sources.tables import written

GOLDEN = 0.6180339887498949
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the tokenizer's vocabulary cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """A tokenizer of a vocabulary file in tiktoken's format, once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens); null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan_shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: its tokens, capacity (tokens times repeats), wanted tokens and tokens to take.

    total_tokens: the size of the mixture, by default all tokens of `sizes`,
    those of sources without a target included.  A source is wanted with its
    weight of the total and gives at most its capacity; what it can't give is
    its shortfall and isn't made up by others, so the sources that have enough
    keep their shares among each other.  Targets that are null or not positive
    get nothing; a null max_repeats or one below 1 forbids the source.  Of
    repeated targets the largest weight and repeats count.
    """
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    wanted = targets.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    total = F.lit(int(total_tokens)) if total_tokens is not None else F.col("corpus_tokens")
    every = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens"))  # one row
    joined = wanted.join(held, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).join(F.broadcast(every))
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    capacity = F.col("source_tokens") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    planned = joined.withColumns({"total": total, "capacity": capacity.cast("long"), "wanted": F.round(weight * total).cast("long")}).drop("corpus_tokens")
    return planned.withColumn("take", F.least("capacity", "wanted"))


def _running(df: DataFrame, group: list[str], order: list[str], value: str, name: str, buckets: int = 4096) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, by a hash-like first order column."""
    step = (1 << 32) // buckets
    bucketed = df.withColumn("__b", F.floor(F.col(order[0]) / step))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy(*group, "__b").agg(F.sum(value).alias("__s")).withColumn("__base", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = bucketed.withColumn("__at", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return at.join(sums, [*group, "__b"]).withColumn(name, F.col("__base") + F.col("__at")).drop("__b", "__at", "__base")


def golden_step(size: int) -> int:
    """A step without a divisor in common with `size`, near size times the golden ratio.

    Of the candidates the one whose continued fraction over `size` has the
    smallest largest term: then the points lie evenly at every scale.
    """

    def largest(step: int) -> int:
        a, b, most = size, step, 0
        while b:
            most, a, b = max(most, a // b), b, a % b
        return most

    middle, wide = round(size * GOLDEN), min(300, size // 20 + 2)
    near = [s for s in range(max(1, middle - wide), middle + wide + 1) if s < max(2, size) and math.gcd(s, size) == 1]
    return min(near, key=lambda s: (largest(s), abs(s - middle)))


def _place(slot: Column, step: int, size: int) -> Column:
    """slot * step mod size without overflow, for sizes below 2^40."""
    high, low = divmod(step, 1 << 20)
    return ((slot * high % size) * (1 << 20) + slot * low) % size


def schedule(spark: SparkSession, blocks: list[tuple[str, int]]) -> DataFrame:
    """(slot, source, block): every block 0 .. n - 1 of every source in one slot; blocks: (source, n) of each source."""
    edges = list(accumulate((n for _, n in blocks), initial=0))
    size = edges[-1]
    names, ends = F.array(*[F.lit(s) for s, _ in blocks]), F.array(*[F.lit(e).cast("long") for e in edges[1:]])
    place = _place(F.col("slot"), golden_step(size), size)
    row = spark.range(size).withColumnRenamed("id", "slot").withColumn("__place", place)
    row = row.withColumn("source", F.element_at(names, F.size(F.filter(ends, lambda e: e <= F.col("__place"))) + 1)).drop("__place")
    chunked = row.withColumn("__c", F.expr("slot div 65536"))
    before = Window.partitionBy("source").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunked.groupBy("source", "__c").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("source", "__c").orderBy("slot")) - 1
    return chunked.withColumn("__k", inside).join(bases, ["source", "__c"]).select("slot", "source", (F.col("__base") + F.col("__k")).alias("block"))


def shuffled_blocks(spark: SparkSession, sizes: DataFrame, shares: list[dict], block: int, seed: int) -> DataFrame:
    """(source, block, doc_id, repeat_no, token_from, n_tokens): the documents of each source, cut into its blocks."""
    plan = [(s["source"], int(s["take"]), int(s["source_tokens"]), -(-int(s["take"]) // int(s["source_tokens"]))) for s in shares]
    plan = spark.createDataFrame(plan, "source string, take long, __size long, passes int")
    passes = sizes.where("n_tokens > 0").join(F.broadcast(plan), "source").withColumn("repeat_no", F.explode(F.expr("sequence(1, passes)")))
    hashed = passes.withColumn("__h", F.hash("doc_id", "repeat_no", F.lit(seed)).cast("long") + (1 << 31))
    shuffled = _running(hashed, ["source", "repeat_no"], ["__h", "doc_id", "n_tokens"], "n_tokens", "__start")
    starts = shuffled.withColumn("__first", F.col("__start") + F.col("__size") * (F.col("repeat_no") - 1)).where("__first < take")
    ends = starts.withColumn("__end", F.least(F.col("__first") + F.col("n_tokens"), F.col("take")))
    pieces = ends.withColumn("block", F.explode(F.expr(f"sequence(__first div {block}, (__end - 1) div {block})")))
    low, high = F.greatest(F.col("__first"), F.col("block") * block), F.least(F.col("__end"), (F.col("block") + 1) * block)
    return pieces.select("source", "block", "doc_id", "repeat_no", (low - F.col("__first")).alias("token_from"), (high - low).alias("n_tokens"))


def _planned(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[dict]:
    """The target sources that give something; one row per target source reaches the driver."""
    return [r.asDict() for r in plan_shares(sizes, targets, total_tokens).where("take > 0").orderBy("source").collect()]


def mixture(spark: SparkSession, docs: DataFrame, targets: DataFrame, block_tokens: int = 2_048, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, sizes: DataFrame | None = None) -> DataFrame:
    """(slot, source, doc_id, repeat_no, token_from, n_tokens): pieces of documents, in slots of block_tokens tokens.

    The mixture has total_tokens tokens (default: those of the corpus) less the
    shortfalls of `plan_shares`.  A document that crosses the edge of a block
    goes on in the source's next block, token_from tokens into the document; so
    all slots but a source's last have equal size, every block has its slot, and
    shares are exact.  Documents without tokens, without a source or of sources
    without a target don't come in; documents with the same id count as
    different ones of their own size.  sizes: `token_counts` of docs, where the
    caller has them.  Empty tables give no rows.
    """
    sizes = written(token_counts(docs, tokenizer), "token-counts") if sizes is None else sizes
    shares = _planned(sizes, targets, total_tokens)
    if not shares:
        return spark.createDataFrame([], "slot long, source string, doc_id long, repeat_no int, token_from long, n_tokens long")
    block = max(1, block_tokens)
    slots = schedule(spark, [(s["source"], -(-int(s["take"]) // block)) for s in shares])
    blocks = shuffled_blocks(spark, sizes, shares, block, seed)
    return blocks.join(slots, ["source", "block"]).select("slot", "source", "doc_id", "repeat_no", "token_from", "n_tokens")


def mixture_shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target and actual share, wanted and actual tokens, shortfall, slots and the most repeats of a document."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("slot").alias("n_slots"), F.max("repeat_no").alias("most_repeats"))
    joined = plan_shares(sizes, targets, total_tokens).join(got, "source", "left").fillna(0, ["n_tokens", "n_slots", "most_repeats"])
    every = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    share = lambda whole: F.coalesce(F.try_divide(F.col("n_tokens"), whole), F.lit(0.0))
    return joined.select(
        "source", "target_weight", "max_repeats", "source_tokens", F.col("wanted").alias("wanted_tokens"), "n_tokens", (F.col("wanted") - F.col("n_tokens")).alias("shortfall"),
        "n_slots", "most_repeats", share(every).alias("actual_share"), share(F.col("total")).alias("share_of_total"),
    )


def with_texts(mixed: DataFrame, docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture with the text of every piece; the pieces of a document, one after the other, are its text.

    The pieces of a document meet its text once and are cut from one pass of the
    tokenizer.  A character whose bytes lie in tokens of two pieces belongs to
    the first.  doc_id must be unique in docs.
    """
    columns = mixed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(tokenizer)
        for b in batches:
            rows = []
            for text, pieces in zip(b.column("text").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                ends = list(accumulate((len(x) for x in vocabulary.decode_tokens_bytes(vocabulary.encode_ordinary(text))), initial=0))

                def whole(at: int, raw: bytes = raw, ends: list[int] = ends) -> int:
                    place = ends[min(at, len(ends) - 1)]
                    while place < len(raw) and raw[place] & 0xC0 == 0x80:
                        place += 1
                    return place

                rows += [(*p.values(), raw[whole(p["token_from"]) : whole(p["token_from"] + p["n_tokens"])].decode("utf-8", "surrogatepass")) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*columns, "text"])

    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    by_doc = mixed.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("pieces"))  # as many as its length and repeats have blocks
    joined = by_doc.join(docs.select("doc_id", "text"), "doc_id").select("pieces", "text")
    return joined.mapInArrow(run, "slot long, source string, doc_id long, repeat_no int, token_from long, n_tokens long, text string")
