"""Reading a document's chunks in order, page by page, under a byte budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.wire import hit_wire_size

LAYER = "document"


def pages(cut: DataFrame, budget: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The chunks of each document from `offset` on that fit a page, in order.

    Chunks are never passed over: the page ends at the first that doesn't fit.
    If that is the page's first, the longest start of it that fits comes in,
    marked `truncated`; if not even a letter fits, the page is empty.  Rows:
    doc_id, ordinal, snippet, truncated, used_bytes.
    """
    hits = cut.where(F.col("ordinal") >= offset)
    if limit is not None:
        hits = hits.where(F.col("ordinal") < offset + limit)
    source = F.coalesce("label", F.lit(""))
    sized = hits.withColumn("size", hit_wire_size(F.col("title"), F.col("content"), source, F.lit(LAYER)))
    running = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = sized.withColumn("used_bytes", F.sum("size").over(running))
    fit = used.where(F.col("used_bytes") <= budget).select("doc_id", "ordinal", F.col("content").alias("snippet"), F.lit(False).alias("truncated"), "used_bytes")
    envelope = hit_wire_size(F.col("title"), F.lit(""), source, F.lit(LAYER)) + len(',"truncated":true')
    heads = used.where((F.col("ordinal") == offset) & (F.col("size") > budget)).withColumn("room", (F.lit(budget) - envelope).cast("int"))
    heads = heads.withColumn("head", fitting_start(F.col("content"), F.col("room"))).where(F.length("head.text") > 0)
    short = heads.select("doc_id", "ordinal", F.col("head.text").alias("snippet"), F.lit(True).alias("truncated"), (envelope + F.col("head.size")).cast("long").alias("used_bytes"))
    return fit.unionByName(short)


def all_pages(cut: DataFrame, budget: int) -> DataFrame:
    """Every page of each document, as a reader gets them that follows next_offset (null at the end).

    Rows: doc_id, page_no (from 1), offset, ordinal, snippet, truncated,
    used_bytes, next_offset, n_chunks.  A chunk of which not even a letter fits
    ends the reading: it comes with a null snippet and its own place as
    next_offset.
    """
    source = F.coalesce("label", F.lit(""))
    sized = cut.withColumn("size", hit_wire_size(F.col("title"), F.col("content"), source, F.lit(LAYER)))
    units = sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "size"))).alias("u"))  # at most 500 of a document
    units = units.withColumn("page_no", F.pandas_udf(_page_numbers, "array<int>")(F.col("u.size"), F.lit(budget)))
    numbers = units.select("doc_id", F.size("u").alias("n_chunks"), F.explode(F.arrays_zip(F.col("u.ordinal").alias("ordinal"), "page_no")).alias("z")).select("doc_id", "n_chunks", "z.*")
    page = Window.partitionBy("doc_id", "page_no")
    running = page.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.join(numbers, ["doc_id", "ordinal"]).withColumns({"offset": F.min("ordinal").over(page), "after": F.max("ordinal").over(page) + 1, "used_bytes": F.sum("size").over(running)})
    rows = rows.withColumn("next_offset", F.when(F.col("after") < F.col("n_chunks"), F.col("after")))
    columns = ["doc_id", "page_no", "offset", "ordinal", "snippet", "truncated", "used_bytes", "next_offset", "n_chunks"]
    fit = rows.where(F.col("size") <= budget).withColumns({"snippet": F.col("content"), "truncated": F.lit(False)})
    envelope = hit_wire_size(F.col("title"), F.lit(""), source, F.lit(LAYER)) + len(',"truncated":true')
    heads = rows.where(F.col("size") > budget).withColumn("head", fitting_start(F.col("content"), (F.lit(budget) - envelope).cast("int")))
    some = F.length("head.text") > 0
    heads = heads.withColumns({
        "snippet": F.when(some, F.col("head.text")), "truncated": some, "used_bytes": F.when(some, envelope + F.col("head.size")).otherwise(0).cast("long"),
        "next_offset": F.when(some, F.col("next_offset")).otherwise(F.col("ordinal")),
    })
    every = fit.select(*columns).unionByName(heads.select(*columns))
    stuck = F.min(F.when(F.col("snippet").isNull(), F.col("ordinal"))).over(Window.partitionBy("doc_id"))
    return every.withColumn("stuck", stuck).where(F.col("stuck").isNull() | (F.col("ordinal") <= F.col("stuck"))).drop("stuck")


def all_cursors(read: DataFrame) -> DataFrame:
    """Per page of `all_pages`: chunks on it, bytes used, and next_offset (null at the end)."""
    return read.groupBy("doc_id", "page_no", "offset", "n_chunks").agg(
        F.count("snippet").alias("n_hits"), F.max("used_bytes").alias("byte_budget_used"), F.max("truncated").alias("truncated"), F.max("next_offset").alias("next_offset")
    )


def _page_numbers(sizes: pd.Series, budgets: pd.Series) -> pd.Series:
    """The page of each chunk: a page ends before the first chunk that doesn't fit it."""
    out = []
    for own, budget in zip(sizes, budgets, strict=True):
        page, used, numbers = 1, 0, []
        for size in own:
            if used and used + size > budget:
                page, used = page + 1, 0
            used += size
            numbers.append(page)
        out.append(numbers)
    return pd.Series(out)


def _json_bytes(c: str) -> int:
    if c in '"\\\n\r\t\b\f':
        return 2
    if c < " " or c in "<>&  ":
        return 6
    return len(c.encode("utf-8", "surrogatepass"))


def fitting_start(text: Column, room: Column) -> Column:
    return F.pandas_udf(_fitting_starts, "struct<text string, size int>")(text, room)


def _fitting_starts(texts: pd.Series, rooms: pd.Series) -> pd.DataFrame:
    """The longest start of a text whose JSON form has at most so many bytes."""
    rows = []
    for text, room in zip(texts, rooms, strict=True):
        size = n = 0
        for c in text[: max(0, room)]:
            more = _json_bytes(c)
            if size + more > room:
                break
            size, n = size + more, n + 1
        rows.append((text[:n], size))
    return pd.DataFrame(rows, columns=["text", "size"])


def cursors(cut: DataFrame, page: DataFrame, offset: int = 0) -> DataFrame:
    """Per document: chunks on the page, bytes used, and next_offset (null at the end)."""
    total = cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    got = page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("used_bytes").alias("byte_budget_used"), F.max("truncated").alias("truncated"))
    joined = total.join(got, "doc_id", "left").fillna(0, ["n_hits", "byte_budget_used"]).fillna(False, ["truncated"])
    after = F.col("n_hits") + offset
    return joined.withColumn("next_offset", F.when(after < F.col("n_chunks"), after))
