"""Texts into titled chunks, one way per format, over tables of lines.

A document becomes rows (doc, line_no, line); marks on lines, running sums and
windows find the units of a format, and units are packed towards 2,048 bytes.
Every chunk is exact text of the document; none has more than 4,096 bytes.

The input has the columns (doc_id, label, text, format, content_type).  A
document is bounded by the limit on ingested bodies (1 MiB), so a window over
the lines of one is bounded, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillstream.functions import pieces
from quillstream.functions.pieces import MOST, TITLE
from quillstream.sources.tables import written

#: Bytes of a body, chunks of a source, sections of a summary, characters of a preview.
BODY_MOST, SOURCE_MOST, SECTIONS, PREVIEW = 1 << 20, 500, 50, 200
FORMATS = ("log", "stacktrace", "csv", "tsv", "metrics", "json", "markdown", "text")
# The formats' lines, put together from the parts that their published descriptions name.
_CLOCK, _FRACTION, _NAME = r"\d\d:\d\d:\d\d", r"(?:[.,]\d+)?", r"[A-Za-z_][\w.]*"
_STAMPS = {
    "RFC 3339": rf"\d{{4}}-\d\d-\d\d[ T]{_CLOCK}{_FRACTION}(?:[+-]\d\d:?\d\d|Z)?",
    "time of day": rf"\b{_CLOCK}{_FRACTION}\b",
    "RFC 3164": rf"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d\d? {_CLOCK}",
    "glog": rf"[EFIW]\d{{4}} {_CLOCK}\.\d{{6}}",
    "seconds since 1970": r"\[\d{10}(?:\.\d+)?\]",
}
ANCHOR = "|".join(_STAMPS.values())
# What programs print at the head of a report.
_CHAINS = ["During handling of the above exception", "The above exception was the direct cause", "Caused by:"]
TRACEBACK, CHAINED = r"^Traceback \(most recent call last\):", f"^(?:{'|'.join(_CHAINS)})"
PANIC, GOROUTINE, THREAD = "^panic: ", r"^goroutine \d+ \[", "^Exception in thread "
JVM_ERROR, JVM_FRAME, LAST_ERROR = rf"^{_NAME}(?:Error|Exception)(?:$|: )", r"^\s+at ", rf"^{_NAME}: ."
# The exposition format: `# KEYWORD name ...`, or `name{labels} value [time]`.
_METRIC, _LABELS, _NUMBER = "[a-zA-Z_:][a-zA-Z0-9_:]*", r"\{.*\}", r"[-+]?(?:\.\d+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|NaN|Inf)"
METRIC_META, METRIC_SAMPLE = rf"^#\s+(UNIT|TYPE|HELP)\s+({_METRIC})(?:\s|$)", rf"^({_METRIC})(?:{_LABELS})?\s+{_NUMBER}(?:\s+\d+)?\s*$"
HEADING, FENCE, LIST = r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", r"^ {0,3}(```|~~~)", r"^\s{0,3}([-*+]|\d+[.)])\s+\S"
CHUNK = ["doc_id", "part", "title", "content", "content_type"]


# ---- small helpers -----------------------------------------------------------------


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def titled(c: Column, fallback: Column) -> Column:
    t = F.substring(trim_blank(c), 1, TITLE)
    return F.when(F.length(t) > 0, t).otherwise(fallback)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def windows_udf(text: str) -> Column:
    return F.pandas_udf(pieces.windows_of, "array<string>")(text)


def bounded_udf(text: str) -> Column:
    return F.pandas_udf(pieces.bounded_of, "array<string>")(text)


def packed_udf(sizes: Column, start: Column) -> Column:
    return F.pandas_udf(pieces.packed_of, "array<int>")(sizes, start)


def json_udf(text: str) -> Column:
    return F.pandas_udf(pieces.json_of, "struct<kind string, titles array<string>, raws array<string>>")(text)


# ---- formats -----------------------------------------------------------------------


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, content_type, line_no, line) from 0."""
    return docs.select("doc_id", "content_type", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    return by_line().rowsBetween(1, Window.unboundedFollowing)


def joined(rows: DataFrame, group: list[str], order: str, text: str, alias: str) -> DataFrame:
    """Texts of each group in order, joined by line breaks."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: x[text]), "\n").alias(alias), F.min(order).alias(order))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, content_type, p, body): what lies between blank lines, without outer blanks."""
    parts = docs.select("doc_id", "content_type", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("p", "body"))
    return parts.withColumn("body", trim_blank(F.col("body"))).where("length(body) > 0")


def text_chunks(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, long ones in windows; a title is the paragraph's first line."""
    parts = paragraphs(docs)
    short = parts.where(F.octet_length("body") <= MOST).withColumn("w", F.lit(0))
    long = parts.where(F.octet_length("body") > MOST).select("doc_id", "content_type", "p", F.posexplode(windows_udf("body")).alias("w", "body"))
    pieces = short.select("doc_id", "content_type", "p", "w", "body").unionByName(long.select("doc_id", "content_type", "p", "w", "body"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "w"))
    numbered = pieces.withColumn("part", number - 1)
    return numbered.select("doc_id", "part", titled(first_line(F.col("body")), F.concat(F.lit("section "), F.col("part") + 1)).alias("title"), F.col("body").alias("content"), "content_type")


def log_lines(docs: DataFrame) -> DataFrame:
    """Lines with the number of their run: a run goes from one line that begins with a time to the next."""
    anchor = F.regexp_instr(F.substring("line", 1, 80), F.lit(ANCHOR)).between(1, 49).cast("int")
    return lines_of(docs).withColumn("run", F.sum(anchor).over(so_far()))


def log_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs from one line with a time to the next, packed; and the documents without such a line."""
    lines = log_lines(docs)
    none = lines.groupBy("doc_id").agg(F.max("run").alias("runs")).where("runs = 0").select("doc_id")
    runs = joined(lines.join(none, "doc_id", "left_anti"), ["doc_id", "content_type", "run"], "line_no", "line", "body")
    runs = runs.withColumn("body", F.regexp_replace("body", r"\n+$", "")).where(F.length(trim_blank(F.col("body"))) > 0)
    return _packed_runs(runs), docs.join(none, "doc_id", "left_semi")


def _packed_runs(runs: DataFrame) -> DataFrame:
    long = F.octet_length("body") > MOST
    stretch = F.sum(long.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = runs.withColumns({"long": long, "stretch": stretch})
    short = marked.where("not long")
    groups = short.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("line_no", (F.octet_length("body") + 1).alias("size")))).alias("u"))
    groups = groups.withColumn("g", packed_udf(F.col("u.size"), F.lit(0))).select("doc_id", F.explode(F.arrays_zip(F.col("u.line_no").alias("line_no"), F.col("g"))).alias("z"), "stretch")
    packs = short.join(groups.select("doc_id", "stretch", F.col("z.line_no").alias("line_no"), F.col("z.g").alias("g")), ["doc_id", "stretch", "line_no"])
    packs = joined(packs, ["doc_id", "content_type", "stretch", "g"], "line_no", "body", "content").select("doc_id", "content_type", "line_no", F.lit(0).alias("w"), "content")
    wide = marked.where("long").select("doc_id", "content_type", "line_no", F.posexplode(windows_udf("body")).alias("w", "content"))
    both = packs.unionByName(wide).withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "w")) - 1)
    return both.select("doc_id", "part", titled(first_line(F.col("content")), F.concat(F.lit("section "), F.col("part") + 1)).alias("title"), "content", "content_type")


def trace_chunks(docs: DataFrame) -> DataFrame:
    """One chunk per error report: chained tracebacks, an exception with its causes, a panic with its first goroutine."""
    line = F.col("line")
    lines = lines_of(docs).withColumn("blank", F.length(trim_blank(line)) == 0)
    next_is_frame = F.first(F.when(~F.col("blank"), line.rlike(JVM_FRAME)), ignorenulls=True).over(after())
    start = line.rlike(TRACEBACK) | line.rlike(THREAD) | (line.rlike(JVM_ERROR) & F.coalesce(next_is_frame, F.lit(False)))
    mark = F.when(line.rlike(CHAINED), "chain").when(start, "start").when(line.rlike(PANIC), "panic").when(line.rlike(GOROUTINE), "goroutine")
    marked = lines.withColumn("mark", mark)
    last_link = F.last(F.when(F.col("mark").isin("chain", "start"), F.col("mark")), ignorenulls=True).over(before())
    last_mark = F.last(F.when(F.col("mark").isin("start", "panic", "goroutine"), F.col("mark")), ignorenulls=True).over(before())
    seen = F.coalesce(F.max(~F.col("blank")).over(before()), F.lit(False))
    edge = (
        ((F.col("mark") == "start") & ~last_link.eqNullSafe("chain") & seen)
        | ((F.col("mark") == "panic") & seen)
        | ((F.col("mark") == "goroutine") & last_mark.eqNullSafe("goroutine"))
    )
    reports = marked.withColumn("report", F.sum(F.coalesce(edge, F.lit(False)).cast("int")).over(so_far()))
    facts = reports.where("not blank").groupBy("doc_id", "report").agg(F.min(F.struct("line_no", "line")).alias("head"), F.max(F.struct("line_no", "line")).alias("tail"), F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 2, 1).alias("second"))
    bodies = joined(reports, ["doc_id", "report"], "line_no", "line", "content").join(facts, ["doc_id", "report"])
    bodies = bodies.withColumn("content", F.regexp_replace("content", r"\n+$", "")).withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("report")) - 1)
    head, tail = trim_blank(F.col("head.line")), trim_blank(F.col("tail.line"))
    jvm = (head.rlike(THREAD) | head.rlike(JVM_ERROR)) & F.coalesce(F.col("second")[0]["line"].rlike(JVM_FRAME), F.lit(False))
    title = F.when(head.rlike(PANIC) | head.rlike(GOROUTINE) | jvm, head).when(tail.rlike(LAST_ERROR), tail)
    return bodies.select("doc_id", "part", titled(F.coalesce(title, F.lit("")), F.concat(F.lit("trace "), F.col("part") + 1)).alias("title"), "content", F.lit("code").alias("content_type"))


def table_chunks(docs: DataFrame) -> DataFrame:
    """Rows packed under a repeated header; a line break inside quotes doesn't end a row, what follows an open quote is text."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    open_before = F.coalesce(F.sum(quotes).over(before()), F.lit(0)) % 2
    lines = lines_of(docs).withColumn("row", F.sum((open_before == 0).cast("int")).over(so_far()))
    rows = joined(lines, ["doc_id", "content_type", "row"], "line_no", "line", "body").withColumn("body", F.regexp_replace("body", r"\r+$", ""))
    broken = (F.length("body") - F.length(F.replace("body", F.lit('"'), F.lit("")))) % 2 == 1
    rows = rows.where("length(body) > 0").withColumn("broken", broken)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = rows.withColumn("n", number - 1)
    head = rows.where("n = 0").select("doc_id", F.col("body").alias("header"))
    body = rows.where("n > 0 and not broken")
    sizes = body.join(head, "doc_id").groupBy("doc_id", "header").agg(F.array_sort(F.collect_list(F.struct("n", (F.octet_length("body") + 1).alias("size")))).alias("u"))
    groups = sizes.withColumn("g", packed_udf(F.col("u.size"), F.octet_length("header"))).select("doc_id", "header", F.explode(F.arrays_zip(F.col("u.n").alias("n"), F.col("g"))).alias("z"))
    placed = body.join(groups.select("doc_id", "header", F.col("z.n").alias("n"), F.col("z.g").alias("g")), ["doc_id", "n"])
    packs = placed.groupBy("doc_id", "content_type", "header", "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n").alias("rows"), F.min("n").alias("first"), F.max("n").alias("last")
    )
    title = F.concat(F.lit("rows "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    whole = packs.select("doc_id", F.col("g").alias("part"), title.alias("title"), F.concat("header", F.lit("\n"), "rows").alias("content"), "content_type")
    tails = rows.where("n > 0 and broken").select("doc_id", "content_type", F.posexplode(windows_udf("body")).alias("w", "content"))
    tails = tails.select("doc_id", (F.col("w") + 1_000_000).alias("part"), titled(first_line(F.col("content")), F.lit("section 1")).alias("title"), "content", "content_type")
    alone = head.join(whole.select("doc_id"), "doc_id", "left_anti").join(docs.select("doc_id", "content_type"), "doc_id")
    alone = alone.select("doc_id", F.lit(0).alias("part"), titled(first_line(F.col("header")), F.lit("section 1")).alias("title"), F.col("header").alias("content"), "content_type")
    return whole.unionByName(tails).unionByName(alone)


def json_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records packed, or one chunk per member; and the documents that are neither."""
    cut = docs.withColumn("u", json_udf("text"))
    units = cut.where("u.kind <> 'text'").select("doc_id", "content_type", F.col("u.kind").alias("kind"), F.posexplode(F.arrays_zip("u.titles", "u.raws")).alias("n", "z"))
    units = units.select("doc_id", "content_type", "kind", "n", F.col("z.titles").alias("title"), F.col("z.raws").alias("raw"))
    members = units.where("kind = 'members'").select("doc_id", F.col("n").alias("part"), "title", F.col("raw").alias("content"), "content_type")
    records = units.where("kind = 'records'")
    sizes = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", (F.octet_length("raw") + 1).alias("size")))).alias("u"))
    groups = sizes.withColumn("g", packed_udf(F.col("u.size"), F.lit(0))).select("doc_id", F.explode(F.arrays_zip(F.col("u.n").alias("n"), F.col("g"))).alias("z"))
    placed = records.join(groups.select("doc_id", F.col("z.n").alias("n"), F.col("z.g").alias("g")), ["doc_id", "n"])
    packs = placed.groupBy("doc_id", "content_type", "g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "\n").alias("content"), F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("title", "n").alias("lead")
    )
    title = F.when(F.col("first") == F.col("last"), F.col("lead")).otherwise(F.concat(F.lit("records "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string")))
    return packs.select("doc_id", F.col("g").alias("part"), title.alias("title"), "content", "content_type").unionByName(members), cut.where("u.kind = 'text'").drop("u")


def metric_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One chunk per metric family, large ones per set of labels; and the documents without any family."""
    line = F.regexp_replace("line", r"\r+$", "")
    lines = lines_of(docs).withColumn("line", line).where(F.length(trim_blank(F.col("line"))) > 0)
    meta, sample = F.regexp_extract("line", METRIC_META, 2), F.regexp_extract("line", METRIC_SAMPLE, 1)
    lines = lines.withColumns({"meta": meta, "sample": F.when(meta == "", sample).otherwise("")})
    declared = lines.where(F.regexp_extract("line", METRIC_META, 1) == "TYPE").groupBy("doc_id", F.col("meta").alias("base")).agg(F.min_by(F.split("line", r"\s+")[3], "line_no").alias("type"), F.min("line_no").alias("since"))
    base = F.regexp_replace("sample", "_(bucket|sum|count)$", "")
    folded = lines.withColumns({"base": base, "suffix": F.regexp_extract("sample", "_(bucket|sum|count)$", 1)}).join(declared, ["doc_id", "base"], "left")
    fold = (F.col("suffix") != "") & (F.col("since") < F.col("line_no")) & ((F.col("type") == "histogram") | ((F.col("type") == "summary") & (F.col("suffix") != "bucket")))
    family = F.when(F.col("meta") != "", F.col("meta")).when(F.col("sample") != "", F.when(F.coalesce(fold, F.lit(False)), F.col("base")).otherwise(F.col("sample")))
    folded = folded.select("doc_id", "line_no", "line", family.alias("family"), (F.col("meta") != "").alias("is_meta"))
    none = folded.groupBy("doc_id").agg(F.count("family").alias("n")).where("n = 0").select("doc_id")
    known = folded.where("family is not null")
    labels = F.regexp_extract_all("line", F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(0))
    pairs = F.transform(F.filter(labels, lambda x: ~x.rlike(r"^(le|quantile)\s*=")), lambda x: F.regexp_replace(F.regexp_replace(x, r'\s*=\s*"', "="), r'"$', ""))
    known = known.withColumn("labels", F.when(~F.col("is_meta"), F.array_join(F.array_sort(pairs), ",")))
    kinds = declared.select("doc_id", F.col("base").alias("family"), "type")
    whole = known.groupBy("doc_id", "family").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_meta"), F.struct("line_no", "line")))).alias("m"), F.array_sort(F.collect_list(F.when(~F.col("is_meta"), F.struct("line_no", "line", "labels")))).alias("s"), F.min("line_no").alias("line_no")
    ).join(kinds, ["doc_id", "family"], "left")
    text = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), "\n")
    body = F.array_join(F.concat(F.transform("m", lambda x: x["line"]), F.transform("s", lambda x: x["line"])), "\n")
    whole = whole.withColumns({"body": body, "meta_text": text(F.col("m")), "sets": F.size(F.array_distinct(F.transform("s", lambda x: x["labels"])))})
    fits = (F.octet_length("body") <= MOST) | ((F.col("sets") <= 1) & F.coalesce(F.col("type").isin("histogram", "summary"), F.lit(False)))
    plain = whole.where(fits).select("doc_id", "line_no", F.lit(0).alias("k"), F.concat(F.lit("metric:"), "family").alias("title"), F.col("body").alias("content"))
    large = whole.where(~fits).select("doc_id", "family", "line_no", "meta_text", "sets", F.explode("s").alias("x"))
    large = large.select("doc_id", "family", "line_no", "meta_text", "sets", F.col("x.line_no").alias("n"), F.col("x.line").alias("line"), F.col("x.labels").alias("labels"))
    sets = large.where("sets > 1").groupBy("doc_id", "family", "line_no", "meta_text", "labels").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("s"), F.min("n").alias("k"))
    full = F.concat(F.lit("metric:"), "family", F.lit(" labels:"), "labels")
    short = F.concat(F.substring(full, 1, TITLE - 9), F.lit("-"), F.substring(F.sha2("labels", 256), 1, 8))
    by_set = sets.select("doc_id", "line_no", "k", F.when(F.length(full) <= TITLE, full).otherwise(short).alias("title"), F.concat_ws("\n", F.nullif("meta_text", F.lit("")), text(F.col("s"))).alias("content"))
    single = large.where("sets <= 1")
    parts = single.groupBy("doc_id", "family", "line_no", "meta_text").agg(F.array_sort(F.collect_list(F.struct("n", (F.octet_length("line") + 1).alias("size"), "line"))).alias("u"))
    parts = parts.withColumn("g", packed_udf(F.col("u.size"), F.octet_length("meta_text"))).select("doc_id", "family", "line_no", "meta_text", F.explode(F.arrays_zip(F.col("u.n").alias("n"), F.col("u.line").alias("line"), F.col("g"))).alias("z"))
    by_part = parts.groupBy("doc_id", "family", "line_no", "meta_text", F.col("z.g").alias("k")).agg(F.array_sort(F.collect_list(F.struct("z.n", "z.line"))).alias("s"))
    by_part = by_part.select("doc_id", "line_no", "k", F.concat(F.lit("metric:"), "family", F.lit(" part:"), (F.col("k") + 1).cast("string")).alias("title"), F.concat_ws("\n", F.nullif("meta_text", F.lit("")), text(F.col("s"))).alias("content"))
    loose = joined(folded.where("family is null").join(none, "doc_id", "left_anti"), ["doc_id"], "line_no", "line", "body").select("doc_id", F.lit(2**30).alias("line_no"), F.posexplode(windows_udf("body")).alias("k", "content"), F.lit("metric:unparsed").alias("title"))
    both = plain.unionByName(by_set).unionByName(by_part).unionByName(loose)
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "k")) - 1
    return both.select("doc_id", part.alias("part"), "title", "content", F.lit("code").alias("content_type")), docs.join(none, "doc_id", "left_semi")


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """Sections under their headings, with the path of headings as title; code blocks are chunks of their own."""
    line = F.col("line")
    lines = lines_of(docs).withColumn("fence", line.rlike(FENCE).cast("int"))
    lines = lines.withColumn("opened", F.sum("fence").over(so_far()))
    fenced = (F.col("opened") % 2 == 1) | (F.col("fence") == 1)
    blank = F.length(trim_blank(line)) == 0
    lines = lines.withColumns({"fenced": fenced, "blank": blank})
    indented = ~F.col("fenced") & line.rlike(r"^(    |\t)") & ~F.col("blank")
    lines = lines.withColumn("indented", indented)
    text_before = F.last(F.when(~F.col("blank"), F.struct(F.col("indented").alias("i"), F.col("line").rlike(LIST).alias("l"))), ignorenulls=True).over(before())
    after_blank = F.coalesce(F.lag("blank").over(by_line()), F.lit(True))
    lines = lines.withColumn("before", text_before).withColumn("code_start", F.col("indented") & after_blank & ~F.coalesce(F.col("before.l"), F.lit(False)))
    run = F.last(F.when(~F.col("blank"), F.when(F.col("code_start"), True).when(~F.col("indented"), False)), ignorenulls=True).over(so_far())
    lines = lines.withColumn("code", F.col("fenced") | (F.col("indented") & F.coalesce(run, F.lit(False))))
    setext = F.lead("line").over(by_line()).rlike(r"^ {0,3}(=+|-+)[ \t]*$") & ~F.lead("fenced").over(by_line()) & ~F.col("blank") & ~line.rlike(LIST) & ~line.rlike(HEADING) & ~line.rlike(r"^\s*[>|]")
    atx = line.rlike(HEADING)
    level = F.when(F.col("code"), None).when(atx, F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})", 1))).when(setext, F.when(F.lead("line").over(by_line()).rlike("="), 1).otherwise(2))
    lines = lines.withColumn("level", level)
    lines = lines.withColumn("head", F.when(F.col("level").isNotNull(), F.when(atx, trim_blank(F.regexp_extract("line", HEADING, 1))).otherwise(trim_blank(line))))
    places = {k: F.last(F.when(F.col("level") == k, F.struct("line_no", "head")), ignorenulls=True).over(so_far()) for k in range(1, 7)}
    lines = lines.withColumns({f"h{k}": p for k, p in places.items()})
    crumbs = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"h{j}.line_no"), F.lit(-1)) for j in range(1, k)]
        fresh = F.col(f"h{k}.line_no") > (reduce(F.greatest, above) if above else F.lit(-1))
        crumbs.append(F.when(fresh, F.col(f"h{k}.head")))
    lines = lines.withColumn("path", F.concat_ws(" > ", *crumbs))
    kind = F.when(F.col("code"), F.when(F.col("fenced"), "fence").otherwise("code")).otherwise("prose")
    lines = lines.withColumn("kind", kind)
    opens = (F.col("fence") == 1) & (F.col("opened") % 2 == 1)
    edge = F.col("level").isNotNull() | opens | ~F.col("kind").eqNullSafe(F.lag("kind").over(by_line()))
    sections = lines.withColumn("section", F.sum(edge.cast("int")).over(so_far()))
    bodies = joined(sections, ["doc_id", "content_type", "section", "kind", "path"], "line_no", "line", "content")
    bodies = bodies.withColumn("content", F.regexp_replace("content", r"\n+$", "")).where(F.length(trim_blank(F.col("content"))) > 0)
    labelled = bodies.join(docs.select("doc_id", "label"), "doc_id")
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1
    title = titled(F.col("path"), titled(F.coalesce("label", F.lit("")), F.lit("section 1")))
    return labelled.select("doc_id", part.alias("part"), title.alias("title"), "content", F.when(F.col("kind") == "prose", F.col("content_type")).otherwise("code").alias("content_type"))


# ---- all formats -------------------------------------------------------------------


def detected(docs: DataFrame) -> DataFrame:
    """Adds the effective format: the hint, else JSON, markdown or text by what the text looks like."""
    body = trim_blank(F.col("text"))
    rows = F.filter(F.transform(F.split("text", "\n"), trim_blank), lambda x: F.length(x) > 0)
    container = F.substring(body, 1, 1).isin("{", "[") & F.expr("try_parse_json(text) is not null") & (F.length(trim_blank(F.expr("substring(trim(text), 2, length(trim(text)) - 2)"))) > 0)
    listed = (F.size(rows) > 1) & F.forall(rows, lambda x: F.substring(x, 1, 1).isin("{", "[") & F.call_function("try_parse_json", x).isNotNull())
    lines = lines_of(docs.withColumn("content_type", F.lit(None).cast("string")))
    fences = lines.withColumn("fence", F.col("line").rlike(FENCE).cast("int")).withColumn("opened", F.sum("fence").over(so_far()))
    outside = (F.col("opened") % 2 == 0) & (F.col("fence") == 0)
    heading = outside & F.col("line").rlike(r"^ {0,3}#{1,6}[ \t]+\S") & ~F.col("line").rlike(METRIC_META)
    signs = fences.groupBy("doc_id").agg(
        F.max(heading.cast("int")).alias("headings"), F.sum("fence").alias("fences"), F.sum((outside & F.col("line").rlike(LIST)).cast("int")).alias("items")
    )
    guess = F.when(container | listed, "json").when((F.col("headings") > 0) | (F.col("fences") > 1) | (F.col("items") > 1), "markdown").otherwise("text")
    known = F.when(F.col("format").isin(*FORMATS), F.col("format")).when(F.length(F.coalesce("format", F.lit(""))) > 0, "text")
    return docs.join(signs, "doc_id", "left").withColumn("effective", F.coalesce(known, guess)).drop("headings", "fences", "items")


def chunks(docs: DataFrame) -> DataFrame:
    """As `all_chunks`: at most 500 chunks of each document."""
    return all_chunks(docs).where(F.col("ordinal") < SOURCE_MOST)


def all_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, title, content, content_type, format): the chunks of each document.

    Blank, null and oversized texts (over 1 MiB) give none; a missing
    content_type is prose; an unknown format is text.
    """
    fit = docs.where((F.octet_length("text") <= BODY_MOST) & (F.length(trim_blank(F.col("text"))) > 0))
    # Detected once and written by format, so that each format's plan reads its own texts only.
    fit = written(detected(fit.select("doc_id", "label", "text", "format", F.coalesce("content_type", F.lit("prose")).alias("content_type"))), "chunk-input", "effective")
    of = lambda *f: fit.where(F.col("effective").isin(*f))
    logs, log_rest = log_chunks(of("log"))
    records, json_rest = json_chunks(of("json"))
    metrics, metric_rest = metric_chunks(of("metrics"))
    columns = ["doc_id", "label", "text", "content_type"]
    plain = of("text").select(columns).unionByName(log_rest.select(columns)).unionByName(json_rest.select(columns)).unionByName(metric_rest.select(columns))
    parts = [text_chunks(plain), logs, records, metrics, trace_chunks(of("stacktrace")), table_chunks(of("csv", "tsv")), markdown_chunks(of("markdown"))]
    every = reduce(DataFrame.unionByName, [p.select(*CHUNK) for p in parts])
    short = every.where(F.octet_length("content") <= MOST).withColumn("piece", F.lit(0))
    long = every.where(F.octet_length("content") > MOST).select("doc_id", "part", "title", "content_type", F.posexplode(bounded_udf("content")).alias("piece", "content"))
    pieces = short.unionByName(long)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "piece"))
    return pieces.withColumn("ordinal", (number - 1).cast("int")).join(fit.select("doc_id", F.col("effective").alias("format")), "doc_id").select("doc_id", "ordinal", "title", "content", "content_type", "format")


def summaries(docs: DataFrame) -> DataFrame:
    """Per document: chunks, those indexed (500 at most), whether the list of 50 is cut, bytes of all chunks and of those indexed, and the first preview.

    A text over 1 MiB is refused: it has a row without a format and without chunks.
    """
    size = F.octet_length("content")
    by = all_chunks(docs).groupBy("doc_id", "format").agg(
        F.count(F.lit(1)).alias("sections_total"), F.least(F.count(F.lit(1)), F.lit(SOURCE_MOST)).alias("sections_indexed"), (F.count(F.lit(1)) > SECTIONS).alias("summary_truncated"),
        F.sum(size).alias("n_bytes"), F.sum(F.when(F.col("ordinal") < SOURCE_MOST, size)).alias("indexed_bytes"), F.min_by(F.substring("content", 1, PREVIEW), "ordinal").alias("preview"),
    ).withColumn("refused", F.lit(False))
    none = {"sections_total": F.lit(0), "sections_indexed": F.lit(0), "summary_truncated": F.lit(False), "n_bytes": F.octet_length("text"), "indexed_bytes": F.lit(0), "refused": F.lit(True)}
    refused = docs.where(F.octet_length("text") > BODY_MOST).select("doc_id", *[none.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in by.schema if f.name != "doc_id"])
    return by.unionByName(refused)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, title, content_type, n_bytes, preview): the first 50 chunks of each document with the first 200 characters of each."""
    first = all_chunks(docs).where(F.col("ordinal") < SECTIONS)
    return first.select("doc_id", "ordinal", "title", "content_type", F.octet_length("content").alias("n_bytes"), F.substring("content", 1, PREVIEW).alias("preview"))
