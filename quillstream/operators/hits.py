"""Snippets of hits and their selection under a byte budget.

A response has at most ten queries of fifty hits, so a group of `allocate` has
at most 500 rows, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.capture import whole_characters
from quillstream.operators.textindex import FALLBACK_STOP_WORDS

#: Characters of a snippet, weight of relevance against repetition, rows of a response.
SNIPPET, RELEVANCE_WEIGHT, MOST_QUERIES, MOST_HITS = 400, 0.7, 10, 50
#: Bytes of a response by default and at most.
BUDGET_DEFAULT, BUDGET_CEILING = 4096, 65_536
#: Fixed value: bytes of a response's text.
TEXT_MOST = 8192
SENTENCE_ENDS = frozenset(".!?\n")


def _folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def snippet(content: str | None, query: str | None, code: bool, most: int = SNIPPET) -> tuple[str, bool]:
    """The stretch of at most `most` characters with the most query terms, cut at sentences or lines; True if none was found."""
    text = content or ""
    if len(text) <= most:
        return text, False
    terms = list(dict.fromkeys(_folded(t) for t in (re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in (query or "").split()) if t))
    folded = _folded(text)
    sites = sorted((m.start(), k, m.end()) for k, t in enumerate(terms) for m in re.finditer(re.escape(t), folded))
    telling = [s for s in sites if len(terms[s[1]]) > 1 and terms[s[1]] not in FALLBACK_STOP_WORDS]
    sites = telling or sites
    if not sites:
        return _snapped(text, 0, most, code, None), True

    def held(at: int) -> list[tuple[int, int, int]]:
        return [s for s in sites if s[0] >= at and s[2] <= at + most]

    best = _fullest(sites, len(text) - most, most)
    last = len(text) - most
    inside = held(best)
    if not inside:
        return _snapped(text, best, best + most, code, None), False
    low, high = inside[0][0], max(s[2] for s in inside)
    start = min(max(low - (most - (high - low)) // 2, 0), last)
    inside = held(start)
    return _snapped(text, start, start + most, code, (min(s[0] for s in inside), max(s[2] for s in inside))), False


def _fullest(sites: list[tuple[int, int, int]], last: int, most: int) -> int:
    """Where a window of `most` characters that begins at a site (at `last` at the latest) holds the most terms, then sites; the first such place.

    Sites are (start, term, end), by start.  They enter the window by their ends
    and leave it by their starts, each once.
    """
    by_end = sorted(range(len(sites)), key=lambda k: sites[k][2])
    inside, terms = [False] * len(sites), Counter()
    entered = left = n = 0
    best, found = (-1, -1), 0
    for site in sites:
        at = min(site[0], last)
        while left < len(sites) and sites[left][0] < at:
            if inside[left]:
                inside[left] = False
                n -= 1
                terms[sites[left][1]] -= 1
                if not terms[sites[left][1]]:
                    del terms[sites[left][1]]
            left += 1
        while entered < len(sites) and sites[by_end[entered]][2] <= at + most:
            k = by_end[entered]
            if k >= left:
                inside[k] = True
                n += 1
                terms[sites[k][1]] += 1
            entered += 1
        if (len(terms), n) > best:
            best, found = (len(terms), n), at
    return found


def _snapped(text: str, start: int, end: int, code: bool, keep: tuple[int, int] | None) -> str:
    """text[start:end] trimmed to whole lines (code) or sentences, else words; never into what is to be kept."""
    piece = text[start:end]
    left, right = 0, len(piece)
    if code:
        if start and text[start - 1] != "\n":
            left = piece.find("\n") + 1
        right = piece.rfind("\n") + 1 or right
    else:
        if start and text[start - 1] not in SENTENCE_ENDS:
            m = re.search(r"[.!?\n][.!?\n ]*", piece)
            left = m.end() if m else piece.find(" ") + 1
        if end < len(text):
            cut = max(piece.rfind(c, left) for c in SENTENCE_ENDS) + 1
            right = cut or piece.rfind(" ", left) if cut or piece.rfind(" ", left) > left else right
    if keep and left > keep[0] - start:
        left = 0
    if keep and right < keep[1] - start:
        right = len(piece)
    return piece[left:right] if left < right else piece


def _snippets(content: pd.Series, query: pd.Series, cls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([snippet(c, q, k == "code") for c, q, k in zip(content, query, cls, strict=True)], columns=["snippet", "fallback"])


def with_snippets(hits: DataFrame) -> DataFrame:
    """Adds snippet and fallback to rows (content, query, cls)."""

    cut = F.pandas_udf(_snippets, "struct<snippet string, fallback boolean>")
    return hits.withColumn("__cut", cut("content", "query", "cls")).withColumns({"snippet": F.col("__cut.snippet"), "fallback": F.col("__cut.fallback")}).drop("__cut")


# ---- selection under a budget ------------------------------------------------------
# Each takes the sizes, relevances and texts of a response's hits, ordered by (query, rank),
# and gives the places of the chosen hits in the order in which they are taken.

Hits = pd.DataFrame  # qi, rank, size, relevance, snippet


def _fitting(order: list[int], size: list[int], budget: int) -> list[int]:
    """Those in order that still fit; a misfit is passed over."""
    out, left = [], budget
    for k in order:
        if size[k] <= left:
            out.append(k)
            left -= size[k]
    return out


def rank_round(hits: Hits, budget: int) -> list[int]:
    """Every query's first hit before any second one."""
    return _fitting(hits.sort_values(["rank", "qi"], kind="stable").index.tolist(), hits["size"].tolist(), budget)


def _shares(weights: list[float], budget: int) -> list[int]:
    """budget in whole bytes by weight: rounded down, the rest to the largest remainders."""
    total = sum(weights)
    exact = [w / total * budget for w in weights]
    shares = [int(x) for x in exact]
    rest = sorted(range(len(weights)), key=lambda k: (shares[k] - exact[k], k))
    for k in rest[: budget - sum(shares)]:
        shares[k] += 1
    return shares


def equal_budget(hits: Hits, budget: int) -> list[int]:
    """An equal share for each query; the first ones get what is left over, and nothing moves between them."""
    groups = [g.index.tolist() for _, g in hits.groupby("qi", sort=True)]
    share, more = divmod(budget, len(groups))
    return [k for q, g in enumerate(groups) for k in _fitting(g, hits["size"].tolist(), share + (q < more))]


def score_proportional(hits: Hits, budget: int) -> list[int]:
    """Shares by the relevance of each query's first hit, filled up to the first misfit; what is left goes round by rank."""
    size = hits["size"].tolist()
    groups = [g.index.tolist() for _, g in hits.groupby("qi", sort=True)]
    weights = [float(hits.at[g[0], "relevance"]) for g in groups]
    out, rest, used = [], [], 0
    for g, share in zip(groups, _shares(weights if sum(weights) > 0 else [1.0] * len(groups), budget), strict=True):
        fits = bisect_right(list(accumulate(size[k] for k in g)), share)
        out += g[:fits]
        used += sum(size[k] for k in g[:fits])
        rest.append(g[fits:])
    later = [g[r] for r in range(max(map(len, rest))) for g in rest if r < len(g)]
    return out + _fitting(later, size, budget - used)


def knapsack(hits: Hits, budget: int) -> list[int]:
    """The greatest sum of relevance within the budget; of equal sums the one with the earlier hits."""
    import numpy as np

    size, value = hits["size"].tolist(), hits["relevance"].tolist()
    best = np.zeros(max(budget, 0) + 1)
    taken = []
    for s, v in zip(size, value, strict=True):
        row = np.zeros(len(best), bool)
        if s <= budget:
            tried = best[: len(best) - s] + v
            row[s:] = tried > best[s:]
            best[s:] = np.where(row[s:], tried, best[s:])
        taken.append(row)
    out, left = [], max(budget, 0)
    for k in range(len(size) - 1, -1, -1):
        if taken[k][left]:
            out.append(k)
            left -= size[k]
    return out[::-1]


def diverse(hits: Hits, budget: int) -> list[int]:
    """One after the other the hit with the most relevance less its likeness to those taken; a misfit is passed over for good."""
    words = [set(str(t).lower().split()) for t in hits["snippet"]]
    size, value = hits["size"].tolist(), hits["relevance"].tolist()
    open_, likeness, out, left = list(range(len(size))), [0.0] * len(size), [], budget
    while open_:
        k = max(open_, key=lambda i: (RELEVANCE_WEIGHT * value[i] - (1 - RELEVANCE_WEIGHT) * likeness[i], -i))
        open_.remove(k)
        if size[k] > left:
            continue
        out.append(k)
        left -= size[k]
        for i in open_:
            union = len(words[i] | words[k])
            likeness[i] = max(likeness[i], len(words[i] & words[k]) / union if union else 0.0)
    return out


ALLOCATORS: dict[str, Callable[[Hits, int], list[int]]] = {"rank-round": rank_round, "equal-budget": equal_budget, "score-proportional": score_proportional, "knapsack-greedy": knapsack, "mmr": diverse}


def budget(requested: Column | int | None, ceiling: int = BUDGET_CEILING) -> Column:
    """The byte budget of a request: what it asks for, the default if nothing (or nothing above 0), never more than the ceiling (0: none)."""
    asked = F.lit(requested) if requested is None or isinstance(requested, int) else requested
    given = F.when(asked > 0, asked).otherwise(BUDGET_DEFAULT)
    return (F.least(given, F.lit(ceiling)) if ceiling > 0 else given).cast("int")


def allocator(default: str | None, header: str | None, override: bool) -> str:
    """The allocator of a request: the header's if it may override and is known, else the namespace's default if known, else by rank."""
    known = [v for v in ((header if override else None), default) if v in ALLOCATORS]
    return known[0] if known else "rank-round"


def allocate(hits: DataFrame, budget: int | None, variant: str = "rank-round") -> DataFrame:
    """Chosen hits of rows (request_id, qi, rank, id, size, relevance, snippet), with the order in which they were taken.

    budget: bytes of a response; None: each row has those of its request in
    budget_bytes.  Hits beyond ten queries or rank fifty of a request are
    refused by the contract: `refused` gives them, here they are left out.  A
    budget of 0 chooses nothing.
    """
    choose = ALLOCATORS[variant]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["qi", "rank", "id"], kind="stable").reset_index(drop=True)
        picked = choose(rows, int(rows["budget_bytes"].iloc[0]))
        out = rows.loc[picked, ["request_id", "qi", "rank", "id", "size"]]
        return out.assign(taken=range(1, len(picked) + 1))

    own = hits if budget is None else hits.withColumn("budget_bytes", F.lit(budget))
    bounded = own.where(_accepted()).select("request_id", "qi", "rank", "id", "size", "relevance", "snippet", "budget_bytes")
    return bounded.groupBy("request_id").applyInPandas(run, "request_id long, qi int, rank int, id long, size int, taken int")


def _accepted() -> Column:
    return (F.col("qi") < MOST_QUERIES) & (F.col("rank") <= MOST_HITS)


def refused(hits: DataFrame) -> DataFrame:
    """Hits that no allocation takes: those beyond ten queries or rank fifty of a request."""
    return hits.where(~_accepted())


def search_meta(hits: DataFrame, chosen: DataFrame, asked: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row per request of what was delivered: hits by layer, cut snippets without a term, bytes, hits left out and refused, queries without a hit.

    hits: (request_id, query_id, qi, rank, id, size, layer, fallback); chosen:
    rows of `allocate`; asked: (request_id, query_id) of all queries; budgets:
    (request_id, budget_bytes).
    """
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("int")
    told = chosen.select("request_id", "qi", "rank", "id").join(hits, ["request_id", "qi", "rank", "id"])
    shown = told.groupBy("request_id").agg(
        count(F.col("layer") == "primary").alias("hits_primary"), count(F.col("layer") == "trigram").alias("hits_trigram"), F.count(F.lit(1)).cast("int").alias("hit_count"),
        count(F.col("fallback")).alias("snippet_fallbacks"), F.sum("size").cast("int").alias("byte_budget_used"),
    )
    found = hits.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("found"), count(~_accepted()).alias("results_refused"))
    empty = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("zero_match"))
    joined = asked.select("request_id").distinct().join(budgets, "request_id", "left").join(found, "request_id", "left").join(shown, "request_id", "left").join(empty, "request_id", "left")
    names = ["hits_primary", "hits_trigram", "hit_count", "snippet_fallbacks", "byte_budget_used", "found", "results_refused", "zero_match"]
    filled = joined.fillna(0, names).withColumn("budget_bytes", F.coalesce("budget_bytes", F.lit(BUDGET_DEFAULT)))
    left = F.col("found") - F.col("results_refused") - F.col("hit_count")
    return filled.select("request_id", "budget_bytes", *[n for n in names if n != "found"], left.alias("results_omitted"), (left > 0).alias("budget_exceeded"))


# ---- responses as text -------------------------------------------------------------


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def _quoted(c: Column) -> Column:
    for raw, told in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(told))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _in_order(order: Column | str, text: Column | str) -> Column:
    """Texts of a group one after the other; a response has at most ten queries of fifty hits."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "")


def response_texts(hits: DataFrame, asked: DataFrame, most: int = TEXT_MOST) -> DataFrame:
    """(request_id, text, whole_bytes): what a response shows, each query with its hits in order, cut after `most` bytes of whole characters.

    hits: (query_id, rank, title, source, snippet, layer); asked: (request_id,
    query_id, query) of all queries.  Requests without any hit have no text.
    """
    none = F.lit("")
    told = F.concat(F.lit("["), "layer", F.lit("] "), F.coalesce("title", none), F.lit("  ("), F.coalesce("source", none), F.lit(")\n"), F.coalesce("snippet", none), F.lit("\n"))
    shown = hits.withColumn("__told", told).groupBy("query_id").agg(_in_order("rank", "__told").alias("body"), F.count(F.lit(1)).alias("n"))
    each = asked.join(shown, "query_id", "left").fillna({"n": 0, "body": ""})
    head = F.concat(F.lit("\n# "), _quoted(F.coalesce("query", none)), F.lit(" \u2014 "), _counted(F.col("n"), "hit", "hits"), F.lit("\n"), "body")
    by = each.withColumn("__told", head).groupBy("request_id").agg(_in_order("query_id", "__told").alias("body"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_queries"))
    text = F.concat(_counted(F.col("n"), "hit", "hits"), F.lit(" across "), _counted(F.col("n_queries"), "query", "queries"), F.lit(":\n"), "body")
    whole = by.where("n > 0").withColumn("whole", text)
    cut = F.concat(whole_characters(F.substring(F.encode("whole", "UTF-8"), 1, most)), F.lit("\u2026"))
    return whole.select("request_id", F.when(F.octet_length("whole") > most, cut).otherwise(F.col("whole")).alias("text"), F.octet_length("whole").alias("whole_bytes"))


def compact_bytes(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, n_bytes) of each query's hits as plain lines: the query, then source, title, layer and snippet of each."""
    none = F.lit("")
    lines = F.concat(F.lit("\nsource: "), F.coalesce("source", none), F.lit("\ntitle: "), F.coalesce("title", none), F.lit("\nmatch_layer: "), "layer", F.lit("\nsnippet: "), F.coalesce("snippet", none))
    by = hits.groupBy("query_id").agg(F.sum(F.octet_length(lines)).alias("n"))
    size = F.octet_length(F.concat(F.lit("query: "), F.coalesce("query", none))) + F.coalesce("n", F.lit(0))
    return asked.join(by, "query_id", "left").select("query_id", size.cast("long").alias("n_bytes"))
