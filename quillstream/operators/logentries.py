"""Log lines of many programs into entries with time, level, component and message.

Three weighted context-free grammars describe a stream, and the parse with the
highest score counts:

* `LINES`, over the token classes of a line: headers with their fields, rows of
  key=value pairs, lines of other things (listings, tables, histories) and
  continuations;
* `OBJECTS`, over the tokens of a JSON object, whole or cut off, on one line or
  over several;
* `STREAM`, over the kinds of a stream's lines: an entry is a header with its
  continuations.  It is right-linear, so its best parse is found from left to
  right with the best score of each open symbol.

The first two are parsed by Earley's method (`earley`), whose shared prefixes
make a line cost no more than its header, however long it is.  What no rule
takes for an entry comes out as an unparsed span.  Every stream of every row is
parsed on its own inside `mapInArrow`; nothing is shuffled.
"""

from __future__ import annotations

import calendar
import datetime as dt
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.operators.earley import Grammar, Prefix

# Spellings of levels.
LEVELS = {
    "trace": "trace", "trc": "trace", "trac": "trace", "verbose": "trace", "finest": "trace",
    "debug": "debug", "dbg": "debug", "dbug": "debug", "db": "debug", "fine": "debug",
    "info": "info", "inf": "info", "ii": "info", "information": "info", "notice": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "ww": "warn",
    "error": "error", "err": "error", "ee": "error", "eror": "error", "severe": "error",
    "fatal": "fatal", "ftl": "fatal", "critical": "fatal", "crit": "fatal", "crt": "fatal", "panic": "fatal", "pnc": "fatal",
    "emerg": "fatal", "emergency": "fatal", "alert": "fatal", "ff": "fatal", "cc": "fatal", "pp": "fatal",
    "tt": "trace", "tr": "trace", "dd": "debug",
}
LEVEL_LETTERS = {"T": "trace", "V": "trace", "D": "debug", "I": "info", "N": "info", "W": "warn", "E": "error", "F": "fatal", "C": "fatal", "P": "fatal"}
# Numeric levels, in tens.
LEVEL_NUMBERS = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}
MONTHS = {m: k + 1 for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
TIME_KEYS = ("time", "ts", "timestamp", "@timestamp", "t", "at", "datetime")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "levelname")
COMPONENT_KEYS = ("component", "logger", "name", "module", "service", "app", "caller", "source")
MESSAGE_KEYS = ("message", "msg", "event", "text")

ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)")
LEXER = re.compile(
    r"""(?P<ISO>\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z|[+-]\d\d:?\d\d(?!\d))?(?![\d:]))
    |(?P<SLASH>\d{4}/\d\d/\d\d[ ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?![\d:]))
    |(?P<MON>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ ]{1,2}\d{1,2}[ ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?![\d:]))
    |(?P<GLOG>[A-Z]\d{4}[ ]\d\d:\d\d:\d\d\.\d{1,9}(?![\d:]))
    |(?P<EPOCH>\[\s*\d{9,10}\.\d{1,9}\])
    |(?P<CLOCK>\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?![\d:]))
    |(?P<MODE>[-dlbcps](?:[r-][w-][xsStT-]){3}[+@.]?(?=\s))
    |(?P<TAG>\([A-Za-z?!*]{2}\))
    |(?P<RULE>-{3,}|={3,})
    |(?P<ARROW>==>|<==)
    |(?P<KEY>[A-Za-z_@][\w.@-]*(?==))
    |(?P<STR>"(?:[^"\\]|\\.)*")
    |(?P<FILE>[\w./-]*[\w-]\.[A-Za-z]{1,5}(?=:\d))
    |(?P<HEX>[0-9a-f]{40}\b)
    |(?P<BLOB>[A-Za-z0-9+/=]{60,})
    |(?P<NUM>\d+(?![\w.]))
    |(?P<WORD>[A-Za-z_][\w.$/-]*|\d[\w.%-]*)
    |(?P<WS>[ \t]+)
    |(?P<PUNCT>.)""",
    re.VERBOSE | re.DOTALL,
)

LINES = Grammar(
    "Line",
    [
        # A line is the head of an entry, a line of something else, or a continuation.
        ("Line", "Head", 0), ("Line", "Head REST", 0), ("Line", "Other", 0), ("Line", "REST", -6),
        # Fields.
        ("Time", "ISO", 0), ("Time", "SLASH", 0), ("Time", "MON", 0), ("Time", "GLOG", 0), ("Time", "EPOCH", 0), ("Time", "CLOCK", 0),
        ("Day", "ISO", 0), ("Day", "SLASH", 0), ("Day", "MON", 0), ("Day", "CLOCK", 0),
        ("Level", "LEVEL", 0), ("Level", "[ LEVEL ]", 0), ("Mark", "TAG", 0),
        ("Name", "WORD", 0), ("Name", "FILE", 0), ("Name", "LEVEL", -3), ("Component", "Name", 0),
        ("Worker", "WORD WS NUM", 0), ("Worker", "WORD", -1), ("Worker", "WORD NUM", 0),
        # Heads. 2026-01-02 03:04:05,678 - logger - LEVEL - message
        ("Head", "Day WS - WS Component WS - WS Level WS -", 10),
        # I0102 03:04:05.678901 4321 file.go:12] message
        ("GlogTime", "GLOG", 0), ("Head", "GlogTime WS NUM WS Component : NUM ]", 10), ("Head", "GlogTime WS Component : NUM ]", 9),
        # [rank 2] time LEVEL message
        ("Bracketed", "[ Worker ]", 0), ("Component", "Worker", -1),
        ("Head", "[ Component ] WS Day", 8), ("Head", "[ Component ] WS Day WS Level", 10), ("Head", "[ Component ] WS Day WS Level :", 10),
        # time LEVEL pid --- [thread] logger : message
        ("Thread", "[ Any ]", 0), ("Any", "WORD", 0), ("Any", "NUM", 0), ("Any", "Any WORD", 0), ("Any", "Any -", 0), ("Any", "Any WS", 0), ("Any", "Any NUM", 0), ("Any", "FILE", 0), ("Any", "LEVEL", 0),
        ("Head", "Day WS Level WS NUM WS RULE WS Thread WS Component WS :", 12), ("Head", "Day WS Level WS NUM WS RULE WS Thread WS Component :", 12),
        # key=value pairs and words, one of the pairs the time
        ("Pair", "KEY = Value", 0.1), ("Pair", "TKEY = Value", 0.1), ("Pair", "KEY =", -1), ("Value", "SOLID", 0), ("Value", "Value SOLID", 0),
        ("TimePair", "TKEY = ISO", 8), ("TimePair", "TKEY = STR", 8), ("TimePair", "TKEY = NUM", 8), ("TimePair", "TKEY = WORD", 8),
        ("Pairs", "Pair", 0), ("Pairs", "Pairs WS Pair", 0), ("Pairs", "Pairs WS Value", 0),
        ("Timed", "TimePair", 0), ("Timed", "Pairs WS TimePair", 0), ("Timed", "Timed WS Pair", 0), ("Timed", "Timed WS Value", 0), ("Head", "Timed", 0),
        # Jan 2 03:04:05 host program[123]: level: message
        ("Host", "WORD", 0), ("Process", "[ NUM ]", 0),
        ("Head", "MonTime WS Host WS Component Process :", 10), ("Head", "MonTime WS Host WS Component :", 7), ("MonTime", "MON", 0), ("MonTime", "ISO", -1),
        ("Head", "MonTime WS Host WS Component Process : WS Level :", 13), ("Head", "MonTime WS Host WS Component : WS Level :", 9),
        # [epoch] (II) component: message
        ("EpochTime", "EPOCH", 0), ("Head", "EpochTime WS Mark WS Component :", 10), ("Head", "EpochTime WS Mark", 6), ("Head", "EpochTime WS Level WS Component :", 9),
        # 2026/01/02 03:04:05 file.go:12: message
        ("Head", "Day WS Component : NUM :", 9), ("Head", "Day WS Level WS Component : NUM :", 11),
        # service-1 | time LEVEL message
        ("Bar", "WS | WS", 0), ("Bar", "| WS", 0),
        ("Head", "Component Bar Day", 8), ("Head", "Component Bar Day WS Level", 10),
        # time LEVEL [component] message; time LEVEL component: message; [time] LEVEL ...
        ("Head", "Day WS Level WS [ Component ]", 10), ("Head", "Day WS Level WS Component :", 8), ("Head", "Day WS Level", 5), ("Head", "Day WS Level :", 6),
        ("Head", "Day WS [ Component ] WS Level", 9), ("Head", "Day WS [ Component ]", 5), ("Head", "Day WS Component : WS Level :", 6), ("Head", "Day WS Component :", 3), ("Head", "Day WS", 1),
        ("Head", "[ Day ] WS Level WS Component :", 8), ("Head", "[ Day ] WS Level", 6), ("Head", "[ Day ] WS", 2), ("Head", "LEVEL WS Day WS Component :", 6), ("Head", "Level : WS Day WS", 3),
        # Lines of other things: listings, tables, test results, search hits, histories, headings of tools.
        ("Other", "MODE REST", 12), ("Other", "ISO , REST", 12), ("Other", "Cells", 2), ("Cells", "WORD , WORD", 0), ("Cells", "Cells , WORD", 3), ("Cells", "Cells , NUM", 3), ("Cells", "NUM , NUM", 0),
        ("Other", "FILE : NUM : REST", 6), ("Other", "OK WS REST", 6), ("Other", "COMMIT WS HEX", 12), ("Other", "COMMIT WS REST", 2), ("Other", "AUTHOR : REST", 6), ("Other", "DATE : REST", 6),
        ("Other", "ARROW WS REST", 6), ("Other", "$ WS REST", 6), ("Other", "BLOB", 6), ("Other", "BLOB REST", 5), ("Other", "TOTAL WS NUM", 6),
    ],
)
FIELDS = frozenset(["Time", "Day", "GlogTime", "MonTime", "EpochTime", "Level", "Mark", "Component", "Timed"])
PAIRS = frozenset(["Pair", "TimePair"])
WORD_CLASSES = {"ok": "OK", "FAIL": "OK", "commit": "COMMIT", "Author": "AUTHOR", "Date": "DATE", "total": "TOTAL"}


OBJECTS = Grammar(
    "Entry",
    [
        ("Entry", "Object", 2), ("Entry", "Object REST", 1),
        ("Entry", "{ Members REST", 0), ("Entry", "{ REST", -1),  # cut off
        ("Object", "{ Members }", 0), ("Object", "{ }", 0), ("Members", "Member", 0), ("Members", "Members , Member", 0), ("Member", "STR : Value", 0.1),
        ("Value", "STR", 0), ("Value", "NUM", 0), ("Value", "NAME", 0), ("Value", "Object", 0), ("Value", "List", 0),
        ("List", "[ ]", 0), ("List", "[ Items ]", 0), ("Items", "Value", 0), ("Items", "Items , Value", 0),
    ],
)
MEMBERS = frozenset(["Member"])
OBJECT_LEXER = re.compile(r'(?P<STR>"(?:[^"\\]|\\.)*")|(?P<NUM>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<NAME>true|false|null)|(?P<WS>\s+)|(?P<PUNCT>.)', re.DOTALL)

#: Kinds of lines by the open symbol of a stream: the symbol that goes on, and the weight.  A rule reads `symbol -> kind next`.
STREAM: dict[str, list[tuple[str, str, float]]] = {
    "Outside": [("head", "Entry", 1), ("other", "Loose", 0), ("more", "Loose", -1), ("blank", "Outside", 0)],
    "Entry": [("head", "Entry", 1), ("other", "Loose", 0), ("more", "Entry", 0), ("more", "Loose", -1), ("blank", "Entry", 0)],
    "Loose": [("head", "Entry", 1), ("other", "Loose", 0), ("more", "Loose", -1), ("blank", "Outside", 0)],
}


def line_tokens(line: str) -> Iterator[tuple[str, int, int]]:
    """Tokens (class, start, end) of a line."""
    first = True
    for m in LEXER.finditer(line):
        kind, text = m.lastgroup, m.group()
        if kind == "WORD":
            if text.lower() in LEVELS and (text.isupper() or text.islower()):
                kind = "LEVEL"
            elif first:
                kind = WORD_CLASSES.get(text, kind)
        elif kind == "PUNCT":
            kind = text
        elif kind == "KEY" and text.lower() in TIME_KEYS:
            kind = "TKEY"
        yield kind, m.start(), m.end()
        first = False


def object_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Tokens of JSON without its blanks."""
    for m in OBJECT_LEXER.finditer(text):
        if m.lastgroup != "WS":
            yield m.group() if m.lastgroup == "PUNCT" else m.lastgroup, m.start(), m.end()


def parsed(grammar: Grammar, tokens: Iterator[tuple[str, int, int]]) -> tuple[Prefix, bool, list[tuple[int, int]]]:
    """The last prefix of a text that a rule waits for, whether the text ends there, and the places of its tokens."""
    at, places = grammar.begin(), []
    for kind, start, end in tokens:
        following = grammar.step(at, kind)
        if following is None:
            return at, False, places
        places.append((start, end))
        at = following
    return at, True, places


def line_parse(line: str) -> tuple[str, float, dict[str, tuple[int, int]], int, list[tuple[int, int, int, int]]]:
    """Kind (`head`, `other`, `more`), score, character spans of the fields, end of the head, and spans of keys and values."""
    if not line or line[0] in " \t{}":
        return "more", 0.0, {}, 0, []
    at, ended, places = parsed(LINES, line_tokens(line))
    known = at.known.get(ended)
    if known is None:
        known = at.known[ended] = _line_facts(at.best(ended))
    kind, score, spans, end, pairs = known
    fields = {name: (places[i][0], places[j - 1][1]) for name, (i, j) in spans.items()}
    return kind, score, fields, places[end - 1][1] if end else 0, [(*places[i], places[i + 2][0], places[j - 1][1]) if j > i + 2 else (*places[i], 0, 0) for i, j in pairs]


def _line_facts(best: tuple | None) -> tuple:
    if best is None or not best[1][3]:
        return "more", best[0] if best else 0.0, {}, 0, []
    score, tree = best
    top = tree[3][0]
    if LINES.rules[top[0]][0] == "Other":
        return "other", score, {}, 0, []
    spans = LINES.spans(top, FIELDS)
    return "head", score, spans, top[2], [sub[1:3] for sub in LINES.subtrees(top, PAIRS)] if "Timed" in spans else []


ISO_PARTS = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?")
CLOCK_PARTS = re.compile(r"(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?")


def _millis(fraction: str | None) -> int:
    return int((fraction or "0")[:3].ljust(3, "0"))


def _utc(year: int, month: int, day: int, hour: int, minute: int, second: int, millis: int) -> int | None:
    if not (1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1] and hour < 24 and minute < 60 and second < 61):
        return None
    return calendar.timegm((year, month, day, hour, minute, second)) * 1000 + millis


def time_ms(text: str, observed: dt.datetime | None) -> int | None:
    """Milliseconds since 1970 UTC of a stated time; what it lacks comes from `observed`."""
    text = text.strip().strip('"')
    if m := ISO_PARTS.match(text):
        ms = _utc(*map(int, m.groups()[:6]), _millis(m[7])) if int(m[1]) else None
        if ms is not None and m[8] and m[8] != "Z":
            ms -= (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 60 + int(m[8][-2:])) * 60_000
        return ms
    number = text.strip("[] ")
    if re.fullmatch(r"\d{9,19}(\.\d+)?", number):
        whole, _, fraction = number.partition(".")
        if len(whole) <= 10:
            return int(whole) * 1000 + _millis(fraction)
        return int(whole) // 10 ** max(0, len(whole) - 13)
    if observed is None:
        return None
    if m := CLOCK_PARTS.match(text):
        return _utc(observed.year, observed.month, observed.day, *map(int, m.groups()[:3]), _millis(m[4]))
    if text[:3] in MONTHS and (m := re.match(r"(\w{3}) +(\d+) (.*)", text)) and (c := CLOCK_PARTS.match(m[3])):
        return _utc(observed.year, MONTHS[m[1]], int(m[2]), *map(int, c.groups()[:3]), _millis(c[4]))
    if m := re.match(r"[A-Z](\d\d)(\d\d) (.*)", text):
        c = CLOCK_PARTS.match(m[3])
        return _utc(observed.year, int(m[1]), int(m[2]), *map(int, c.groups()[:3]), _millis(c[4]))
    return None


def level_of(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, (int, float)) or re.fullmatch(r"\d+", str(value)):
        return LEVEL_NUMBERS.get(int(value) // 10 * 10, "")
    return LEVELS.get(str(value).strip("[]() :").lower(), "")


def _first(values: dict, keys: tuple[str, ...]) -> object:
    return next((values[k] for k in keys if values.get(k) is not None), None)


def _unquoted(text: str) -> str:
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return str(json.loads(text))
        except ValueError:
            return text[1:-1]
    return text


def json_fields(text: str) -> tuple[dict, float] | None:
    """Members of a JSON object that is a log entry and its score; of one that was cut off, those that can be read."""
    at, ended, places = parsed(OBJECTS, object_tokens(text))
    known = at.known.get(ended)
    if known is None:
        best = at.best(ended)
        known = at.known[ended] = (best[0], [(sub[1], sub[2]) for sub in OBJECTS.subtrees(best[1], MEMBERS)]) if best else (0.0, [])
    values: dict = {}
    for i, j in known[1]:
        key = text[places[i][0] : places[i][1]]
        values[_unquoted(key) if "\\" in key else key[1:-1]] = text[places[i + 2][0] : places[j - 1][1]]
    if all(values.get(k, "null") == "null" for k in TIME_KEYS):
        return None
    return {k: _value(values[k]) for k in (*TIME_KEYS, *LEVEL_KEYS, *COMPONENT_KEYS, *MESSAGE_KEYS) if k in values}, known[0]


def _value(text: str) -> object:
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return text


def _fields(values: dict, observed: dt.datetime | None) -> tuple[int | None, str, str, str]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return time_ms(str(_first(values, TIME_KEYS)), observed), level_of(_first(values, LEVEL_KEYS)), text(_first(values, COMPONENT_KEYS)), text(_first(values, MESSAGE_KEYS))


def _head(line: str, observed: dt.datetime | None) -> tuple[str, float, tuple | None]:
    kind, score, at, end, pairs = line_parse(line)
    if kind != "head":
        return kind, score, None
    cut = lambda name: line[at[name][0] : at[name][1]] if name in at else ""
    if "Timed" in at:
        values: dict = {}
        for key_start, key_end, start, stop in pairs:
            values.setdefault(line[key_start:key_end].lower(), _unquoted(line[start:stop]))
        fields = _fields(values, observed)
    else:
        stated = next(cut(n) for n in ("Day", "GlogTime", "MonTime", "EpochTime", "Time") if n in at)
        level = LEVEL_LETTERS.get(stated[0], "") if "GlogTime" in at else level_of(cut("Level") or cut("Mark"))
        fields = (time_ms(stated, observed), level, cut("Component"), line[end:].strip())
    return ("more", score, None) if fields[0] is None and observed is not None else ("head", score, fields)


def read_lines(lines: list[str], observed: dt.datetime | None) -> Iterator[tuple[str, int, int, float, tuple | None]]:
    """(kind, first line, lines, score, fields) of the units of a stream: a JSON object over several lines is one."""
    n, i = len(lines), 0
    while i < n:
        line = lines[i]
        size, fields, score, kind = 1, None, 0.0, "more" if line.strip() else "blank"
        if line.startswith("{"):
            if line.rstrip() == "{":
                while i + size < n and lines[i + size - 1].rstrip() not in ("}", "},") and (not lines[i + size] or lines[i + size][0] in ' \t}"'):
                    size += 1
                while size > 1 and not lines[i + size - 1].strip():
                    size -= 1
            found = json_fields("\n".join(lines[i : i + size]))
            if found:
                kind, score, fields = "head", found[1], _fields(found[0], observed)
            else:
                size = 1
        elif kind == "more":
            kind, score, fields = _head(line, observed)
        yield kind, i, size, score, fields
        i += size


def symbols(kinds: list[str]) -> list[str]:
    """The symbols of the best parse of a stream's lines by `STREAM`, after each line."""
    best: dict[str, float] = {"Outside": 0.0}
    steps: list[dict[str, str]] = []
    for kind in kinds:
        following: dict[str, float] = {}
        came: dict[str, str] = {}
        for symbol, score in best.items():
            for taken, nxt, weight in STREAM[symbol]:
                if taken == kind and (nxt not in following or score + weight > following[nxt]):
                    following[nxt], came[nxt] = score + weight, symbol
        best = following
        steps.append(came)
    at, out = max(best, key=best.get), []
    for came in reversed(steps):
        out.append(at)
        at = came[at]
    return out[::-1]


def entries(text: str | None, observed: dt.datetime | None) -> Iterator[tuple]:
    """(kind, first line, last line, ts_ms, level, component, message, score) of a stream, in order.

    kind is `entry`, or `unparsed` for a run of non-blank lines that belong to none.
    """
    lines = [ANSI.sub("", x).rstrip("\r") for x in (text or "").split("\n")]
    units = list(read_lines(lines, observed))
    held: list | None = None  # the entry that is open: first line, last line, fields, score, more lines of its message
    loose: list[int] | None = None  # the unparsed run that is open: first and last line

    def closed() -> Iterator[tuple]:
        nonlocal held, loose
        if held:
            first, last, (ms, level, component, message), score, more = held
            yield "entry", first, last, ms, level, component, "\n".join([message, *more]).rstrip(), score
        if loose:
            yield "unparsed", loose[0], loose[1], None, "", "", "", 0.0
        held = loose = None

    for (kind, i, size, score, fields), symbol in zip(units, symbols([u[0] for u in units]), strict=True):
        if symbol == "Entry" and kind == "head":
            yield from closed()
            held = [i + 1, i + size, fields, score, []]
        elif symbol == "Entry":
            held[4].append(lines[i])
            if kind != "blank":
                held[1] = i + 1
        elif symbol == "Loose":
            if held:
                yield from closed()
            loose = [loose[0] if loose else i + 1, i + 1]
        else:
            yield from closed()
    yield from closed()


SCHEMA = "event_id long, stream string, kind string, first_line int, last_line int, ts_ms long, level string, component string, message string, score double"


def parsed_streams(observed: DataFrame, streams: tuple[str, ...] = ("stdout", "stderr")) -> DataFrame:
    """Entries and unparsed spans of the text columns `streams` of rows (event_id, observed_at, ...).

    Null and blank streams give no rows.  A stated time without a date needs
    observed_at: where that is null, ts_ms is null.  Repeated rows are parsed
    each.  Other columns of the input don't matter.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("event_id", pa.int64()), ("stream", pa.string()), ("kind", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("ts_ms", pa.int64()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("score", pa.float64())])
        for batch in batches:
            rows = []
            times = batch.column("observed_at").to_pylist()
            for stream in streams:
                for event, at, text in zip(batch.column("event_id").to_pylist(), times, batch.column(stream).to_pylist(), strict=True):
                    rows.extend((event, stream, *entry) for entry in entries(text, at))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), out.types, strict=True)] if rows else [pa.array([], t) for t in out.types], schema=out)

    return observed.select("event_id", "observed_at", *streams).mapInArrow(parse, SCHEMA)


def log_entries(observed: DataFrame) -> DataFrame:
    return parsed_streams(observed).where("kind = 'entry'").drop("kind")


def unparsed_spans(observed: DataFrame) -> DataFrame:
    return parsed_streams(observed).where("kind = 'unparsed'").select("event_id", "stream", "first_line", "last_line")
