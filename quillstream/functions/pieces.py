"""Small helpers on one text: pieces of bounded size, groups of units, records of JSON."""

from __future__ import annotations

import json

import pandas as pd

# Bytes of a packed chunk and of any chunk, characters of a title; members that name a record.
TARGET, MOST, TITLE = 2048, 4096, 60
TITLE_FIRST = ["name", "title", "message", "msg", "event", "summary"]  # only if they fit a title
TITLE_NEXT = ["id", "*_id", "uuid", "key", "slug", "case", "role", "level", "status", "type"]
TITLE_NEVER = {"task", "dataset", "benchmark", "split", "model", "subject", "service", "logger", "namespace", "version", "env", "timestamp", "ts", "time", "created_at", "updated_at"}


def cut_bytes(text: str, most: int) -> tuple[str, str]:
    """The longest start of at most `most` bytes, and the rest."""
    raw = text.encode()
    if len(raw) <= most:
        return text, ""
    head = raw[:most].decode(errors="ignore") or text[0]
    return head, text[len(head) :]


def windows(text: str) -> list[str]:
    """A paragraph over 4,096 bytes in windows of 2,048, cut at the last line break, else anywhere."""
    out = []
    while len(text.encode()) > MOST:
        head, _ = cut_bytes(text, TARGET)
        at = head.rfind("\n")
        head = head[:at] if at > 0 else head
        text = text[len(head) :].lstrip("\n")
        if head.strip():
            out.append(head.rstrip("\n"))
    return out + [text] if text.strip() else out


def bounded(text: str) -> list[str]:
    """Pieces of at most 4,096 bytes whose concatenation is the text: whole lines as long as they fit."""
    out, held, size = [], "", 0
    for line in text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.rsplit("\n", 1)[-1]]:
        n = len(line.encode())
        if held and size + n > MOST:
            out.append(held)
            held, size = "", 0
        if n > MOST:
            while line:
                head, line = cut_bytes(line, MOST)
                out.append(head)
            continue
        held, size = held + line, size + n
    return out + [held] if held else out


def packed(sizes: list[int], start: int = 0) -> list[int]:
    """Group numbers of units packed in order towards 2,048 bytes; a larger one stands alone."""
    out, group, size, count = [], 0, start, 0
    for n in sizes:
        if count and size + n > TARGET:
            group, size, count = group + 1, start, 0
        out.append(group)
        size, count = size + n, count + 1
    return out


def json_units(text: str) -> tuple[str, list[str], list[str]]:
    """(kind, titles, raw texts) of the records or members of a JSON text; kind `text` if it has none."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) > 1 and all(x[0] in "{[" and _valid(x) for x in lines):
        return "records", [record_title(x, k + 1) for k, x in enumerate(lines)], lines
    whole = text.strip()
    if whole[:1] not in ("{", "[") or not _valid(whole):
        return "text", [], []
    decoder, at, keys, raws = json.JSONDecoder(), 1, [], []
    skip = lambda k: next((i for i in range(k, len(whole)) if whole[i] not in " \t\r\n,:"), len(whole))
    while (at := skip(at)) < len(whole) - 1:
        if whole[0] == "{":
            key, at = decoder.raw_decode(whole, at)
            keys.append(key)
            at = skip(at)
        _, end = decoder.raw_decode(whole, at)
        raws.append(whole[at:end])
        at = end
    if not raws:
        return "text", [], []
    if whole[0] == "[":
        return "records", [record_title(x, k + 1) for k, x in enumerate(raws)], raws
    return "members", [k.strip()[:TITLE] or f"member {n + 1}" for n, k in enumerate(keys)], [f"{json.dumps(k, ensure_ascii=False)}: {r}" for k, r in zip(keys, raws, strict=True)]


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def record_title(record: str, n: int) -> str:
    """The most telling scalar member as `key=value`, else the record's number."""
    value = json.loads(record)
    if not isinstance(value, dict):
        return f"record {n}"
    scalars = {}
    for k, v in value.items():
        if not isinstance(v, (dict, list)):
            scalars[k] = "null" if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else f"{v:.17g}" if isinstance(v, float) and v != float(repr(v)) else repr(v)
    ranked = [(k, False) for w in TITLE_FIRST for k in scalars if k.lower() == w]
    ranked += [(k, True) for w in TITLE_NEXT for k in scalars if k.lower() == w or (w[0] == "*" and k.lower().endswith(w[1:]))]
    for k, long in ranked:
        if long or len(f"{k}={scalars[k]}") <= TITLE:
            return f"{k}={scalars[k]}".strip()[:TITLE] or f"record {n}"
    return next((f"{k}={v}" for k, v in scalars.items() if k.lower() not in TITLE_NEVER and len(f"{k}={v}") <= TITLE), f"record {n}")


def windows_of(texts: pd.Series) -> pd.Series:
    return texts.map(windows)


def bounded_of(texts: pd.Series) -> pd.Series:
    return texts.map(bounded)


def packed_of(sizes: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([packed(list(s), int(a)) for s, a in zip(sizes, starts, strict=True)])


def json_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([json_units(t) for t in texts], columns=["kind", "titles", "raws"])
