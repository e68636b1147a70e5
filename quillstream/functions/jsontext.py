"""JSON values kept as text."""

from __future__ import annotations

import json

UNREADABLE = object()


def loads(text: str | None) -> object:
    """The value of a JSON text; a string that holds a JSON object or list counts as what it holds.

    UNREADABLE if the text (or what a string wraps and that begins like an
    object or a list) can't be read; None for null.
    """
    if text is None:
        return None
    try:
        value = json.loads(text)
        while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return UNREADABLE
    return value


def as_list(value: object) -> list:
    """null: nothing; a lone object or string: a list of one."""
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
