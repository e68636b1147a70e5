"""Sizes and forms of JSON on the wire, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_json(text: Column) -> Column:
    """A JSON text without the blanks between its tokens."""
    return F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s++', "$1")  # possessive: long strings need no stack


def escaped_extra(text: Column) -> Column:
    """Bytes that a writer adds which escapes <, > and & (6 bytes for 1) and the two line separators (6 for 3)."""
    html = F.length(text) - F.length(F.translate(text, "<>&", ""))
    lines = F.length(text) - F.length(F.translate(text, "  ", ""))
    return html * 5 + lines * 3


def json_string_size(text: Column) -> Column:
    """Bytes of a string as a JSON string, quotes included."""
    two = F.length(text) - F.length(F.regexp_replace(text, r'["\\\n\r\t\x08\x0c]', ""))
    six = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.octet_length(text) + 2 + two + six * 5 + escaped_extra(text)


def event_wire_size(id_: Column, type_: Column, priority: Column, data: Column, created_at: Column) -> Column:
    """Bytes of {"id","type","priority","data","created_at"} in compact JSON; missing data counts as {}.

    The time is written with as many fraction digits as it needs and a Z; a
    missing priority counts as 0 and a missing time as the year 1.
    """
    body = compact_json(F.when(F.coalesce(F.length(data), F.lit(0)) == 0, "{}").otherwise(data))
    stamp = F.regexp_replace(F.regexp_replace(F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
    time_size = F.coalesce(F.octet_length(stamp), F.lit(19)) + 1 + 2
    fixed = len('{"id":,"type":,"priority":,"data":,"created_at":}')
    return (
        F.lit(fixed) + F.octet_length(id_.cast("string")) + json_string_size(F.coalesce(type_, F.lit("")))
        + F.octet_length(F.coalesce(priority, F.lit(0)).cast("string")) + F.octet_length(body) + escaped_extra(body) + time_size
    )


def hit_wire_size(title: Column, snippet: Column, source: Column, layer: Column) -> Column:
    """Bytes of {"title","snippet","source","match_layer"} in compact JSON."""
    fixed = len('{"title":,"snippet":,"source":,"match_layer":}')
    return F.lit(fixed) + json_string_size(title) + json_string_size(snippet) + json_string_size(source) + json_string_size(layer)
