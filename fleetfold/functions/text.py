"""Small text, number and colour expressions used by listings and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    """UTC, whole seconds. The session zone is UTC (see ``session.build_session``)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_micros(ts: Column) -> Column:
    """UTC with the fraction kept; the form written to the wire."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def origin_label(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws("/", topic, partition.cast("string"), offset.cast("string"))


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, with an ellipsis when something was cut."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, limit).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def error_headline(error: Column, limit: int = 60) -> Column:
    """First line of an error, bounded for a listing."""
    return truncate_bytes(F.substring_index(error, "\n", 1), limit)


def payload_contains(payload: Column, needle: str) -> Column:
    """Byte-safe search: a payload need not be valid text."""
    return F.contains(payload, F.lit(needle.encode()))


def readable_payload(payload: Column) -> Column:
    """The document re-rendered in one normal form when the bytes are JSON, else the bytes as text."""
    text = payload.cast("string")
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def speed_band(kph: Column) -> Column:
    """Cool-to-warm colour of a speed; grey when there is none.

    Fixed values: grey #64748b; hue 200 at rest to 0 at 80 km/h; lightness 52 to 62; saturation 85.
    """
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), kph / 80.0))
    hue = F.floor(200.0 - 200.0 * t + 0.5).cast("bigint").cast("string")
    light = F.floor(52.0 + 10.0 * t + 0.5).cast("bigint").cast("string")
    hsl = F.concat(F.lit("hsl("), hue, F.lit(" 85% "), light, F.lit("%)"))
    return F.when(kph.isNull(), F.lit("#64748b")).otherwise(hsl)


def round_tenth(value: Column) -> Column:
    """One decimal, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 10.0 + 0.5) / 10.0


def rate_tenth(value: Column) -> Column:
    """One decimal of a non-negative rate, halves up."""
    return F.floor(value * 10.0 + 0.5) / 10.0


def sequence_to_long(sequence: Column) -> Column:
    """A 64-bit unsigned counter as the signed column stores it; the upper half wraps negative."""
    wrap = F.lit("18446744073709551616").cast("decimal(21,0)")
    half = F.lit("9223372036854775807").cast("decimal(20,0)")
    return F.when(sequence > half, (sequence - wrap).cast("bigint")).otherwise(sequence.cast("bigint"))


def stored_sequence(sequence: Column) -> Column:
    """How a stored counter is read back: absent or negative is 0."""
    return F.greatest(F.coalesce(sequence, F.lit(0)), F.lit(0)).cast("bigint")
