"""Rule chains. A verdict is ``struct<field, reason>`` of the first failing rule, or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfold.functions.fields import is_zero_time
from fleetfold.functions.ids import canonical_uuid

# Fixed values of the wire contract.
SCHEMA_VERSION = 1
KNOWN_EVENT_TYPES = ["vehicle.position"]
MAX_FUTURE_SKEW = "INTERVAL 5 MINUTES"
MAX_BATCH = 500
MAX_BODY_BYTES = 2 << 20


def first_failure(*rules: tuple[Column, str, Column | str]) -> Column:
    """The first rule (condition that fails the row, field, reason) that holds."""
    chain = None
    for failed, field, reason in rules:
        text = F.lit(reason) if isinstance(reason, str) else reason
        verdict = F.struct(F.lit(field).alias("field"), text.alias("reason"))
        chain = F.when(failed, verdict) if chain is None else chain.when(failed, verdict)
    return chain


def number_text(value: Column) -> Column:
    """A number as a person writes it: 95, not 95.0."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def error_field(verdict: Column) -> Column:
    return F.coalesce(verdict["field"], F.lit(""))


def error_text(verdict: Column) -> Column:
    """``field: reason``, or the reason alone when no field is at fault."""
    return F.when(verdict["field"] == "", verdict["reason"]).otherwise(
        F.concat_ws(": ", verdict["field"], verdict["reason"])
    )


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def header_verdict(version: Column, event_id: Column, event_type: Column, produced_at: Column, has_payload: Column) -> Column:
    version = F.coalesce(version, F.lit(0))
    return first_failure(
        (version == 0, "schema_version", "is required"),
        (version != SCHEMA_VERSION, "schema_version", F.concat(version.cast("string"), F.lit(" is not supported"))),
        (_empty(event_id), "event_id", "is required"),
        (canonical_uuid(event_id).isNull(), "event_id", "is not a UUID"),
        (_empty(event_type), "event_type", "is required"),
        (is_zero_time(produced_at), "produced_at", "is required"),
        (~has_payload, "payload", "is required"),
    )


def known_event_type(event_type: Column) -> Column:
    return F.coalesce(event_type.isin(KNOWN_EVENT_TYPES), F.lit(False))


def _position_rules(vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, event_ts):
    outside = lambda v, span: F.concat(number_text(v), F.lit(f" is outside {span}"))
    lat, lon = F.coalesce(lat, F.lit(0.0)), F.coalesce(lon, F.lit(0.0))
    return [
        (_empty(vehicle_id), "vehicle_id", "is required"),
        (_empty(route_id), "route_id", "is required"),
        (F.abs(lat) > 90, "lat", outside(lat, "[-90, 90]")),
        (F.abs(lon) > 180, "lon", outside(lon, "[-180, 180]")),
        (speed_kph < 0, "speed_kph", F.concat(number_text(speed_kph), F.lit(" is negative"))),
        ((bearing_deg < 0) | (bearing_deg >= 360), "bearing_deg", outside(bearing_deg, "[0, 360)")),
        (is_zero_time(event_ts), "event_ts", "is required"),
    ]


def position_verdict(vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, event_ts) -> Column:
    """Rules that hold whatever the clock says."""
    return first_failure(*_position_rules(vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, event_ts))


def clock_verdict(event_ts: Column, now: Column) -> Column:
    """Only the future is bounded: late reports are kept, early ones would freeze the state."""
    return first_failure(
        (event_ts > now + F.expr(MAX_FUTURE_SKEW), "event_ts", "is more than 5 minutes in the future"),
    )


def frame_verdict(event_id: Column, vehicle_id: Column, event_ts: Column) -> Column:
    return first_failure(
        (_empty(event_id), "event_id", "is required"),
        (_empty(vehicle_id), "vehicle_id", "is required"),
        (is_zero_time(event_ts), "event_ts", "is required"),
    )


def unstorable_text(*texts: Column) -> Column:
    """A NUL character, which a text column cannot hold."""
    return F.coalesce(F.contains(F.concat_ws("", *texts), F.lit("\u0000")), F.lit(False))
