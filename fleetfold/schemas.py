"""Declared schemas. Nothing is ever inferred from data."""

from __future__ import annotations

LOG = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, "
    "headers ARRAY<STRUCT<key: STRING, value: BINARY>>"
)

HISTORY = (
    "event_id STRING, vehicle_id STRING, route_id STRING, lat DOUBLE, lon DOUBLE, speed_kph FLOAT, "
    "bearing_deg FLOAT, event_ts TIMESTAMP, produced_at TIMESTAMP, ingested_at TIMESTAMP, "
    "partition INT, offset BIGINT, sequence BIGINT"
)

CURRENT = (
    "vehicle_id STRING, route_id STRING, lat DOUBLE, lon DOUBLE, speed_kph FLOAT, bearing_deg FLOAT, "
    "last_event_ts TIMESTAMP, last_event_id STRING, updated_at TIMESTAMP"
)

PROCESSED = "event_id STRING, processed_at TIMESTAMP, consumer_id STRING, partition INT, offset BIGINT"

DEAD_LETTERS = (
    "event_id STRING, raw_payload BINARY, error STRING, reason STRING, attempts INT, "
    "first_failed_at TIMESTAMP, last_failed_at TIMESTAMP, topic STRING, partition INT, offset BIGINT, "
    "state STRING, replayed_at TIMESTAMP"
)

DLQ_ACTIONS = (
    "event_id STRING, action STRING, action_ts TIMESTAMP, action_id STRING, raw_payload BINARY, "
    "error STRING, reason STRING, attempts INT, topic STRING, partition INT, offset BIGINT"
)

# One row per log record that was handled; every other table is a view of it.
LEDGER = (
    "topic STRING, partition INT, offset BIGINT, key BINARY, value BINARY, event_id STRING, "
    "schema_version BIGINT, event_type STRING, produced_at TIMESTAMP, source STRING, "
    "vehicle_id STRING, route_id STRING, lat DOUBLE, lon DOUBLE, speed_kph DOUBLE, bearing_deg DOUBLE, "
    "event_ts TIMESTAMP, sequence DECIMAL(20,0), outcome STRING, reason STRING, error_field STRING, "
    "error STRING, attempts INT, processed_at TIMESTAMP, consumer_id STRING"
)

OUTCOMES = ("applied", "duplicate", "late", "dead")
REASONS = ("decode", "unknown_version", "retries_exhausted", "unknown")


def columns(ddl: str) -> list[str]:
    """Column names of a flat DDL string, in order."""
    names, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            names.append(ddl[start:i].split()[0])
            start = i + 1
    return names
