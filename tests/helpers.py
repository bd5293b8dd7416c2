"""Small builders of log records for tests."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from fleetfold.schemas import LOG

T0 = datetime(2027, 3, 4, 5, 6, 7, tzinfo=timezone.utc)


def at(seconds: float) -> str:
    return (T0 + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def event_id(n: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, str(n)))


def position(vehicle="tram-8", route="ring", lat=-3.25, lon=40.5, ts=None, sequence=77, **more):
    return {"vehicle_id": vehicle, "route_id": route, "lat": lat, "lon": lon, "event_ts": ts or at(0), "sequence": sequence, **more}


def envelope(n=1, payload=None, **header):
    doc = {
        "schema_version": 1, "event_id": event_id(n), "event_type": "vehicle.position", "produced_at": at(1), "source": "test",
        "payload": position() if payload is None else payload,
    }
    doc.update(header)
    return {k: v for k, v in doc.items() if v is not ...}


def text(doc) -> str:
    return doc if isinstance(doc, str) else json.dumps(doc)


def log_of(spark: SparkSession, *values, topic="raw", partition=0, start=0):
    """One record per value: a document, raw text, or (partition, offset, document)."""
    rows = []
    for i, v in enumerate(values):
        part, off, doc = v if isinstance(v, tuple) else (partition, start + i, v)
        body = doc if isinstance(doc, bytes) else text(doc).encode()
        rows.append((b"key", body, topic, part, off, T0, []))
    return spark.createDataFrame(rows, LOG)
