"""Reports are numbered and joined once, however often the gap search reads them."""

from fleetfold.plans import geo_queries
from fleetfold.plans import telemetry as t


def test_numbered_reports_are_stored_narrow(spark, monkeypatch):
    kept, keep = [], t.stored
    hist = spark.createDataFrame([("a", "v", 10), ("b", "v", 40), ("c", "w", 50)], "event_id STRING, vehicle_id STRING, sequence LONG")
    events = spark.createDataFrame([(10, 1), (20, 1), (30, 1), (40, 1), (50, 2)], "event_id LONG, user_id LONG")
    monkeypatch.setattr(t, "history", lambda *_: hist)
    monkeypatch.setattr(t, "events", lambda *_: events)
    monkeypatch.setattr(t, "stored", lambda rows, purpose: kept.append(rows.columns) or keep(rows, purpose))
    assert [tuple(r) for r in geo_queries.sequence_gaps(spark, "").collect()] == [("v", 1, 4, 2)]
    assert kept == [["vehicle_id", "event_id", "sequence"]]
