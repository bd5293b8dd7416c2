"""Records in the producers' form are read by one parse; what comes out must be what the exact look gives."""

import re

from pyspark.sql import functions as F

from fleetfold.functions.ids import dashed
from fleetfold.operators.envelope import PRODUCED_FORM, judge, judge_exactly
from fleetfold.plans import telemetry as t
from tests.helpers import log_of

WHOLE = (
    '{"schema_version":1,"event_id":"0f397628-915d-4017-804c-d7d748afb01a","event_type":"vehicle.position","produced_at":"2024-01-01T00:00:00.5Z","source":"s",'
    '"payload":{"vehicle_id":"v","route_id":"r","lat":1.5,"lon":-2,"speed_kph":0.25,"bearing_deg":359.9,"event_ts":"2024-02-29T23:59:59.123456Z","sequence":7}}'
)
# Values that a rule has to judge, in records of the form.
FORMED = [
    ("1.5", "91.5"), ("1.5", "-90.1"), ("1.5", "1e9"), ("1.5", "-0.0"), (":-2", ":180.1"), ("0.25", "-1"), ("359.9", "360"), ("359.9", "-1e1"),
    ('"speed_kph":0.25,', ""), ('"bearing_deg":359.9,', ""), ("2024-02-29", "2023-02-29"), ("2024-02-29", "0001-01-01"), ("2024-01-01", "2024-13-01"), ("29T23:59:59.123456", "29T23:59:59"),
    ("2024-01-01T00:00:00.5Z", "0001-01-01T00:00:00Z"), ("2024-01-01", "2024-02-30"), ('ence":7', 'ence":0'), ('ence":7', 'ence":999999999999999999'), ('"v"', '" "'), ('"v"', '"%s"' % ("v" * 1000)),
]
OTHER = [
    ("0f39", "0F39"), ('"v"', '""'), ('"v"', '"é"'), ('"v"', r'"\u0000"'), ('"v"', '"%s"' % ("v" * 1001)), ("vehicle.position", "vehicle.door"), ("n\":1", 'n":2'), ("n\":1", 'n":1.0'),
    (".5Z", ".5+01:00"), (".5Z", ".1234567Z"), ("T00", "T24"), ('ence":7', 'ence":-1'), ('ence":7', 'ence":07'), ('ence":7', 'ence":18446744073709551615'), ("}}", "}} "), ("}}", '},"x":1}'),
    ('"lat":1.5,', ""), ('"lat":1.5', '"lat":1.5,"lat":2'), ('"lat":1.5', '"lat":null'), ('"lat":1.5', '"lat":"1.5"'), (WHOLE, "{this is not valid json"), (WHOLE, ""),
]


def test_what_the_form_matches():
    form = PRODUCED_FORM.replace(r"\z", r"\Z")
    assert all(re.search(form, WHOLE.replace(*c)) for c in FORMED + [("", "")])
    assert not [c for c in OTHER if re.search(form, WHOLE.replace(*c))]


def test_both_ways_to_judge_agree(spark):
    log = log_of(spark, WHOLE, *[WHOLE.replace(*c) for c in FORMED + OTHER])
    log = log.unionByName(log.limit(1).withColumns({"value": F.lit(None).cast("binary"), "offset": F.lit(1000).cast("bigint")}))
    new, old = judge(log), judge_exactly(log)
    assert new.schema == old.schema
    new, old = (x.withColumns({n: F.col(n).cast("string") for n in ("produced_at", "event_ts")}) for x in (new, old))
    rows = old.orderBy("offset").collect()
    assert new.orderBy("offset").collect() == rows
    assert rows[0]["reason"] is None and len(rows) == len(FORMED) + len(OTHER) + 2 and {"decode", "unknown_version", None} == {r["reason"] for r in rows}


def test_the_derived_log_takes_the_short_way(spark):
    log = t.raw_log(spark, "/root/testdata/sf0.001").withColumn("formed", F.col("value").cast("string").rlike(PRODUCED_FORM))
    plan = judge(log.filter("formed").drop("formed"))._jdf.queryExecution().optimizedPlan().toString()
    assert log.filter("NOT formed").count() < log.count() / 10 and "union" in plan.lower()


def test_dashed_keeps_null(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS a, '0123456789abcdef0123456789abcdef' AS b").select(dashed(F.col("a")), dashed(F.col("b"))).first()
    assert tuple(row) == (None, "01234567-89ab-cdef-0123-456789abcdef")


def test_the_log_is_judged_once_for_both_halves_of_the_drift(spark, monkeypatch):
    from fleetfold.plans import state_queries

    calls = []
    real = t.judged
    monkeypatch.setattr(t, "judged", lambda *a: calls.append(a) or real(*a))
    state_queries.state_drift(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1


def test_reconciling_stores_the_judged_log(spark, monkeypatch):
    from fleetfold.plans import stream_queries

    purposes = []
    real = t.stored
    monkeypatch.setattr(t, "stored", lambda frame, purpose: purposes.append((purpose, frame.columns)) or real(frame, purpose))
    row = stream_queries.reconcile_stream(spark, "/root/testdata/sf0.001").first()
    assert ("judged", ["event_id", "reason"]) in purposes
    assert row["in_log"] == row["in_ledger"] > 0 and row["faults"] == 0 and row["duplicates"] > row["in_log"]
