import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import ingest
from fleetfold.operators.envelope import judge
from tests.helpers import T0, at, event_id, log_of, position


def submit(spark, *bodies):
    rows = [(f"b{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "batch_id STRING, body STRING")


def split(spark, *bodies, **limits):
    now = F.lit(T0 + timedelta(hours=1)).cast("timestamp")
    accepted, rejected = ingest.split_batch(submit(spark, *bodies), now, "gw", **limits)
    return accepted.orderBy("batch_id", "index").collect(), rejected.orderBy("batch_id", "index").collect()


def test_one_bad_element_does_not_fail_the_batch(spark):
    accepted, rejected = split(spark, {"events": [position(), position(lat=91.5), position()]})
    assert [r["index"] for r in accepted] == [0, 2] and bytes(accepted[0]["key"]) == b"tram-8"
    assert [(r["index"], r["field"], r["reason"]) for r in rejected] == [(1, "lat", "lat: 91.5 is outside [-90, 90]")]


def test_element_rules_in_order(spark):
    late = at(3600 + 301)
    cases = [
        ({**position(), "latitude": 1}, ""), ({**position(), "vehicle_id": 5}, ""), ("text", ""), (7, ""), ([], ""), (None, "vehicle_id"), ({}, "vehicle_id"),
        (position(route=""), "route_id"), (position(ts=late), "event_ts"), ({**position(), "event_id": "nope"}, "event_id"),
        ({**position(ts=late), "event_id": "nope"}, "event_ts"), ({"schema_version": 1, "payload": {}}, ""),
    ]
    _, rejected = split(spark, {"events": [c for c, _ in cases]})
    assert [(r["index"], r["field"]) for r in rejected] == [(i, f) for i, (_, f) in enumerate(cases)]


@pytest.mark.parametrize("limits", [{"max_batch": 3, "max_body_bytes": 2000}])
def test_batch_verdicts(spark, limits):
    one = position()
    bodies = [
        '{"events":', '{"event":[]}', '{"events":"nope"}', '{"events":[],"more":1}', "[]", "null", "{}", {"events": []}, {"events": None},
        {"events": [one] * 4}, {"events": [{**one, "route_id": "r" * 3000}]}, {"events": [one] * 3},
    ]
    want = ["malformed"] * 5 + ["rejected"] * 6 + ["accepted"]
    got = ingest.batch_verdict(submit(spark, *bodies), **limits).select("batch_id", "outcome").collect()
    assert [r["outcome"] for r in sorted(got, key=lambda r: int(r["batch_id"][1:]))] == want


def test_ids_are_kept_or_minted_the_same_way_each_time(spark):
    body = {"events": [{**position(), "event_id": event_id(1).upper()}, position(), position()]}
    first, _ = split(spark, body)
    again, _ = split(spark, body)
    assert first[0]["event_id"] == event_id(1).upper()
    assert [r["event_id"] for r in first] == [r["event_id"] for r in again]
    assert len({r["event_id"] for r in first}) == 3


def test_retransmissions_both_reach_the_log_and_are_readable_there(spark):
    body = {"events": [{**position(speed_kph=1.5), "event_id": event_id(1)}]}
    accepted, _ = split(spark, body, body)
    assert len(accepted) == 2
    row = judge(log_of(spark, *[bytes(r["value"]) for r in accepted])).first()
    assert (row["reason"], row["event_id"], row["source"], row["speed_kph"]) == (None, event_id(1), "gw", 1.5)
