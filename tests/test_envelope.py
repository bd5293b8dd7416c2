import json
import uuid

import pytest
from pyspark.sql import functions as F

from fleetfold.functions import ids, rules
from fleetfold.operators import envelope as env
from tests.helpers import at, envelope, event_id, log_of, position


def verdicts(spark, *docs):
    rows = env.judge(log_of(spark, *docs)).orderBy("offset").select("reason", "error_field").collect()
    return [(r["reason"], r["error_field"]) for r in rows]


def test_valid_position_is_taken_with_its_values(spark):
    payload = position(speed_kph=31.5, bearing_deg=10.25, ts="2026-09-11T10:15:29.900Z")
    row = env.judge(log_of(spark, envelope(payload=payload))).first()
    assert row["reason"] is None and row["error"] is None
    assert (row["vehicle_id"], row["lat"], row["speed_kph"], int(row["sequence"])) == ("tram-8", -3.25, 31.5, 77)
    assert row["event_ts"].microsecond == 900000


def test_header_rules_in_order(spark):
    cases = [
        (envelope(schema_version=...), "schema_version"),
        (envelope(schema_version=0), "schema_version"),
        (envelope(schema_version=2), "schema_version"),
        (envelope(event_id=...), "event_id"),
        (envelope(event_id="not-a-uuid"), "event_id"),
        (envelope(event_type=...), "event_type"),
        (envelope(produced_at=...), "produced_at"),
        (envelope(produced_at="0001-01-01T00:00:00Z"), "produced_at"),
        (envelope(payload=...), "payload"),
        (envelope(schema_version=2, event_id="x", event_type=""), "schema_version"),
    ]
    assert verdicts(spark, *[c for c, _ in cases]) == [("decode", f) for _, f in cases]


def test_range_rules_and_boundaries(spark):
    bad = [
        ({"vehicle": ""}, "vehicle_id"), ({"route": ""}, "route_id"), ({"lat": 90.1}, "lat"), ({"lat": -90.1}, "lat"),
        ({"lon": 180.1}, "lon"), ({"lon": -180.1}, "lon"), ({"speed_kph": -1}, "speed_kph"), ({"bearing_deg": 360}, "bearing_deg"),
        ({"bearing_deg": -1}, "bearing_deg"), ({"ts": "0001-01-01T00:00:00Z"}, "event_ts"),
    ]
    good = [
        {"lat": 90}, {"lat": -90}, {"lon": 180}, {"lon": -180}, {"bearing_deg": 0}, {"bearing_deg": 359.999}, {"speed_kph": 0}, {"lat": 0, "lon": 0},
    ]
    docs = [envelope(payload=position(**c)) for c, _ in bad] + [envelope(payload=position(**c)) for c in good]
    assert verdicts(spark, *docs) == [("decode", f) for _, f in bad] + [(None, None)] * len(good)


MALFORMED = [
    "", "{", "[]", "{this is not valid json", '{"a":NaN}', "{'schema_version':1}",
    {**envelope(), "extra": 1}, {**envelope(), "event_id": 5}, {**envelope(), "schema_version": "1"}, {**envelope(), "schema_version": 1.5},
    {**envelope(), "produced_at": "yesterday"}, {**envelope(), "produced_at": "2026-09-11"}, {**envelope(), "produced_at": 12},
]


@pytest.mark.parametrize("chunk", [MALFORMED])
def test_malformed_envelopes_name_no_field_and_take_their_id_from_the_position(spark, chunk):
    rows = env.judge(log_of(spark, *chunk)).orderBy("offset").collect()
    assert [(r["reason"], r["error_field"]) for r in rows] == [("decode", "")] * len(chunk)
    namespace = uuid.UUID(ids.POSITION_NAMESPACE)
    assert [r["event_id"] for r in rows] == [str(uuid.uuid5(namespace, f"raw/0/{i}")) for i in range(len(chunk))]


def test_malformed_payloads_keep_their_own_id(spark):
    base = position()
    bad = [
        {**base, "latitude": 1.0}, {**base, "lat": "12"}, {**base, "vehicle_id": 7}, {**base, "sequence": -1}, {**base, "sequence": 1.0},
        {**base, "sequence": "5"}, {**base, "sequence": 18446744073709551616}, {**base, "event_ts": "2026-02-30T00:00:00Z"}, [], 5, "text", json.dumps(base),
    ]
    docs = [envelope(payload=p) for p in bad] + [json.dumps(envelope(payload=base)).replace("-3.25", "1e400")]
    rows = env.judge(log_of(spark, *docs)).orderBy("offset").collect()
    assert [(r["reason"], r["error_field"]) for r in rows] == [("decode", "")] * len(docs)
    assert {r["event_id"] for r in rows} == {event_id(1)}


def test_null_payload_passes_the_header_and_fails_the_first_payload_rule(spark):
    raw = json.dumps(envelope()).replace(json.dumps(position()), "null")
    assert verdicts(spark, raw) == [("decode", "vehicle_id")]


def test_missing_numbers_read_as_zero_and_optional_ones_stay_null(spark):
    payload = {"vehicle_id": "v", "route_id": "r", "event_ts": at(0)}
    row = env.judge(log_of(spark, envelope(payload=payload))).first()
    assert row["reason"] is None
    assert (row["lat"], row["lon"], int(row["sequence"]), row["speed_kph"], row["bearing_deg"]) == (0.0, 0.0, 0, None, None)


def test_unknown_type_nul_text_trailing_bytes_and_largest_counter(spark):
    docs = [
        envelope(event_type="vehicle.door"),
        envelope(payload=position(vehicle="a\u0000b", sequence=18446744073709551615)),
        json.dumps(envelope()) + '{"more":1}',
        envelope(payload=position(sequence=18446744073709551615)),
        envelope(payload=position(vehicle='quote " and "vehicle_id": 5 inside')),
        envelope(payload=position(vehicle="übër")),
    ]
    rows = env.judge(log_of(spark, *docs)).orderBy("offset").collect()
    assert [r["reason"] for r in rows] == ["unknown_version", "decode", None, None, None, None]
    assert [r["attempts"] for r in rows] == [0, 1, 0, 0, 0, 0]
    assert int(rows[3]["sequence"]) == 18446744073709551615
    assert rows[4]["vehicle_id"] == 'quote " and "vehicle_id": 5 inside' and rows[5]["vehicle_id"] == "übër"


def test_equal_ids_in_other_spellings_are_one_id(spark):
    plain = event_id(1)
    spellings = [plain, plain.upper(), plain.replace("-", ""), "{" + plain + "}", "urn:uuid:" + plain, "URN:UUID:" + plain.upper()]
    rows = env.judge(log_of(spark, *[envelope(event_id=s) for s in spellings])).collect()
    assert {r["event_id"] for r in rows} == {plain}


def test_clock_bounds_only_the_future(spark):
    df = spark.sql("SELECT explode(array(299, 301, -259200)) AS s").withColumn("ts", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("s")))
    now = F.timestamp_seconds(F.lit(1_000_000_000))
    out = {r["s"]: r["f"] for r in df.select("s", rules.clock_verdict(F.col("ts"), now)["field"].alias("f")).collect()}
    assert out == {299: None, 301: "event_ts", -259200: None}


def test_accepted_rows_round_trip_through_the_wire_form(spark):
    docs = [envelope(n, payload=position(vehicle=f"v{n}", lat=n / 7, speed_kph=None if n % 2 else 0.1 * n, sequence=n)) for n in range(1, 9)]
    taken = env.judge(log_of(spark, *docs))
    again = taken.withColumn("value", env.marshal_envelope(taken, F.col("produced_at"), F.col("source")))
    columns = ["event_id", "vehicle_id", "lat", "lon", "speed_kph", "bearing_deg", "event_ts", "sequence"]
    back = env.judge(again.select(*log_of(spark, docs[0]).columns))
    assert sorted(back.select(*columns).collect()) == sorted(taken.select(*columns).collect())
    assert "speed_kph" not in again.filter("vehicle_id = 'v1'").first()["value"].decode()


def test_offsets_beyond_eighteen_hours(spark):
    from fleetfold.functions.fields import rfc3339_to_ts

    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+23:59", "2024-01-02T03:04:05-19:30", "2024-02-30T03:04:05+19:00", "2024-01-02T03:04:05+24:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(rfc3339_to_ts(F.col("t")).cast("string").alias("at"))
    assert [r["at"] for r in df.collect()] == ["2024-01-02 03:04:05", "2024-01-01 03:05:05.5", "2024-01-02 22:34:05", None, None]
