"""Documents in the producers' own form skip the exact look; every other spelling must not, and both give the same."""

import re

from pyspark.sql import functions as F

from fleetfold.functions import fields
from fleetfold.operators.envelope import ENVELOPE_KINDS, POSITION_KINDS, judge
from fleetfold.plans import telemetry as t

HEAD = '{"schema_version":1,"event_id":"0f397628-915d-4017-804c-d7d748afb01a","event_type":"vehicle.position","produced_at":"2024-01-01T00:00:00Z","source":"s","payload":%s}'
BODY = '{"vehicle_id":"v","route_id":"r","lat":1.5,"lon":-2,"event_ts":"2024-01-01T00:00:00Z","sequence":%s}'
PLAIN = [BODY % "7", BODY % "0", "{}", '{"lat":1e5}']
OTHER = [
    BODY % "-1", BODY % '"7"', BODY % "7.0", BODY % "null", BODY % "18446744073709551616", BODY % "07",
    (BODY % "7") + "\n", (BODY % "7") + "x", '{"lat":1,"lat":2}', '{"lon":1,"lat":2}', '{"lat":1,}', '{"lat":1e999}', '{"vehicle_id":5}',
    '{"vehicle_id":"a\\u0000"}', '{"vehicle_id":"é"}', '{"vehicle_id":"a\nb"}', '{"speed":1}', "null", "", "[]", '{"lat":1 }',
]


def _matches(kinds, text):
    return re.search(fields.plain_form(kinds).replace(r"\z", r"\Z"), text) is not None


def test_only_plain_documents_are_taken_for_plain():
    assert all(_matches(POSITION_KINDS, x) for x in PLAIN)
    assert not [x for x in OTHER if _matches(POSITION_KINDS, x)]
    assert _matches(ENVELOPE_KINDS, HEAD % BODY % "7")
    assert not [x for x in ("null", '"x"', '{"a":{}}', '{"a":[1]}', '{"a":"\\u0041"}', "{" + ",".join(['"a":1'] * 17) + "}") if _matches(ENVELOPE_KINDS, HEAD % x)]


def test_plain_and_exact_reading_agree(spark, monkeypatch):
    texts = [HEAD % x for x in PLAIN + OTHER] + PLAIN + OTHER
    texts += [HEAD % '{"vehicle_id":"v","extra":1}', (HEAD % BODY % "7").replace('"s"', '"s","x":1'), (HEAD % BODY % "7").replace("00:00:00Z", "25:00:00Z")]
    rows = [(b"k", x.encode(), "t", 0, i, None, []) for i, x in enumerate(texts)]
    log = spark.createDataFrame(rows, "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, headers ARRAY<STRUCT<key: STRING, value: BINARY>>")
    read = lambda: [r.asDict() for r in judge(log).orderBy("offset").collect()]
    fast = read()
    monkeypatch.setattr(fields, "plain_form", lambda kinds: "(?!)")
    assert fast == read()


def test_the_derived_log_is_plain_but_for_what_cannot_be(spark):
    log = t.raw_log(spark, "/root/testdata/sf0.001").select(F.col("value").cast("string").alias("v"))
    counts = log.agg(F.count_if(F.col("v").rlike(fields.plain_form(ENVELOPE_KINDS))), F.count_if(F.col("v").startswith('{"schema'))).first()
    assert counts[0] == counts[1] > 0


def test_tasks_do_not_grow_with_the_log(spark):
    rows = spark.range(0, 500_000, 1, 1)
    assert t.spread(rows).rdd.getNumPartitions() == 10
