"""Queries over batches of submissions packed from the given ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions import ids
from fleetfold.functions.text import rfc3339_micros
from fleetfold.operators import ingest, reports
from fleetfold.plans import telemetry as t
from fleetfold.session import work_dir
from fleetfold.sources import tables

NOW = "2024-02-01 00:00:00"
SOURCE = "gateway-1"

SUBMITTED_SQL = f"""
obs AS (
  SELECT event_id AS i, md5(CAST(event_id AS VARCHAR)) AS h, user_id, event_type AS route_id, ts,
    CASE WHEN (event_id // 1000) % 5 = 4 THEN concat('big-', event_id // 1000) ELSE concat('b-', event_id // 25) END AS batch_id,
    CASE WHEN (event_id // 1000) % 5 = 4 THEN 'big' WHEN (event_id // 25) % 41 = 3 THEN 'truncated' WHEN (event_id // 25) % 43 = 4 THEN 'misnamed'
         WHEN (event_id // 25) % 47 = 5 THEN 'empty' WHEN (event_id // 25) % 53 = 6 THEN 'text' ELSE 'good' END AS batch_kind,
    CASE WHEN event_id % 31 = 1 THEN 'unknown' WHEN event_id % 29 = 2 THEN 'no_vehicle' WHEN event_id % 37 = 3 THEN 'lat'
         WHEN event_id % 23 = 4 THEN 'speed' WHEN event_id % 19 = 5 THEN 'bearing' WHEN event_id % 17 = 6 THEN 'future'
         WHEN event_id % 13 = 7 THEN 'bad_id' WHEN event_id % 11 = 8 THEN 'no_id' WHEN event_id % 43 = 9 THEN 'mistyped' ELSE 'ok' END AS kind
  FROM events),
indexed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY batch_id) AS size FROM obs),
elements AS (
  SELECT *, CASE kind WHEN 'unknown' THEN '' WHEN 'mistyped' THEN '' WHEN 'no_vehicle' THEN 'vehicle_id' WHEN 'lat' THEN 'lat' WHEN 'speed' THEN 'speed_kph'
      WHEN 'bearing' THEN 'bearing_deg' WHEN 'future' THEN 'event_ts' WHEN 'bad_id' THEN 'event_id' END AS field,
    CASE kind WHEN 'unknown' THEN 'not a valid observation: unknown field latitude' WHEN 'mistyped' THEN 'not a valid observation'
      WHEN 'no_vehicle' THEN 'vehicle_id: is required' WHEN 'lat' THEN 'lat: 91.5 is outside [-90, 90]' WHEN 'speed' THEN 'speed_kph: -1 is negative'
      WHEN 'bearing' THEN 'bearing_deg: 360 is outside [0, 360)' WHEN 'future' THEN 'event_ts: is more than 5 minutes in the future'
      WHEN 'bad_id' THEN 'event_id: is not a UUID' END AS reason
  FROM indexed WHERE batch_kind = 'good' OR (batch_kind = 'big' AND size <= 500)),
batches AS (
  SELECT batch_id, CASE WHEN any_value(batch_kind) IN ('truncated', 'misnamed', 'text') THEN 'malformed'
      WHEN any_value(batch_kind) = 'empty' OR count(*) > 500 THEN 'rejected' ELSE 'accepted' END AS outcome,
    CASE WHEN any_value(batch_kind) IN ('truncated', 'misnamed', 'text') THEN '' WHEN any_value(batch_kind) = 'empty' OR count(*) > 500 THEN 'events' ELSE '' END AS batch_field,
    min(ts) AS sent_at
  FROM obs GROUP BY batch_id)"""

MINTED_SQL = f"""sha1(unhex('{ids.SUBMISSION_NAMESPACE.replace("-", "")}') || encode(concat(batch_id, '/', idx)))"""


def submissions(spark, sf):
    """Batches of 25 observations (some of 1000, more than a batch may hold), with faults of every kind."""
    i, b = F.col("event_id"), F.floor(F.col("event_id") / 25)
    block = F.floor(i / 1000)
    big = block % 5 == 4
    kind = F.lit("ok")
    faults = [(43, 9, "mistyped"), (11, 8, "no_id"), (13, 7, "bad_id"), (17, 6, "future"), (19, 5, "bearing"), (23, 4, "speed"), (37, 3, "lat"), (29, 2, "no_vehicle"), (31, 1, "unknown")]
    for mod, rest, name in faults:
        kind = F.when(i % mod == rest, name).otherwise(kind)
    batch_kind = (
        F.when(big, "big").when(b % 41 == 3, "truncated").when(b % 43 == 4, "misnamed").when(b % 47 == 5, "empty").when(b % 53 == 6, "text").otherwise("good")
    )
    e = t.events(spark, sf).withColumns({"kind": kind, "batch_kind": batch_kind})
    e = e.withColumn("batch_id", F.when(big, F.concat(F.lit("big-"), block)).otherwise(F.concat(F.lit("b-"), b)))
    k = F.col("kind")
    vehicle = F.concat(F.lit("veh-"), F.lpad(F.col("user_id").cast("string"), 4, "0"))
    sent = F.when(k == "future", F.lit("2024-02-01 00:05:01").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    body = F.to_json(
        F.struct(
            F.when(k == "no_id", F.lit(None)).when(k == "bad_id", "not-a-uuid").otherwise(ids.dashed(F.md5(i.cast("string").cast("binary")))).alias("event_id"),
            F.when(k == "no_vehicle", "").otherwise(vehicle).alias("vehicle_id"),
            F.col("event_type").alias("route_id"),
            F.when(k == "lat", 91.5).otherwise(F.lit(12.5)).alias("lat"),
            F.lit(77.5).alias("lon"),
            F.when(k == "speed", -1.0).otherwise(F.col("value")).alias("speed_kph"),
            F.when(k == "bearing", 360.0).alias("bearing_deg"),
            rfc3339_micros(sent).alias("event_ts"),
            i.alias("sequence"),
        )
    )
    body = F.when(k == "unknown", F.replace(body, F.lit('"lat"'), F.lit('"latitude"'))).when(
        k == "mistyped", F.replace(body, F.concat(F.lit('"vehicle_id":"'), vehicle, F.lit('"')), F.lit('"vehicle_id":7'))
    ).otherwise(body)
    # A batch is bounded by construction, so gathering one is too.
    packed = e.groupBy("batch_id", "batch_kind").agg(
        F.sort_array(F.collect_list(F.struct(i.alias("i"), body.alias("body")))).alias("items"), F.min("ts").alias("sent_at")
    )
    joined = F.array_join(F.transform("items", lambda x: x["body"]), ",")
    bk = F.col("batch_kind")
    document = (
        F.when(bk == "truncated", F.concat(F.lit('{"events":['), joined)).when(bk == "misnamed", F.concat(F.lit('{"event":['), joined, F.lit("]}")))
        .when(bk == "empty", '{"events":[]}').when(bk == "text", '{"events":"nope"}').otherwise(F.concat(F.lit('{"events":['), joined, F.lit("]}")))
    )
    return packed.select("batch_id", document.alias("body"), "sent_at")


def _now():
    return F.lit(NOW).cast("timestamp")


def _judged(spark, sf):
    elements = tables.read_submissions(submissions(spark, sf).select("batch_id", "body"))
    return ingest.accept_submissions(elements, _now(), SOURCE)


def read_submissions(spark, sf):
    elements = tables.read_submissions(submissions(spark, sf).select("batch_id", "body"))
    return elements.select("batch_id", F.col("index").alias("idx"), F.get_json_object("raw", "$.sequence").cast("bigint").alias("sequence"))


def batch_verdict(spark, sf):
    return ingest.batch_verdict(submissions(spark, sf).select("batch_id", "body")).select("batch_id", "outcome", "batch_field")


def accept_submissions(spark, sf):
    v = F.col("verdict.field")
    return _judged(spark, sf).select("batch_id", F.col("index").alias("idx"), v.alias("field"), F.col("value").isNotNull().alias("accepted"))


def split_accepted(spark, sf):
    accepted, _ = ingest.split_batch(submissions(spark, sf).select("batch_id", "body"), _now(), SOURCE)
    value = F.col("value").cast("string")
    return accepted.select(
        "batch_id", F.col("index").alias("idx"), "event_id", F.col("key").cast("string").alias("vehicle_id"),
        (F.get_json_object(value, "$.event_id") == F.col("event_id")).alias("same_id"),
    )


def split_rejected(spark, sf):
    _, rejected = ingest.split_batch(submissions(spark, sf).select("batch_id", "body"), _now(), SOURCE)
    return rejected.withColumnRenamed("index", "idx")


def assign_event_id(spark, sf):
    j = _judged(spark, sf).filter(F.col("verdict").isNull())
    return j.select("batch_id", F.col("index").alias("idx"), "event_id")


def batch_counts(spark, sf):
    return ingest.batch_counts(_judged(spark, sf))


def request_outcomes(spark, sf):
    return ingest.request_outcomes(ingest.batch_verdict(submissions(spark, sf).select("batch_id", "body")))


def _run(spark, sf):
    sent = submissions(spark, sf)
    counts = ingest.batch_counts(_judged(spark, sf))
    return sent.select("batch_id", "sent_at").join(counts, "batch_id", "left")


def throughput_report(spark, sf):
    return reports.throughput_report(_run(spark, sf))


def write_report(spark, sf):
    """The report as one JSON document on disk, read back."""
    report = reports.throughput_report(_run(spark, sf))
    path = work_dir(spark, "report")
    report.coalesce(1).write.json(path)
    return spark.read.schema(report.schema).json(path)


def batch_size_histogram(spark, sf):
    judged = ingest.batch_verdict(submissions(spark, sf).select("batch_id", "body")).filter(F.col("outcome") == "accepted")
    return reports.histogram(judged, F.col("event_count"), reports.BATCH_SIZE_BOUNDS)


_ID_SQL = f"""CASE WHEN kind = 'no_id' THEN concat(substr({MINTED_SQL},1,8),'-',substr({MINTED_SQL},9,4),'-5',substr({MINTED_SQL},14,3),'-',
  translate(substr({MINTED_SQL},17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr({MINTED_SQL},18,3),'-',substr({MINTED_SQL},21,12))
  ELSE concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) END"""
_VEHICLE_SQL = "concat('veh-', lpad(CAST(user_id AS VARCHAR), 4, '0'))"
_REPORT_SQL = f"""WITH {SUBMITTED_SQL}, c AS (SELECT count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM elements),
  b AS (SELECT count(*) AS batches, CAST(epoch_us(max(sent_at)) - epoch_us(min(sent_at)) AS DOUBLE) / 1e6 AS s FROM batches)
  SELECT accepted, rejected, batches, floor(s * 10 + 0.5) / 10 AS duration_s, floor(accepted / s * 10 + 0.5) / 10 AS achieved_rate,
    floor(CAST(accepted AS DOUBLE) / batches * 10 + 0.5) / 10 AS accepted_per_batch FROM c, b"""


def _histogram_sql(cte: str, value: str, bounds) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE {value} <= {b}) AS cumulative, sum({value})::BIGINT AS value_sum, count(*) AS total FROM v" for b in bounds)
    return f"{cte} {rows} UNION ALL SELECT NULL, count(*), sum({value})::BIGINT, count(*) FROM v"


QUERIES = {
    "read_submissions": (read_submissions, f"WITH {SUBMITTED_SQL} SELECT batch_id, idx, i AS sequence FROM elements"),
    "batch_verdict": (batch_verdict, f"WITH {SUBMITTED_SQL} SELECT batch_id, outcome, batch_field FROM batches"),
    "accept_submissions": (accept_submissions, f"WITH {SUBMITTED_SQL} SELECT batch_id, idx, field, reason IS NULL AS accepted FROM elements"),
    "split_batch_accepted": (split_accepted, f"WITH {SUBMITTED_SQL} SELECT batch_id, idx, {_ID_SQL} AS event_id, {_VEHICLE_SQL} AS vehicle_id, true AS same_id FROM elements WHERE reason IS NULL"),
    "split_batch_rejected": (split_rejected, f"WITH {SUBMITTED_SQL} SELECT batch_id, idx, field, reason FROM elements WHERE reason IS NOT NULL"),
    "assign_event_id": (assign_event_id, f"WITH {SUBMITTED_SQL} SELECT batch_id, idx, {_ID_SQL} AS event_id FROM elements WHERE reason IS NULL"),
    "batch_counts": (batch_counts, f"WITH {SUBMITTED_SQL} SELECT batch_id, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM elements GROUP BY batch_id"),
    "request_outcomes": (request_outcomes, f"WITH {SUBMITTED_SQL} SELECT outcome, count(*) AS batches FROM batches GROUP BY outcome"),
    "throughput_report": (throughput_report, _REPORT_SQL),
    "write_report": (write_report, _REPORT_SQL),
    "histogram_batch_size": (batch_size_histogram, _histogram_sql(f"WITH {SUBMITTED_SQL}, v AS (SELECT batch_id, count(*) AS n FROM elements GROUP BY batch_id)", "n", reports.BATCH_SIZE_BOUNDS)),
}
