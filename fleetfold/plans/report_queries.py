"""Run reports over the given ``events``: each one is a frame sent at ``ts`` that took ``value`` ms to arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.operators import reconcile, reports
from fleetfold.plans import telemetry as t


def _sent(spark, sf):
    r = t.events(spark, sf)
    return r.select(F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("sent_ms"), "value")


def _deliveries(spark, sf):
    """Frames of refused records never arrive; redelivered ones arrive twice and the first counts."""
    sent = _sent(spark, sf)
    r = t.rows(spark, sf).filter(F.col("kind") == "ok").select(F.col("src_id").alias("event_id"), "offset")
    late = F.when(F.col("offset") % 2 == 1, 1000.0).otherwise(0.0)
    arrived = r.join(sent, "event_id").select("event_id", (F.col("sent_ms") + F.col("value") + late).alias("arrived_ms"))
    return reconcile.match_deliveries(sent.select("event_id", "sent_ms"), arrived)


_DELIVERIES_SQL = f"""WITH {t.BASE_SQL}, sent AS (SELECT event_id, epoch_us(ts) / CAST(1000 AS DOUBLE) AS sent_ms, value FROM events),
arrived AS (SELECT src_id AS event_id, min(sent_ms + value + CASE WHEN off % 2 = 1 THEN 1000 ELSE 0 END) AS arrived_ms FROM log l JOIN sent s ON l.src_id = s.event_id WHERE kind = 'ok' GROUP BY src_id),
deliveries AS (SELECT s.event_id, sent_ms, arrived_ms, arrived_ms - sent_ms AS latency_ms FROM sent s LEFT JOIN arrived a ON s.event_id = a.event_id)"""


def match_deliveries(spark, sf):
    return _deliveries(spark, sf)


def latency_report(spark, sf):
    return reports.latency_report(_deliveries(spark, sf))


def nearest_rank(spark, sf):
    """The same percentiles over a large table with many ties: line item prices."""
    prices = t.table(spark, sf, "lineitem")
    return reports.nearest_rank(prices, F.col("l_extendedprice"), {"p1": 1, "p50": 50, "p95": 95, "p99": 99, "p100": 100})


def _frames(spark, sf):
    waited = F.when(F.col("kind") == "ok", F.col("speed_kph") / 100)
    return t.rows(spark, sf).select(F.col("vehicle_id").alias("client_id"), waited.alias("waited_s"))


def frames_per_client(spark, sf):
    return reports.frames_per_client(_frames(spark, sf))


def histogram_latency(spark, sf):
    e = t.events(spark, sf)
    h = reports.histogram(e, F.col("value") / 1000, reports.TX_SECONDS_BOUNDS)
    return h.withColumn("value_sum", F.round("value_sum", 4))


def histogram_poll(spark, sf):
    """Events of each minute, as a reader that polls once a minute would get them."""
    polls = t.events(spark, sf).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return reports.histogram(polls, F.col("n"), reports.POLL_SIZE_BOUNDS)


def histogram_produce(spark, sf):
    h = reports.histogram(t.events(spark, sf), F.col("value") / 100, reports.PRODUCE_SECONDS_BOUNDS)
    return h.withColumn("value_sum", F.round("value_sum", 4))


def histogram_publish(spark, sf):
    h = reports.histogram(t.events(spark, sf), F.col("value") / 10000, reports.PUBLISH_SECONDS_BOUNDS)
    return h.withColumn("value_sum", F.round("value_sum", 4))


def histogram_replay(spark, sf):
    per_reader = t.events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return reports.histogram(per_reader, F.col("n"), reports.REPLAY_SIZE_BOUNDS)


def interval_rate(spark, sf):
    return reports.interval_rate(t.events(spark, sf), F.col("ts"), 5)


def _rank(p):
    return f"greatest(1, least(n, CAST(round_even({p} / CAST(100 AS DOUBLE) * n, 0) AS BIGINT)))"


def _histogram_sql(cte, value, bounds, total):
    rows = " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE {value} <= CAST({b} AS DOUBLE)) AS cumulative, {total} AS value_sum, count(*) AS total FROM v" for b in bounds)
    return f"{cte} {rows} UNION ALL SELECT NULL, count(*), {total}, count(*) FROM v"


QUERIES = {
    "match_deliveries": (match_deliveries, f"{_DELIVERIES_SQL} SELECT event_id, sent_ms, arrived_ms, latency_ms FROM deliveries"),
    "latency_report": (latency_report, f"""{_DELIVERIES_SQL}, r AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS k, count(*) OVER () AS n FROM deliveries WHERE latency_ms IS NOT NULL)
        SELECT (SELECT count(latency_ms) FROM deliveries) AS delivered, (SELECT count(*) - count(latency_ms) FROM deliveries) AS undelivered,
          round(max(v), 2) AS max_ms, round(avg(v), 2) AS mean_ms, round(max(v) FILTER (WHERE k = {_rank(50)}), 2) AS p50_ms,
          round(max(v) FILTER (WHERE k = {_rank(95)}), 2) AS p95_ms, round(max(v) FILTER (WHERE k = {_rank(99)}), 2) AS p99_ms FROM r"""),
    "nearest_rank": (nearest_rank, f"""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)
        SELECT {", ".join(f"max(v) FILTER (WHERE k = {_rank(p)}) AS p{p}" for p in (1, 50, 95, 99, 100))} FROM r"""),
    "frames_per_client": (frames_per_client, f"""WITH {t.BASE_SQL}, f AS (SELECT vehicle_id AS client_id, CASE WHEN kind = 'ok' THEN speed_kph / 100 END AS waited_s FROM log),
        c AS (SELECT client_id, count(waited_s) AS frames, min(waited_s) AS first_s FROM f GROUP BY client_id),
        a AS (SELECT frames, row_number() OVER (ORDER BY frames) AS k, count(*) OVER () AS n FROM c),
        b AS (SELECT first_s, row_number() OVER (ORDER BY first_s) AS k, count(*) OVER () AS n FROM c WHERE first_s IS NOT NULL)
        SELECT (SELECT count(*) FROM c) AS clients, (SELECT count(*) FROM c WHERE frames > 0) AS clients_receiving, (SELECT sum(frames)::BIGINT FROM c) AS total_frames,
          (SELECT min(frames) FROM c) AS min_frames, (SELECT max(frames) FROM c) AS max_frames, (SELECT round(max(first_s), 3) FROM c) AS first_max_s,
          (SELECT max(frames) FROM a WHERE k = {_rank(50)}) AS p50_frames, (SELECT round(max(first_s), 3) FROM b WHERE k = {_rank(50)}) AS first_p50_s,
          (SELECT round(max(first_s), 3) FROM b WHERE k = {_rank(95)}) AS first_p95_s"""),
    "histogram_latency": (histogram_latency, _histogram_sql("WITH v AS (SELECT value / 1000 AS x FROM events)", "x", reports.TX_SECONDS_BOUNDS, "round(sum(x), 4)")),
    "histogram_poll": (histogram_poll, _histogram_sql("WITH v AS (SELECT count(*) AS n FROM events GROUP BY date_trunc('minute', ts))", "n", reports.POLL_SIZE_BOUNDS, "sum(n)::BIGINT")),
    "histogram_produce": (histogram_produce, _histogram_sql("WITH v AS (SELECT value / 100 AS x FROM events)", "x", reports.PRODUCE_SECONDS_BOUNDS, "round(sum(x), 4)")),
    "histogram_publish": (histogram_publish, _histogram_sql("WITH v AS (SELECT value / 10000 AS x FROM events)", "x", reports.PUBLISH_SECONDS_BOUNDS, "round(sum(x), 4)")),
    "histogram_replay": (histogram_replay, _histogram_sql("WITH v AS (SELECT count(*) AS n FROM events GROUP BY user_id)", "n", reports.REPLAY_SIZE_BOUNDS, "sum(n)::BIGINT")),
    "interval_rate": (interval_rate, """SELECT time_bucket(INTERVAL 5 SECONDS, ts) AS interval_start, count(*) AS events, floor(count(*) / CAST(5 AS DOUBLE) * 10 + 0.5) / 10 AS per_second FROM events GROUP BY ALL"""),
}
