"""Queries over history, current state, frames and resuming readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions import text
from fleetfold.operators import classify, envelope, resume, state
from fleetfold.plans import telemetry as t
from fleetfold.plans.log_queries import CURRENT_SQL, _halves, _SPLIT
from fleetfold.session import work_dir
from fleetfold.sources import tables
from fleetfold.streaming.timeline import Timeline

C = t.CLASSIFIED_SQL
NOW = "2024-01-30 12:00:00"
WINDOW_SECONDS = 14 * 24 * 3600
LIMIT = 20


def _short(hist):
    return hist.withColumnRenamed("partition", "part").withColumnRenamed("offset", "off")


def _store(spark, frame, name):
    path = work_dir(spark, name)
    frame.write.parquet(path)
    return path


def append_history(spark, sf):
    return _short(t.history(spark, sf))


def read_history(spark, sf):
    return _short(tables.read_history(spark, _store(spark, t.history(spark, sf), "history")))


def read_current(spark, sf):
    return tables.read_current(spark, _store(spark, t.current(spark, sf), "current"))


def record_processed(spark, sf):
    return _short(state.processed(t.classified(spark, sf)))


def schema_version_report(spark, sf):
    return state.schema_versions(t.classified(spark, sf))


def current_state(spark, sf):
    return t.current(spark, sf)


def current_position(spark, sf):
    hist = t.stored_history(spark, sf)
    return state.current_position(state.current_state(hist, "sequence"))


def history_summary(spark, sf):
    return state.history_summary(t.history(spark, sf))


def state_drift(spark, sf):
    """A current table that missed the second half of the log drifts from the full history."""
    judged = t.judged(spark, sf)
    first, _ = _halves(spark, sf, judged)
    return state.state_drift(state.current_state(state.history(first)), state.history(t.handled(classify.classify(judged))))


def vehicle_track(spark, sf):
    return state.vehicle_track(t.history(spark, sf), 5).select("vehicle_id", "event_id", "event_ts", "rank")


def route_activity(spark, sf):
    return state.route_activity(t.history(spark, sf), 20).select("route_id", "event_id", "event_ts", "rank")


def fleet_snapshot_counts(spark, sf):
    return state.fleet_snapshot_counts(t.history(spark, sf), "veh-00")


def _frames(spark, sf):
    return state.fanout_frames(t.classified(spark, sf))


def _whole(frames):
    return frames.withColumn("sequence", F.col("sequence").cast("bigint"))


def fanout_frame(spark, sf):
    return _whole(_frames(spark, sf))


def publish_frames(spark, sf):
    """Frames as JSON on the bus; every 13th is damaged on its way and must be dropped by the reader."""
    frames = _frames(spark, sf)
    bus = frames.select(
        F.when(F.col("sequence") % 13 == 0, F.lit('{"event_id":"","vehicle_id":"x"}')).when(F.col("sequence") % 13 == 1, F.lit("{oops"))
        .otherwise(state.frame_json(frames)).alias("frame")
    )
    path = _store(spark, bus, "bus")
    return _whole(state.decode_frames(spark.read.schema("frame STRING").parquet(path)))


def viewer_state(spark, sf):
    """The viewer sees applied and late frames in log order; event times are cut to minutes to force ties."""
    frames = t.history(spark, sf).withColumn("event_ts", F.date_trunc("hour", "event_ts")).withColumn("arrival", F.struct("partition", "offset"))
    return state.viewer_state(frames).select("vehicle_id", "event_id", "event_ts", "frames")


def viewer_seam(spark, sf):
    hist = t.stored_history(spark, sf).select("event_id", "vehicle_id", "event_ts")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return state.viewer_seam(hist.filter(F.col("event_ts") >= cut), hist.filter(F.col("event_ts") <= cut + F.expr("INTERVAL 5 DAYS")))


def fleet_bbox(spark, sf):
    return state.fleet_bbox(_frames(spark, sf))


def speed_band(spark, sf):
    r = t.rows(spark, sf)
    return r.select(F.col("partition").alias("part"), F.col("offset").alias("off"), text.speed_band(F.col("speed_kph")).alias("colour"))


def _clients(spark, sf):
    """One reader per order: it stopped at some event of the log, at one never seen, or is new."""
    o = t.table(spark, sf, "orders")
    i = F.col("o_orderkey")
    # There are three orders to two events; six readers each stopped at the same event.
    h = F.md5((F.floor(i / 6) * 4).cast("string").cast("binary"))
    from fleetfold.functions.ids import dashed

    seen = F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, F.lit("ffffffff-0000-0000-0000-000000000000")).otherwise(dashed(h))
    return o.select(F.concat(F.lit("c-"), i.cast("string")).alias("client_id"), seen.cast("string").alias("last_event_id"))


_CLIENTS_SQL = """clients AS (SELECT concat('c-', o_orderkey) AS client_id, md5(CAST(o_orderkey // 6 * 4 AS VARCHAR)) AS h, o_orderkey AS i FROM orders),
readers AS (SELECT client_id, CASE WHEN i % 10 = 0 THEN NULL WHEN i % 10 = 1 THEN 'ffffffff-0000-0000-0000-000000000000'
  ELSE concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) END AS last_event_id FROM clients),
points AS (SELECT r.client_id, r.last_event_id, h.event_ts FROM readers r LEFT JOIN history h ON r.last_event_id = h.event_id)"""

_RESUME_SQL = f"""{_CLIENTS_SQL},
judged AS (SELECT *, CASE WHEN last_event_id IS NULL THEN 'ready' WHEN event_ts IS NULL OR TIMESTAMP '{NOW}' - event_ts > to_seconds({WINDOW_SECONDS}) THEN 'reset' ELSE 'resumed' END AS verdict FROM points),
ordered AS (SELECT *, row_number() OVER (ORDER BY event_ts, event_id) AS pos FROM history),
starts AS (SELECT j.client_id, o.pos AS start FROM judged j JOIN ordered o ON j.last_event_id = o.event_id WHERE verdict = 'resumed'),
frames AS (SELECT s.client_id, o.event_id, o.event_ts, o.pos - s.start AS frame_no FROM starts s JOIN ordered o ON o.pos BETWEEN s.start + 1 AND s.start + {LIMIT})"""


def resume_point(spark, sf):
    return resume.resume_points(_clients(spark, sf), t.history(spark, sf))


def _resume(spark, sf):
    return resume.resume(_clients(spark, sf), t.stored_history(spark, sf), F.lit(NOW).cast("timestamp"), WINDOW_SECONDS, LIMIT)


def resume_verdict(spark, sf):
    return _resume(spark, sf)[0]


def resume_clients(spark, sf):
    return _resume(spark, sf)[1].select("client_id", "event_id", "event_ts", "frame_no")


def _timeline(spark, sf):
    """The history as a stored timeline, added in two parts that share blocks."""
    timeline = Timeline(spark, work_dir(spark, "timeline"), 6 * 3600)
    hist = t.stored_history(spark, sf)
    for odd in (0, 1):
        timeline.append(hist.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == odd))
    return timeline


def resume_indexed(spark, sf):
    """As ``resume_clients``, from stored positions."""
    return _timeline(spark, sf).resume(_clients(spark, sf), F.lit(NOW).cast("timestamp"), WINDOW_SECONDS, LIMIT)[1].select("client_id", "event_id", "event_ts", "frame_no")


def positions_indexed(spark, sf):
    """As ``positions_since``, from stored positions."""
    found = _timeline(spark, sf).since("00000000-0000-0000-0000-000000000000", F.lit("2024-01-10 00:00:00").cast("timestamp"), 1000)
    return found.select("event_id", "vehicle_id", "event_ts", "speed_kph", "sequence")


def positions_since(spark, sf):
    after = F.lit("2024-01-10 00:00:00").cast("timestamp")
    found = resume.positions_since(t.history(spark, sf), after, "00000000-0000-0000-0000-000000000000", 1000)
    return found.select("event_id", "vehicle_id", "event_ts", "speed_kph", "sequence")


HISTORY_SQL = f"WITH {C} SELECT * FROM history"
FRAMES_SQL = """SELECT event_id, vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, event_ts, src_id AS sequence
  FROM classified WHERE outcome IN ('applied', 'late')"""

QUERIES = {
    "append_history": (append_history, HISTORY_SQL),
    "read_history": (read_history, HISTORY_SQL),
    "current_state": (current_state, CURRENT_SQL),
    "read_current": (read_current, CURRENT_SQL),
    "record_processed": (record_processed, f"WITH {C} SELECT event_id, logged_at AS processed_at, 'batch' AS consumer_id, part, off FROM classified WHERE outcome IN ('applied', 'late')"),
    "count_schema_versions": (schema_version_report, f"""WITH {C} SELECT 1 AS schema_version, 'vehicle.position' AS event_type, count(*) AS event_count,
        min(ingested_at) AS first_seen_at, max(ingested_at) AS last_seen_at FROM history"""),
    "current_position": (current_position, f"WITH {C} SELECT event_id, vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, event_ts, sequence FROM current_rows"),
    "history_summary": (history_summary, f"WITH {C} SELECT vehicle_id, max(event_ts) AS newest_event_ts, count(*) AS reports FROM history GROUP BY vehicle_id"),
    "state_drift": (state_drift, f"""WITH {C}, early AS (SELECT vehicle_id, max(event_ts) AS last_event_ts FROM history WHERE off < {_SPLIT} GROUP BY vehicle_id),
        full_history AS (SELECT vehicle_id, max(event_ts) AS newest_event_ts, count(*) AS reports FROM history GROUP BY vehicle_id)
        SELECT e.vehicle_id, last_event_ts, newest_event_ts, reports FROM early e JOIN full_history f ON e.vehicle_id = f.vehicle_id WHERE last_event_ts <> newest_event_ts"""),
    "vehicle_track": (vehicle_track, f"""WITH {C} SELECT * FROM (SELECT vehicle_id, event_id, event_ts, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, event_id DESC) AS rank FROM history) WHERE rank <= 5"""),
    "route_activity": (route_activity, f"""WITH {C} SELECT * FROM (SELECT route_id, event_id, event_ts, row_number() OVER (PARTITION BY route_id ORDER BY event_ts DESC, event_id DESC) AS rank FROM history) WHERE rank <= 20"""),
    "fleet_snapshot_counts": (fleet_snapshot_counts, f"WITH {C} SELECT count(DISTINCT vehicle_id) AS vehicles, count(*) AS positions FROM history WHERE starts_with(vehicle_id, 'veh-00')"),
    "fanout_frame": (fanout_frame, f"WITH {C} {FRAMES_SQL}"),
    "publish_frames": (publish_frames, f"WITH {C} {FRAMES_SQL} AND src_id % 13 > 1"),
    "decode_frames": (publish_frames, f"WITH {C} {FRAMES_SQL} AND src_id % 13 > 1"),
    "viewer_state": (viewer_state, f"""WITH {C}, seen AS (SELECT vehicle_id, event_id, date_trunc('hour', event_ts) AS event_ts, part, off FROM history)
        SELECT vehicle_id, event_id, event_ts, frames FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, part DESC, off DESC) AS rn, count(*) OVER (PARTITION BY vehicle_id) AS frames FROM seen) WHERE rn = 1"""),
    "viewer_seam": (viewer_seam, f"WITH {C} SELECT event_id, vehicle_id, event_ts FROM history"),
    "fleet_bbox": (fleet_bbox, f"WITH {C} SELECT max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west FROM history"),
    "speed_band": (speed_band, f"""WITH {t.BASE_SQL} SELECT part, off, CASE WHEN speed_kph IS NULL THEN '#64748b' ELSE
        concat('hsl(', floor(200.0::DOUBLE - 200.0::DOUBLE * greatest(0, least(1, speed_kph / 80)) + 0.5::DOUBLE)::BIGINT, ' 85% ', floor(52.0::DOUBLE + 10.0::DOUBLE * greatest(0, least(1, speed_kph / 80)) + 0.5::DOUBLE)::BIGINT, '%)') END AS colour FROM log"""),
    "resume_point": (resume_point, f"WITH {C}, {_CLIENTS_SQL} SELECT client_id, last_event_id, event_ts FROM points"),
    "resume_verdict": (resume_verdict, f"""WITH {C}, {_RESUME_SQL}, counted AS (SELECT client_id, count(*) AS frames FROM frames GROUP BY client_id)
        SELECT j.client_id, verdict, coalesce(frames, 0) AS frames FROM judged j LEFT JOIN counted c ON j.client_id = c.client_id"""),
    "resume_indexed": (resume_indexed, f"WITH {C}, {_RESUME_SQL} SELECT client_id, event_id, event_ts, frame_no FROM frames"),
    "resume_clients": (resume_clients, f"WITH {C}, {_RESUME_SQL} SELECT client_id, event_id, event_ts, frame_no FROM frames"),
    "positions_indexed": (positions_indexed, f"""WITH {C} SELECT event_id, vehicle_id, event_ts, speed_kph, sequence FROM history
        WHERE event_ts > TIMESTAMP '2024-01-10 00:00:00' OR (event_ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > '00000000-0000-0000-0000-000000000000') ORDER BY event_ts, event_id LIMIT 1000"""),
    "positions_since": (positions_since, f"""WITH {C} SELECT event_id, vehicle_id, event_ts, speed_kph, sequence FROM history
        WHERE event_ts > TIMESTAMP '2024-01-10 00:00:00' OR (event_ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > '00000000-0000-0000-0000-000000000000') ORDER BY event_ts, event_id LIMIT 1000"""),
}
