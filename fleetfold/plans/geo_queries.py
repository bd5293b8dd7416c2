"""Queries over routes and tracks. Every vehicle's reports, in log order, are the waypoints of a route."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetfold.functions import geo, text
from fleetfold.operators import routes
from fleetfold.operators.ordered import numbered, offset_block
from fleetfold.plans import telemetry as t
from fleetfold.session import work_dir
from fleetfold.sources import tables

POINTS_SQL = """
points AS (
  SELECT concat('r-', user_id) AS route_id, event_id AS idx, CAST(12.8 AS DOUBLE) + CAST(event_id % 400 AS DOUBLE) / 1000 AS lat,
    CAST(77.5 AS DOUBLE) + CAST(event_id % 700 AS DOUBLE) / 1000 AS lon FROM events)"""

HAVERSINE_SQL = """2 * 6371008.8::DOUBLE * asin(least(1, sqrt(sin(radians(lat2 - lat1) / 2) * sin(radians(lat2 - lat1) / 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) * sin(radians(lon2 - lon1) / 2))))"""
BEARING_Y = "sin(radians(lon2 - lon1)) * cos(radians(lat2))"
BEARING_X = "(cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))"
BEARING_SQL = f"CASE WHEN {BEARING_X} = 0 AND {BEARING_Y} = 0 THEN 0 ELSE fmod(atan2({BEARING_Y}, {BEARING_X}) * 180 / pi() + 360, 360) END"

SEGMENTS_SQL = f"""{POINTS_SQL},
pairs AS (SELECT route_id, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
legs AS (SELECT *, {HAVERSINE_SQL} AS length_m FROM pairs WHERE lat2 IS NOT NULL),
segments AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM legs),
lengths AS (SELECT route_id, sum(length_m) AS loop_m, count(*) AS segments FROM segments GROUP BY route_id)"""


def waypoints(spark, sf):
    e = t.events(spark, sf)
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("r-"), F.col("user_id").cast("string")).alias("route_id"), i.alias("idx"),
        (F.lit(12.8) + (i % 400).cast("double") / 1000).alias("lat"), (F.lit(77.5) + (i % 700).cast("double") / 1000).alias("lon"),
    )


def read_waypoints(spark, sf):
    """Routes as geometry documents, some points as pairs and some as objects, read back as rows."""
    w = waypoints(spark, sf)
    pair = F.concat(F.lit("["), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), F.lit("]"))
    point = F.when(F.col("idx") % 2 == 0, pair).otherwise(F.to_json(F.struct("lat", "lon")))
    # One document per route and block of 1000 points, so that no route is gathered whole.
    block = F.floor(F.col("idx") / 1000)
    parts = w.groupBy("route_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", point.alias("p")))).alias("ps"))
    name = F.concat(F.lit('{"routes":[{"id":"'), F.col("route_id"), F.lit("/"), F.col("block"), F.lit('","name":"","points":['))
    document = F.concat(name, F.array_join(F.transform("ps", lambda p: p["p"]), ","), F.lit("]}]}"))
    path = work_dir(spark, "geometry")
    parts.select(document.alias("value")).write.text(path)
    return tables.read_waypoints(spark, path, lines=True).withColumnRenamed("idx", "point_no")


def _rounded(frame, **digits):
    return frame.withColumns({c: F.round(c, d) for c, d in digits.items()})


def route_segments(spark, sf):
    s = routes.route_segments(waypoints(spark, sf)).select("route_id", "idx", "length_m", "start_m")
    return _rounded(s, length_m=1, start_m=1)


def route_lengths(spark, sf):
    return _rounded(routes.route_lengths(waypoints(spark, sf)).select("route_id", "segments", "length_m", "gap_m", "closed"), length_m=1, gap_m=1)


def locate_on_route(spark, sf):
    """Where a vehicle that drove ``value`` kilometres (or as far backwards) is on its route."""
    e = t.events(spark, sf)
    metres = F.when(F.col("event_id") % 4 == 0, -F.col("value")).otherwise(F.col("value")) * 1000
    offsets = e.select(F.col("event_id").alias("offset_id"), F.concat(F.lit("r-"), F.col("user_id").cast("string")).alias("route_id"), metres.alias("offset_m"))
    w = waypoints(spark, sf)
    found = routes.locate_on_route(offsets, routes.route_segments(w), routes.route_lengths(w))
    return _rounded(found.select("offset_id", "route_id", "segment", "lat", "lon", "bearing_deg"), lat=4, lon=4, bearing_deg=2)


def track_legs(spark, sf):
    legs = routes.track_legs(t.stored_history(spark, sf).withColumn("lon", F.col("lon") + F.col("lat") / 10))
    return _rounded(legs.select("vehicle_id", "from_event_id", "to_event_id", "distance_m", "heading_deg"), distance_m=1, heading_deg=2)


def sequence_gaps(spark, sf):
    """Reports are numbered per vehicle as produced; what was refused is missing from the history."""
    e = t.events(spark, sf).select("event_id", "user_id")
    counted = numbered(e, ["user_id"], offset_block("event_id"), [F.col("event_id")], "counter")
    own = counted.select(F.col("event_id").alias("sequence"), "counter")
    hist = t.history(spark, sf).select("vehicle_id", "event_id", "sequence").join(own, "sequence")
    # The operator reads its rows three times; what it needs of them is stored, so that they are numbered and joined once.
    return routes.sequence_gaps(t.stored(hist.select("vehicle_id", "event_id", F.col("counter").alias("sequence")), "reports"))


def _pairs(spark, sf):
    """Each event's point and the one of the next id."""
    e = t.events(spark, sf).select("event_id")
    i = F.col("event_id")
    return e.select(
        "event_id", (F.lit(12.8) + (i % 400).cast("double") / 1000).alias("lat1"), (F.lit(77.5) + (i % 700).cast("double") / 1000).alias("lon1"),
        (F.lit(12.8) + (i * 7 % 400).cast("double") / 1000).alias("lat2"), (F.lit(77.5) + (i * 3 % 700).cast("double") / 1000).alias("lon2"),
    )


_PAIRS_SQL = """WITH pairs AS (SELECT event_id, CAST(12.8 AS DOUBLE) + CAST(event_id % 400 AS DOUBLE) / 1000 AS lat1, CAST(77.5 AS DOUBLE) + CAST(event_id % 700 AS DOUBLE) / 1000 AS lon1,
  CAST(12.8 AS DOUBLE) + CAST(event_id * 7 % 400 AS DOUBLE) / 1000 AS lat2, CAST(77.5 AS DOUBLE) + CAST(event_id * 3 % 700 AS DOUBLE) / 1000 AS lon2 FROM events)"""


def haversine_m(spark, sf):
    p = _pairs(spark, sf)
    return p.select("event_id", F.round(geo.haversine_m(*map(F.col, ["lat1", "lon1", "lat2", "lon2"])), 1).alias("distance_m"))


def bearing_deg(spark, sf):
    p = _pairs(spark, sf)
    return p.select("event_id", F.round(geo.bearing_deg(*map(F.col, ["lat1", "lon1", "lat2", "lon2"])), 2).alias("heading_deg"))


def wrap_offset(spark, sf):
    e = t.events(spark, sf)
    metres = F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value"))
    return e.select("event_id", F.round(geo.wrap_offset(metres, F.lit(100.0)), 6).alias("wrapped"))


def lerp(spark, sf):
    e = t.events(spark, sf)
    return e.select("event_id", geo.lerp(F.lit(10.0), F.lit(20.0), F.col("value") - 20, (F.col("user_id") % 90).cast("double")).alias("placed"))


def kph_to_mps(spark, sf):
    return t.events(spark, sf).select("event_id", geo.kph_to_mps(F.col("value")).alias("mps"))


def round_tenth(spark, sf):
    return t.events(spark, sf).select("event_id", text.round_tenth(F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value"))).alias("tenth"))


def geometry_faults(spark, sf):
    """Routes written as geometry documents, one in five spoilt in one of five ways, and what is found wrong with each."""
    w = waypoints(spark, sf).filter(F.col("lat").isNotNull())
    way = F.pmod(F.regexp_extract("route_id", "[0-9]+", 0).cast("bigint"), F.lit(25))
    rank = F.row_number().over(Window.partitionBy("route_id").orderBy("idx"))
    w = w.withColumns({"_way": way, "_n": rank}).filter((F.col("_way") != 3) | (F.col("_n") == 1))
    point = (
        F.when((F.col("_way") == 1) & (F.col("_n") == 1), F.lit('["north", 1]'))
        .when(F.col("_way") == 4, F.lit("[12.5, 77.5]"))
        .otherwise(F.to_json(F.array("lat", "lon")))
    )
    points = w.groupBy("route_id", "_way").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", point.alias("p")))), lambda s: s["p"]).alias("points"))
    name = F.when(F.col("_way") == 0, F.lit("")).otherwise(F.col("route_id"))
    copies = F.when(F.col("_way") == 2, F.lit(2)).otherwise(F.lit(1))
    routes_ = points.select(name.alias("id"), "points", F.explode(F.sequence(F.lit(1), copies)))
    path = work_dir(spark, "geometry")
    body = F.concat(F.lit('{"routes":[{"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"points":['), F.array_join("points", ","), F.lit("]}]}"))
    routes_.select(body.alias("value")).write.text(path)
    return tables.geometry_faults(tables.read_waypoints(spark, path, lines=True)).select("route_id", "fault")


QUERIES = {
    "geometry_faults": (geometry_faults, f"""WITH {POINTS_SQL}, shaped AS (SELECT route_id, count(*) AS n, CAST(regexp_extract(route_id, '[0-9]+') AS BIGINT) % 25 AS way FROM points GROUP BY route_id)
        SELECT DISTINCT CASE WHEN way = 0 THEN '' ELSE route_id END AS route_id, CASE way WHEN 0 THEN 'no id' WHEN 1 THEN 'a point is not a pair of numbers' WHEN 2 THEN 'the id appears more than once'
          WHEN 3 THEN 'fewer than 2 points' ELSE 'zero length' END AS fault FROM shaped WHERE way < 5 AND (way <> 4 OR n > 1)
        UNION ALL SELECT route_id, 'fewer than 2 points' FROM shaped WHERE n < 2 AND (way > 4 OR way = 4)"""),
    "read_waypoints": (read_waypoints, f"""WITH {POINTS_SQL} SELECT concat(route_id, '/', idx // 1000) AS route_id,
        row_number() OVER (PARTITION BY route_id, idx // 1000 ORDER BY idx) - 1 AS point_no, lat, lon FROM points"""),
    "route_segments": (route_segments, f"WITH {SEGMENTS_SQL} SELECT route_id, idx, round(length_m, 1) AS length_m, round(start_m, 1) AS start_m FROM segments"),
    "route_lengths": (route_lengths, f"""WITH {SEGMENTS_SQL},
        ends AS (SELECT route_id, arg_min(lat1, idx) AS lat1, arg_min(lon1, idx) AS lon1, arg_max(lat2, idx) AS lat2, arg_max(lon2, idx) AS lon2 FROM segments GROUP BY route_id)
        SELECT l.route_id, segments, round(loop_m, 1) AS length_m, round({HAVERSINE_SQL}, 1) AS gap_m, {HAVERSINE_SQL} <= 1 AS closed FROM lengths l JOIN ends e ON l.route_id = e.route_id"""),
    "locate_on_route": (locate_on_route, f"""WITH {SEGMENTS_SQL},
        asked AS (SELECT event_id AS offset_id, concat('r-', user_id) AS route_id, CASE WHEN event_id % 4 = 0 THEN -value ELSE value END * 1000 AS offset_m FROM events),
        wrapped AS (SELECT a.*, fmod(fmod(offset_m, loop_m) + loop_m, loop_m) AS pos_m FROM asked a JOIN lengths l ON a.route_id = l.route_id WHERE loop_m > 0),
        on_segment AS (SELECT w.offset_id, w.route_id, w.pos_m, s.* EXCLUDE (route_id), row_number() OVER (PARTITION BY w.offset_id ORDER BY s.idx DESC) AS rn
          FROM wrapped w JOIN segments s ON w.route_id = s.route_id AND (s.start_m < w.pos_m OR s.start_m = 0)),
        placed AS (SELECT *, CASE WHEN length_m <= 0 THEN 0 ELSE greatest(0, least(1, (pos_m - start_m) / length_m)) END AS f FROM on_segment WHERE rn = 1)
        SELECT offset_id, route_id, idx AS segment, round(lat1 + (lat2 - lat1) * f, 4) AS lat, round(lon1 + (lon2 - lon1) * f, 4) AS lon, round({BEARING_SQL}, 2) AS bearing_deg FROM placed"""),
    "track_legs": (track_legs, f"""WITH {t.CLASSIFIED_SQL},
        tracks AS (SELECT vehicle_id, event_id AS to_event_id, lag(event_id) OVER w AS from_event_id, lag(lat) OVER w AS lat1, lag(lon + lat / 10) OVER w AS lon1, lat AS lat2, lon + lat / 10 AS lon2
          FROM history WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_ts, event_id))
        SELECT vehicle_id, from_event_id, to_event_id, round({HAVERSINE_SQL}, 1) AS distance_m, round({BEARING_SQL}, 2) AS heading_deg FROM tracks WHERE from_event_id IS NOT NULL"""),
    "sequence_gaps": (sequence_gaps, f"""WITH {t.CLASSIFIED_SQL},
        counted AS (SELECT event_id AS src_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS counter FROM events),
        kept AS (SELECT vehicle_id, counter AS sequence, lag(counter) OVER (PARTITION BY vehicle_id ORDER BY counter) AS previous FROM history h JOIN counted c ON h.sequence = c.src_id)
        SELECT vehicle_id, previous, sequence, sequence - previous - 1 AS missing FROM kept WHERE sequence - previous > 1"""),
    "haversine_m": (haversine_m, f"{_PAIRS_SQL} SELECT event_id, round({HAVERSINE_SQL}, 1) AS distance_m FROM pairs"),
    "bearing_deg": (bearing_deg, f"{_PAIRS_SQL} SELECT event_id, round({BEARING_SQL}, 2) AS heading_deg FROM pairs"),
    "wrap_offset": (wrap_offset, "SELECT event_id, round(fmod(fmod(CASE WHEN event_id % 2 = 0 THEN -value ELSE value END, 100) + 100, 100), 6) AS wrapped FROM events"),
    "lerp": (lerp, "SELECT event_id, 10 + 10 * CASE WHEN user_id % 90 = 0 THEN 0 ELSE greatest(0, least(1, (value - 20) / (user_id % 90))) END AS placed FROM events"),
    "kph_to_mps": (kph_to_mps, "SELECT event_id, value / CAST(3.6 AS DOUBLE) AS mps FROM events"),
    "round_tenth": (round_tenth, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * floor(value * 10 + CAST(0.5 AS DOUBLE)) / 10 AS tenth FROM events"),
}
