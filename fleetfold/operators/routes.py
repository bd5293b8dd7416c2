"""Geometry of routes and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.functions import geo
from fleetfold.operators.ordered import BLOCK_SECONDS, Running, evenly, offset_block, running, salted_join, time_block

# Waypoints per block of a route.
BLOCK_POINTS = 1 << 16


def route_segments(waypoints: DataFrame, points_per_block: int = BLOCK_POINTS) -> DataFrame:
    """Consecutive waypoints of each route with length and distance from the start."""
    before = F.struct("idx", "lat", "lon")
    pairs = running(
        waypoints, ["route_id"], offset_block("idx", points_per_block), [F.col("idx")], Running("_from", "last_before", before)
    ).filter(F.col("_from").isNotNull())
    segments = pairs.select(
        "route_id",
        F.col("_from.idx").alias("idx"),
        F.col("_from.lat").alias("lat1"),
        F.col("_from.lon").alias("lon1"),
        F.col("lat").alias("lat2"),
        F.col("lon").alias("lon2"),
    ).withColumn("length_m", geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return running(
        segments, ["route_id"], offset_block("idx", points_per_block), [F.col("idx")], Running("start_m", "sum_before", F.col("length_m"))
    ).withColumn("end_m", F.col("start_m") + F.col("length_m"))


def route_lengths(waypoints: DataFrame, points_per_block: int = BLOCK_POINTS) -> DataFrame:
    """Total length of each route and how far its end lies from its start."""
    segments = route_segments(waypoints, points_per_block)
    ends = segments.groupBy("route_id").agg(
        F.sum("length_m").alias("length_m"),
        F.count("*").alias("segments"),
        F.min_by(F.struct("lat1", "lon1"), "idx").alias("a"),
        F.max_by(F.struct("lat2", "lon2"), "idx").alias("b"),
    )
    gap = geo.haversine_m(F.col("a.lat1"), F.col("a.lon1"), F.col("b.lat2"), F.col("b.lon2"))
    return ends.select("route_id", "segments", "length_m", gap.alias("gap_m")).withColumn("closed", F.col("gap_m") <= 1.0)


def locate_on_route(offsets: DataFrame, segments: DataFrame, lengths: DataFrame, blocks_per_route: int = 1024) -> DataFrame:
    """Position and heading at ``offset_m`` along ``route_id``; an offset wraps around the loop.

    A range join would pair every offset of a route with every segment of it. Segments and offsets
    are merged along the distance instead, and each offset takes the last segment that starts before
    it: an ordered "last value", in blocks of distance, like every other ordered operator here.
    ``offsets`` needs a unique ``offset_id``.
    """
    usable = lengths.filter(F.col("length_m") > 0).select("route_id", F.col("length_m").alias("_loop"))
    at = salted_join(offsets, usable, "route_id").withColumn("_at", geo.wrap_offset(F.col("offset_m"), F.col("_loop")))
    queries = at.select(
        "route_id", "offset_id", "offset_m", "_at", F.lit(None).cast("bigint").alias("_seg"), "_loop",
        *[F.lit(None).cast("double").alias(c) for c in ["lat1", "lon1", "lat2", "lon2", "start_m", "length_m"]],
    )
    starts = salted_join(segments, usable, "route_id").select(
        "route_id", F.lit(None).cast("bigint").alias("offset_id"), F.lit(None).cast("double").alias("offset_m"),
        F.col("start_m").alias("_at"), F.col("idx").cast("bigint").alias("_seg"), "_loop",
        "lat1", "lon1", "lat2", "lon2", "start_m", "length_m",
    )
    merged = queries.unionByName(starts)
    segment = F.when(F.col("_seg").isNotNull(), F.struct("_seg", "lat1", "lon1", "lat2", "lon2", "start_m", "length_m"))
    block = [F.floor(F.col("_at") / F.col("_loop") * blocks_per_route)]
    # An offset exactly on a boundary belongs to the segment that ends there, so offsets sort first.
    order = [F.col("_at"), F.coalesce("_seg", F.lit(-1)), F.coalesce("offset_id", F.lit(-1))]
    merged, block = evenly(merged, ["route_id"], block, order)
    found = running(merged, ["route_id"], block, order, Running("_on", "last_before", segment)).filter(F.col("offset_id").isNotNull())
    # Only offset 0 has no segment before it: it starts the loop.
    first = segments.groupBy("route_id").agg(
        F.min_by(F.struct(F.col("idx").cast("bigint").alias("_seg"), "lat1", "lon1", "lat2", "lon2", "start_m", "length_m"), "idx").alias("_first")
    )
    on = F.col("_s")
    into = F.col("_at") - on["start_m"]
    return (
        salted_join(found, first, "route_id")
        .withColumn("_s", F.coalesce("_on", "_first"))
        .select(
            "offset_id",
            "route_id",
            "offset_m",
            on["_seg"].alias("segment"),
            geo.lerp(on["lat1"], on["lat2"], into, on["length_m"]).alias("lat"),
            geo.lerp(on["lon1"], on["lon2"], into, on["length_m"]).alias("lon"),
            geo.bearing_deg(on["lat1"], on["lon1"], on["lat2"], on["lon2"]).alias("bearing_deg"),
        )
    )


def track_legs(hist: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Distance and heading from each report of a vehicle to its next one by (event_ts, event_id)."""
    before = F.struct("event_id", "event_ts", "lat", "lon")
    order = [F.col("event_ts"), F.col("event_id")]
    narrow = hist.select("vehicle_id", "event_id", "event_ts", "lat", "lon")
    narrow, block = evenly(narrow, ["vehicle_id"], time_block("event_ts", seconds), order)
    rows = running(narrow, ["vehicle_id"], block, order, Running("_from", "last_before", before))
    rows = rows.filter(F.col("_from").isNotNull())
    ends = [F.col("_from.lat"), F.col("_from.lon"), F.col("lat"), F.col("lon")]
    return rows.select(
        "vehicle_id",
        F.col("_from.event_id").alias("from_event_id"),
        F.col("event_id").alias("to_event_id"),
        geo.haversine_m(*ends).alias("distance_m"),
        geo.bearing_deg(*ends).alias("heading_deg"),
    )


def sequence_gaps(hist: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """Jumps in a vehicle's own counter: ``missing`` reports before ``sequence``."""
    order = [F.col("sequence"), F.col("event_id")]
    narrow = hist.select("vehicle_id", "event_id", "sequence")
    narrow, block = evenly(narrow, ["vehicle_id"], offset_block("sequence", block_rows), order)
    rows = running(narrow, ["vehicle_id"], block, order, Running("previous", "last_before", F.col("sequence")))
    missing = F.col("sequence") - F.col("previous") - 1
    return rows.withColumn("missing", missing).filter(F.col("missing") > 0).select("vehicle_id", "previous", "sequence", "missing")
