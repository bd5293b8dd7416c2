"""History, current state and the reads over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions import fields
from fleetfold.functions.rules import frame_verdict
from fleetfold.functions.text import rfc3339_micros, sequence_to_long, stored_sequence
from fleetfold.operators.envelope import POSITION_KINDS, position_columns
from fleetfold.operators.ordered import top_per_key
from fleetfold.schemas import CURRENT, HISTORY, PROCESSED, columns

_STATE = ["route_id", "lat", "lon", "speed_kph", "bearing_deg"]


def processed(ledger: DataFrame) -> DataFrame:
    """One row per event handled with effect."""
    return ledger.filter(F.col("outcome").isin("applied", "late")).select(*columns(PROCESSED))


def history(ledger: DataFrame) -> DataFrame:
    """Every distinct report ever applied, late ones included, with its log position.

    Speed and bearing are stored in single precision; the counter as a signed long.
    """
    rows = ledger.filter(F.col("outcome").isin("applied", "late"))
    stored = {
        "speed_kph": F.col("speed_kph").cast("float"),
        "bearing_deg": F.col("bearing_deg").cast("float"),
        "ingested_at": F.col("processed_at"),
        "sequence": sequence_to_long(F.col("sequence")),
    }
    return rows.withColumns(stored).select(*columns(HISTORY))


def current_state(hist: DataFrame, *more: str) -> DataFrame:
    """Newest report per vehicle; among equal event times the one that arrived first. ``more``: other columns to keep.

    Arrival order is (ingested_at, partition, offset); history knows no topic, so the id settles what
    two topics leave open. A hash aggregate with map-side combine finds
    the winner's position, so a hot vehicle costs one row per task.
    """
    # Negated arrival: among equal event times the earliest is the greatest.
    rank = F.struct("event_ts", -F.unix_micros("ingested_at"), -F.col("partition"), -F.col("offset"), F.col("event_id"))
    kept = F.struct(*_STATE, F.col("event_ts").alias("last_event_ts"), F.col("event_id").alias("last_event_id"), F.col("ingested_at").alias("updated_at"), *more)
    return hist.groupBy("vehicle_id").agg(F.max_by(kept, rank).alias("s")).select("vehicle_id", "s.*").select(*columns(CURRENT), *more)


def guarded_upsert(current: DataFrame, incoming: DataFrame, *more: str) -> DataFrame:
    """Current state after ``incoming`` (history rows): replaced only by a strictly newer event.

    Both sides have at most one row per vehicle when they meet, so the merge is one aggregate over
    their union and needs no hot-key care. On a tie the stored row stays.
    """
    newest = current_state(incoming, *more).withColumn("_incoming", F.lit(1))
    both = current.withColumn("_incoming", F.lit(0)).unionByName(newest)
    rest = [c for c in columns(CURRENT) if c != "vehicle_id"]
    winner = F.max_by(F.struct(*rest, *more), F.struct("last_event_ts", -F.col("_incoming")))
    return both.groupBy("vehicle_id").agg(winner.alias("s")).select("vehicle_id", "s.*").select(*columns(CURRENT), *more)


def current_position(current: DataFrame, vehicle_ids: list[str] | None = None) -> DataFrame:
    """Where each vehicle is now, with the counter of the report it came from; unknown -> no row.

    ``current`` carries ``sequence`` beside its own columns (``current_state(hist, "sequence")``), so no history is read.
    """
    if vehicle_ids is not None:
        current = current.filter(F.col("vehicle_id").isin(vehicle_ids))
    return current.select(
        F.col("last_event_id").alias("event_id"),
        "vehicle_id",
        *_STATE,
        F.col("last_event_ts").alias("event_ts"),
        stored_sequence(F.col("sequence")).alias("sequence"),
    )


def history_summary(hist: DataFrame) -> DataFrame:
    return hist.groupBy("vehicle_id").agg(F.max("event_ts").alias("newest_event_ts"), F.count("*").alias("reports"))


def state_drift(current: DataFrame, hist: DataFrame) -> DataFrame:
    """Vehicles whose current event time is not the newest in their history."""
    return (
        current.select("vehicle_id", "last_event_ts")
        .join(history_summary(hist), "vehicle_id")
        .filter(F.col("last_event_ts") != F.col("newest_event_ts"))
        .select("vehicle_id", "last_event_ts", "newest_event_ts", "reports")
    )


def schema_versions(ledger: DataFrame) -> DataFrame:
    """Versions actually processed; duplicates and refusals do not count."""
    rows = ledger.filter(F.col("outcome").isin("applied", "late"))
    return rows.groupBy("schema_version", "event_type").agg(
        F.count("*").alias("event_count"),
        F.min("processed_at").alias("first_seen_at"),
        F.max("processed_at").alias("last_seen_at"),
    )


def vehicle_track(hist: DataFrame, limit: int) -> DataFrame:
    """Newest reports of every vehicle, ranked."""
    return top_per_key(hist, ["vehicle_id"], [F.desc("event_ts"), F.desc("event_id")], limit)


def route_activity(hist: DataFrame, limit: int) -> DataFrame:
    """Newest reports on every route, ranked."""
    return top_per_key(hist, ["route_id"], [F.desc("event_ts"), F.desc("event_id")], limit)


def fleet_snapshot_counts(hist: DataFrame, prefix: str) -> DataFrame:
    """Vehicles and reports whose vehicle id starts with a prefix."""
    return hist.filter(F.col("vehicle_id").startswith(prefix)).groupBy("vehicle_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("vehicles"), F.coalesce(F.sum("n"), F.lit(0)).alias("positions")
    )


def fanout_frames(classified: DataFrame) -> DataFrame:
    """The nine fields a viewer needs, of every event that changed the history.

    Frames carry the double the producer sent, not the single-precision value the history stores.
    """
    rows = classified.filter(F.col("outcome").isin("applied", "late"))
    rows = rows.filter(frame_verdict(F.col("event_id"), F.col("vehicle_id"), F.col("event_ts")).isNull())
    return rows.select("event_id", "vehicle_id", *_STATE, "event_ts", "sequence")


def frame_json(frames: DataFrame) -> Column:
    """A frame as it is written to the bus."""
    return F.to_json(
        F.struct("event_id", "vehicle_id", *_STATE, rfc3339_micros(F.col("event_ts")).alias("event_ts"), "sequence"),
        {"ignoreNullFields": "true"},
    )


def decode_frames(bus: DataFrame, column: str = "frame") -> DataFrame:
    """Frames off the bus; one that cannot be read or lacks an identity is dropped, never refused."""
    kinds = {"event_id": "string", **POSITION_KINDS}
    parsed = fields.parse_document(bus.select(column), F.col(column), kinds)
    frame = {"event_id": F.col("event_id"), **position_columns()}
    verdict = frame_verdict(frame["event_id"], frame["vehicle_id"], frame["event_ts"])
    usable = fields.once(parsed, (~F.col("_broken") & verdict.isNull()).alias("_usable")).filter("_usable")
    return usable.select(*[c.alias(n) for n, c in frame.items()])


def viewer_state(frames: DataFrame) -> DataFrame:
    """Newest frame per vehicle as a viewer keeps it: on a tie the one that arrived last (``arrival``)."""
    kept = F.struct("event_id", *_STATE, "event_ts")
    return (
        frames.groupBy("vehicle_id")
        .agg(F.max_by(kept, F.struct("event_ts", "arrival")).alias("s"), F.count("*").alias("frames"))
        .select("vehicle_id", "s.*", "frames")
    )


def viewer_seam(replayed: DataFrame, live: DataFrame) -> DataFrame:
    """Replayed and live frames may both carry an event; a viewer keeps one per id."""
    return replayed.unionByName(live).dropDuplicates(["event_id"])


def fleet_bbox(frames: DataFrame) -> DataFrame:
    return frames.agg(
        F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.min("lon").alias("west")
    )
