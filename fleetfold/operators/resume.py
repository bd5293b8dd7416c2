"""Resuming many readers from the last event each one saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.text import stored_sequence
from fleetfold.operators.ordered import Running, evenly, running, salted_join, time_block

DEFAULT_LIMIT = 1000
# Time width of a block of the global order.
BLOCK_SECONDS = 60
# Fixed value: how far back a reader may resume, seconds.
DEFAULT_WINDOW_SECONDS = 15 * 60


def resume_points(clients: DataFrame, hist: DataFrame) -> DataFrame:
    """``event_ts`` of every client's last event; NULL when it has none or the history lacks it.

    Clients are first reduced to distinct ids: many may have stopped at the same event.
    """
    known = (
        hist.select(F.col("event_id").alias("last_event_id"), "event_ts")
        .join(clients.select("last_event_id").distinct(), "last_event_id", "left_semi")
    )
    return salted_join(clients, known, "last_event_id", "left").select("client_id", "last_event_id", "event_ts")


def resume_verdict(points: DataFrame, now: Column, window_seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """ready (no id) / reset (unknown id, or past the window) / resumed."""
    age = F.unix_micros(now) - F.unix_micros(F.col("event_ts").cast("timestamp"))
    too_old = (age > window_seconds * 1_000_000) if window_seconds > 0 else F.lit(False)
    verdict = (
        F.when(F.coalesce("last_event_id", F.lit("")) == "", "ready")
        .when(F.col("event_ts").isNull() | too_old, "reset")
        .otherwise("resumed")
    )
    return points.withColumn("verdict", verdict)


def positions_since(hist: DataFrame, after: Column, after_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One reader: history strictly after (time, id), in that order, at most ``limit`` rows.

    A reader that saw nothing has no point to resume from; an empty id is refused.

    Written as two plain comparisons so that the whole predicate reaches the parquet scan.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if not after_id:
        raise ValueError("a reader resumes after an event; its id is empty")
    ts = F.col("event_ts")
    newer = (ts >= after) & ((ts > after) | (F.col("event_id") > F.lit(after_id)))
    return (
        hist.filter(newer)
        .withColumn("sequence", stored_sequence(F.col("sequence")))
        .orderBy("event_ts", "event_id")
        .limit(limit)
    )


def ranked_history(hist: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """History with ``position``: its 1-based place in the global (event_ts, event_id) order.

    No single sort: rows are numbered inside blocks and blocks carry the count before them.
    """
    everything = hist.withColumn("_all", F.lit(0))
    order = [F.col("event_ts"), F.col("event_id")]
    rows, block = evenly(everything, ["_all"], time_block("event_ts", seconds), order)
    return running(rows, ["_all"], block, order, Running("position", "sum", F.lit(1).cast("bigint"))).drop("_all")


def resume(
    clients: DataFrame,
    hist: DataFrame,
    now: Column,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    limit: int = DEFAULT_LIMIT,
    block_seconds: int = BLOCK_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(verdict and frame count per client, the frames themselves in order).

    A range join of clients and history would pair every client with everything newer than its
    point before the limit cut it. Instead the history is numbered once; a client at position p
    wants exactly p+1 … p+limit, which is an equi-join on the position. Clients that stopped at the
    same event share their frames until the last step.

    A point older than the window is a reset like an unknown one, and all that follows a younger one
    is in the window too; so only the window is read, and the filter reaches the scan.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if window_seconds > 0:
        oldest = now.cast("timestamp") - F.make_dt_interval(secs=F.lit(window_seconds))
        hist = hist.filter(F.col("event_ts") >= oldest.cast(hist.schema["event_ts"].dataType))
    ranked = ranked_history(hist.withColumn("sequence", stored_sequence(F.col("sequence"))), block_seconds)
    points = resume_verdict(resume_points(clients, hist), now, window_seconds)

    starts = (
        points.filter(F.col("verdict") == "resumed")
        .select("last_event_id").distinct()
        .join(ranked.select(F.col("event_id").alias("last_event_id"), F.col("position").alias("start")), "last_event_id")
    )
    total = ranked.select(F.max("position")).scalar()
    ends = starts.select("last_event_id", "start", F.least(F.lit(limit), total - F.col("start")).alias("frames"))
    counts = ends.select("last_event_id", "frames")
    verdicts = salted_join(points, counts, "last_event_id", "left").select(
        "client_id", "verdict", F.when(F.col("verdict") == "resumed", F.col("frames")).otherwise(F.lit(0)).cast("bigint").alias("frames")
    )
    wanted = ends.filter(F.col("frames") > 0).select(
        "last_event_id", "start", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("frames"))).alias("position")
    )
    frames = wanted.join(ranked, "position").withColumn("frame_no", F.col("position") - F.col("start"))
    resumed = points.filter(F.col("verdict") == "resumed").select("client_id", "last_event_id")
    return verdicts, salted_join(resumed, frames.drop("start", "position"), "last_event_id")
