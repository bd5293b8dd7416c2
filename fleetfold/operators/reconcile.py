"""Checks that log, ledger, history and current state agree, and how far behind a reader is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_offsets(log: DataFrame) -> DataFrame:
    """Next offset and record count of every partition."""
    return log.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("end_offset"), F.count("*").alias("records")
    )


def lag_by_partition(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Records between a reader's position and the end of each partition.

    A reader that never committed has no rows. A partition it has not read yet counts from the
    start; a negative lag is unknown and left out.
    """
    read = committed.select("topic", "partition", F.col("committed"))
    lag = F.col("end_offset") - F.coalesce("committed", F.lit(0))
    started = read.filter(F.col("committed").isNotNull()).select("topic").distinct()
    return (
        ends.join(started, "topic", "left_semi")
        .join(read, ["topic", "partition"], "left")
        .select("topic", "partition", lag.alias("lag"))
        .filter(F.col("lag") >= 0)
    )


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.coalesce(F.sum(F.greatest("lag", F.lit(0))), F.lit(0)).alias("total_lag"))


def reconcile_log_vs_ledger(judged: DataFrame, processed: DataFrame) -> DataFrame:
    """Ids that break "every valid log event is processed exactly once", with the way they break it.

    Both sides are counted per id first, so copies never meet one another: one outer join of unique
    ids finds all three faults.
    """
    logged = judged.filter(F.col("reason").isNull()).groupBy("event_id").agg(F.count("*").alias("in_log"))
    handled = processed.groupBy("event_id").agg(F.count("*").alias("in_ledger"))
    problem = (
        F.when(F.col("in_ledger").isNull(), "never processed")
        .when(F.col("in_log").isNull(), "not in the log")
        .when(F.col("in_ledger") > 1, "processed more than once")
    )
    return (
        logged.join(handled, "event_id", "full")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select("event_id", "problem", F.coalesce("in_log", F.lit(0)).alias("in_log"), F.coalesce("in_ledger", F.lit(0)).alias("in_ledger"))
    )


def key_partition_check(log: DataFrame) -> DataFrame:
    """Keys seen in more than one partition of a topic; empty when the order per key holds."""
    pairs = log.groupBy("topic", "key", "partition").agg(F.count("*").alias("n"))
    return pairs.groupBy("topic", "key").agg(F.count("*").alias("partitions"), F.sum("n").alias("records")).filter(F.col("partitions") > 1)


def partitions_in_use(log: DataFrame) -> DataFrame:
    """The partitions that hold records, and how many keys each one holds."""
    return log.groupBy("topic", "partition", "key").agg(F.count("*").alias("n")).groupBy("topic", "partition").agg(
        F.count("*").alias("keys"), F.sum("n").alias("records")
    )


def match_deliveries(sent: DataFrame, arrived: DataFrame) -> DataFrame:
    """Sent events with their first arrival and latency; NULL when undelivered."""
    first = arrived.groupBy("event_id").agg(F.min("arrived_ms").alias("arrived_ms"))
    return sent.join(first, "event_id", "left").select(
        "event_id", "sent_ms", "arrived_ms", (F.col("arrived_ms") - F.col("sent_ms")).alias("latency_ms")
    )
