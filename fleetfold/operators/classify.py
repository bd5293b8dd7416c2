"""applied / duplicate / late / dead for every record of a log.

Processing order is (partition, offset, topic) within a batch, batches in turn. A valid row is a duplicate
iff an earlier valid row (or the ledger) has its id; a non-duplicate is late iff its event time is
not strictly newer than everything its vehicle reported before.

Only narrow columns take part: ids are reduced to their first position by a hash-combining
aggregate, so a third of the log being copies of one id costs one row per task, and the verdicts
come back to the wide rows in a single join on the unique, evenly spread log position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.operators.ordered import BLOCK_ROWS, Running, log_block, running
from fleetfold.schemas import OUTCOMES

# Fixed value: how often a transient failure is tried again.
MAX_RETRIES = 5

POSITION_KEY = ["topic", "partition", "offset"]


def first_occurrence(valid: DataFrame) -> DataFrame:
    """One row per event_id: where it first occurs, and what the late rule needs to know of it."""
    earliest = F.min(F.struct("partition", "offset", "topic", "vehicle_id", "event_ts"))
    return valid.groupBy("event_id").agg(earliest.alias("first")).select("event_id", "first.*")


def dedup_against_ledger(firsts: DataFrame, ledger_ids: DataFrame) -> DataFrame:
    """Drop ids handled before. Both sides hold each id once, so no key is hot.

    ``ledger_ids`` may be all handled ids or those of the buckets that the batch falls into (``known_ids``).
    """
    return firsts.join(ledger_ids.select("event_id"), "event_id", "left_anti")


def classify_late(firsts: DataFrame, current: DataFrame | None = None, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``late``. ``current`` (vehicle_id, last_event_ts) is the state before this batch."""
    seed = None if current is None else (current, "last_event_ts", "_newest")
    order = [F.col("partition"), F.col("offset"), F.col("topic")]
    marked = running(
        firsts, ["vehicle_id"], log_block(rows_per_block), order, Running("_newest", "max_before", F.col("event_ts")), seed=seed
    )
    late = F.coalesce(F.col("event_ts") <= F.col("_newest"), F.lit(False))
    return marked.withColumn("late", late).drop("_newest")


def classify(
    judged: DataFrame,
    ledger_ids: DataFrame | None = None,
    current: DataFrame | None = None,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``outcome`` to judged rows (see ``envelope.judge``)."""
    firsts = first_occurrence(judged.filter(F.col("reason").isNull()))
    if ledger_ids is not None:
        firsts = dedup_against_ledger(firsts, ledger_ids)
    fates = classify_late(firsts, current, rows_per_block).select(*POSITION_KEY, "late")
    outcome = (
        F.when(F.col("reason").isNotNull(), "dead")
        .when(F.col("late").isNull(), "duplicate")
        .when(F.col("late"), "late")
        .otherwise("applied")
    )
    return judged.join(fates, POSITION_KEY, "left").withColumn("outcome", outcome).drop("late")


def outcome_ledger(classified: DataFrame) -> DataFrame:
    """Rows by outcome; an outcome that did not occur is reported as 0."""
    spark = classified.sparkSession
    all_outcomes = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome STRING")
    counts = classified.groupBy("outcome").agg(F.count("*").alias("n"))
    return all_outcomes.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("events"))


def dead_by_reason(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("outcome") == "dead").groupBy("reason").agg(F.count("*").alias("events"))


def committable_prefix(handled: DataFrame) -> DataFrame:
    """Next offset to read per topic and partition: what precedes the first record that could not be finished.

    ``handled`` has ``failed`` per record. A partition whose first record failed commits nothing and
    has no row. Records are counted per block of offsets before anything is joined, so the join meets
    a row per block; only the blocks in which a partition stops are looked into again.
    """
    where = ["topic", "partition"]
    blocks = handled.groupBy(*where, F.floor(F.col("offset") / BLOCK_ROWS).alias("_block")).agg(
        F.min(F.when(F.col("failed"), F.col("offset"))).alias("_stop"), F.max("offset").alias("_last"), F.count("*").alias("_n")
    )
    stops = blocks.groupBy(*where).agg(F.min("_stop").alias("_first"))
    whole = blocks.join(stops, where).filter(F.col("_first").isNull() | (F.col("_last") < F.col("_first")))
    cut = stops.filter(F.col("_first").isNotNull()).withColumn("_block", F.floor(F.col("_first") / BLOCK_ROWS))
    inside = handled.select(*where, "offset", F.floor(F.col("offset") / BLOCK_ROWS).alias("_block")).join(cut, [*where, "_block"])
    part = inside.filter(F.col("offset") < F.col("_first")).groupBy(*where).agg(F.max("offset").alias("_last"), F.count("*").alias("_n"))
    done = whole.select(*where, "_last", "_n").unionByName(part)
    return done.groupBy(*where).agg((F.max("_last") + 1).alias("next_offset"), F.sum("_n").alias("records"))


def retry_budget(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """What becomes of records whose handling failed: add ``verdict`` and ``reason``.

    ``attempts`` has per record how often it was tried and whether its last failure was ``transient``.
    A permanent failure is refused at once; a transient one is tried again until it has been tried
    more than ``max_retries`` times.
    """
    spent = F.col("transient") & (F.col("attempts") > max_retries)
    verdict = F.when(~F.col("transient") | spent, "dead").otherwise("retry")
    reason = F.when(~F.col("transient"), "decode").when(spent, "retries_exhausted")
    return attempts.withColumns({"verdict": verdict, "reason": reason})
