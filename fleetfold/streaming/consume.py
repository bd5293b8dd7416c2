"""The streaming job: log -> verdicts -> ledger -> live frames.

At-least-once delivery with an idempotent sink: the checkpoint advances after ``foreachBatch``
returns, and a batch that the ledger has recorded is not applied again. No watermark: a late report is kept,
counted and published, it only does not move the current state.

A writer beside the ledger (``deliver``) may fail for single records. A record that failed for a passing reason
is tried again with the next batch, and everything behind it in its partition waits in the ledger's queue, so
the order within a partition holds and what was committed is a prefix. When a record has been tried too often, or its failure
cannot pass, it is refused and the partition goes on.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfold.operators import classify, deadletters, state
from fleetfold.operators.envelope import judge
from fleetfold.schemas import LEDGER, LOG, columns
from fleetfold.sources import segments
from fleetfold.streaming.ledger import Ledger

log = logging.getLogger(__name__)

Hook = Callable[[str], None]
# Gets the records whose turn it is (judged) and returns those it could not write: topic, partition, offset,
# transient, error. Records may be handed over more than once, so writing them twice must do no harm.
Deliver = Callable[[DataFrame], DataFrame]
WHERE = ["topic", "partition"]
RETRY_RUN = "retries"
FEW = 100_000  # failed records of a batch that are copied to every task


def backoff(tries: Column, base_seconds: float) -> Column:
    """Seconds until a record is tried again: doubled every time."""
    return F.lit(base_seconds) * F.pow(F.lit(2.0), tries - 1)


def held_back(judged: DataFrame, waiting: DataFrame, now: datetime) -> DataFrame:
    """Add ``held``: records at or behind the first of their partition that is not due yet. ``waiting``: those with a due time."""
    stops = waiting.filter(F.col("due_at") > F.lit(now).cast("timestamp")).groupBy(*WHERE).agg(F.min("offset").alias("_stop"))
    # A row per partition, copied to the records: by its partition alone a record would go to one of very few tasks.
    return judged.join(F.broadcast(stops), WHERE, "left").withColumn("held", F.coalesce(F.col("offset") >= F.col("_stop"), F.lit(False))).drop("_stop")


def failures(judged: DataFrame, found: DataFrame, max_retries: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """What becomes of the records that a writer could not write (``found``); None if there are none.

    A row per position and tries so far; ``keep`` holds what must not be computed twice. Up to ``FEW`` rows are copied to every
    task that looks for them, so that the records stay where they are.
    """
    failed = found.groupBy(*classify.POSITION_KEY).agg(F.min("transient").alias("transient"), F.first("error").alias("_error"))
    # The writer is asked here and only here.
    count = keep(failed).count()
    if not count:
        return None
    few = (lambda frame: F.broadcast(frame.coalesce(1))) if count <= FEW else (lambda frame: frame)
    tried = judged.select(*classify.POSITION_KEY, "tries", (F.col("tries") + 1).alias("attempts")).join(few(failed), classify.POSITION_KEY).distinct()
    verdicts = classify.retry_budget(tried, max_retries).withColumnRenamed("reason", "_given_up")
    return few(keep(verdicts.select(*classify.POSITION_KEY, "tries", "verdict", "_given_up", "_error")))


def delivered(judged: DataFrame, verdicts: DataFrame, base_seconds: float, now: datetime) -> DataFrame:
    """Judged records after delivery: ``held`` ones wait, given up ones are refused, ``tries`` and ``due_at`` are set.

    A partition stops at its first record that is to be tried again. What lies behind it has not had its turn,
    whatever the writer did with it: it keeps its tries and is handed over again.
    """
    stops = verdicts.filter("verdict = 'retry'").groupBy(*WHERE).agg(F.min("offset").alias("_stop"))
    rows = judged.join(verdicts, [*classify.POSITION_KEY, "tries"], "left").join(F.broadcast(stops), WHERE, "left")
    turn = F.col("verdict").isNotNull() & F.coalesce(F.col("offset") <= F.col("_stop"), F.lit(True))
    given_up, attempts = turn & F.col("_given_up").isNotNull(), F.col("tries") + 1
    due = F.timestamp_add("MICROSECOND", (backoff(attempts, base_seconds) * 1_000_000).cast("bigint"), F.lit(now).cast("timestamp"))
    out = rows.withColumns(
        {
            "held": F.col("held") | F.coalesce(F.col("offset") >= F.col("_stop"), F.lit(False)),
            "tries": F.when(turn, attempts).otherwise(F.col("tries")),
            "due_at": F.when(turn & (F.col("verdict") == "retry"), due).otherwise(F.col("due_at")),
            "reason": F.when(given_up, F.col("_given_up")).otherwise(F.col("reason")),
            "error": F.when(given_up, F.col("_error")).otherwise(F.col("error")),
            "attempts": F.when(given_up, attempts).otherwise(F.col("attempts")),
        }
    )
    return out.select(*judged.columns)


def _without_bytes(judged: DataFrame) -> DataFrame:
    """Judged records with the bytes of refused ones only."""
    return judged.withColumns({c: F.when(F.col("reason").isNotNull(), F.col(c)) for c in ("key", "value")})


def _positions(records: DataFrame) -> list[tuple[str, int, int]]:
    """Next offset of every partition: where it is held back, else behind its last record. A row per partition."""
    ends = records.groupBy(*WHERE).agg(F.min(F.when(F.col("held"), F.col("offset"))).alias("stop"), (F.max("offset") + 1).alias("end"))
    return [(r["topic"], r["partition"], r["end"] if r["stop"] is None else r["stop"]) for r in ends.collect()]


def consume_batch(
    records: DataFrame,
    ledger: Ledger,
    run_id: str,
    batch_id: int,
    consumer_id: str = "fleetfold",
    publish: Callable[[DataFrame], None] | None = None,
    after: Hook | None = None,
    deliver: Deliver | None = None,
    max_retries: int = classify.MAX_RETRIES,
    retry_seconds: float = 0.2,
    now: datetime | None = None,
) -> None:
    """Handle one batch of log records.

    The order of writes is the guarantee: the copy on the dead-letter topic survives the ledger being
    unreachable, so it comes first; frames are published last, so none is ever seen without a row behind it,
    and losing one is harmless. ``after`` is called with the name of each finished step (tests use it
    to fail between them).
    """
    step = after or (lambda name: None)
    base = ledger.manifest()
    if ledger.handled(run_id, batch_id, base):
        return
    now = now or datetime.now(timezone.utc)
    step("begin")
    judged = judge(records.select(*columns(LOG), F.lit(0).alias("tries"), F.lit(None).cast("timestamp").alias("due_at")))
    if base["queue"]:
        # What waits was judged when it came.
        waiting = ledger.queue(base)
        judged = held_back(judged.unionByName(waiting), waiting, now)
    else:
        judged = judged.withColumn("held", F.lit(False))
    keeps_bytes = deliver is not None or base["queue"]
    kept: list[DataFrame] = []

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return rows

    try:
        settled = judged = keep(judged if keeps_bytes else _without_bytes(judged))
        if deliver is not None:
            verdicts = failures(judged, deliver(judged.filter("NOT held AND reason IS NULL")), max_retries, keep)
            settled = judged if verdicts is None else delivered(judged, verdicts, retry_seconds, now)
        positions = _positions(settled)
        queue = settled.filter("held") if keeps_bytes else None
        if queue is not None and queue.isEmpty():
            queue = None
        # Bytes are wanted of what waits and what is refused; they are most of what the verdicts would move.
        todo = _without_bytes(settled.filter("NOT held"))
        firsts = classify.first_occurrence(todo.filter(F.col("reason").isNull()))
        known = ledger.known(firsts, todo.count(), base)
        outcome = classify.classify(todo, known, ledger._current(base))

        refused = todo.filter(F.col("reason").isNotNull())
        refused.select("key", "value").write.mode("overwrite").parquet(f"{ledger.root}/dlq_topic/commit={run_id}-{batch_id}")
        step("dlq_topic")
        stamped = outcome.withColumns(
            {
                "processed_at": F.lit(now).cast("timestamp"),
                "consumer_id": F.lit(consumer_id),
                "key": F.when(F.col("outcome") == "dead", F.col("key")),
                "value": F.when(F.col("outcome") == "dead", F.col("value")),
            }
        )
        stored = ledger.commit_batch(base, run_id, batch_id, stamped.select(*columns(LEDGER)), queue, positions, step, with_frames=publish is None)
    finally:
        for rows in kept:
            rows.unpersist()
    if publish is not None:
        try:
            publish(state.fanout_frames(stored))
        except Exception:  # the rows are durable; a viewer that missed a frame resumes from history
            log.warning("publishing frames of batch %s failed", batch_id, exc_info=True)
    step("frames")
    ledger.compact(after)


def drain_retries(ledger: Ledger, deliver: Deliver, wait: Callable[[float], None] | None = None, **how) -> int:
    """Try what waits until nothing does; returns the rounds it took. Ends, as every record's tries are limited.

    Time is taken from the records' own due times, so nothing sleeps unless ``wait`` is given seconds to.
    """
    rounds = 0
    while (manifest := ledger.manifest())["queue"]:
        due = ledger.queue(manifest).agg(F.max(F.unix_micros("due_at"))).first()[0]
        now = datetime.now(timezone.utc)
        later = now if due is None else max(now, datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=due + 1))
        if wait is not None:
            wait((later - now).total_seconds())
        nothing = ledger.spark.createDataFrame([], LOG)
        consume_batch(nothing, ledger, RETRY_RUN, manifest["runs"].get(RETRY_RUN, -1) + 1, deliver=deliver, now=later, **how)
        rounds += 1
    return rounds


def consume_log(
    spark: SparkSession, path: str, ledger: Ledger, max_records: int, run_id: str = "log", rewind: bool = False, in_order: bool = False, **how
) -> list[int]:
    """Drain a log of segments in micro-batches of ``max_records`` at the most; returns the number of each.

    Positions come from the ledger's manifest, so a batch and the position behind it are committed at once and
    there is no checkpoint beside it. ``rewind`` reads from the beginning; what was handled is absorbed. Give it
    a ``run_id`` of its own. ``in_order`` drains partition after partition, so what becomes of every record is what one
    batch of the whole log would have made of it, even where a key lies in several partitions.
    """
    manifest = ledger.manifest()
    positions: segments.Positions = {} if rewind else {(t, p): n for t, p, n in manifest["positions"]}
    number, sizes = manifest["runs"].get(run_id, -1) + 1, []
    while stops := segments.next_stops(spark, path, positions, max_records, in_order):
        batch = segments.read(spark, path, {k: positions.get(k, 0) for k in stops}, stops)
        sizes.append(batch.count())
        consume_batch(batch, ledger, run_id, number, **how)
        positions |= stops
        number += 1
    return sizes


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query when its checkpoint was created; a new checkpoint is a new run."""
    return spark.read.schema("id STRING").json(f"{checkpoint.rstrip('/')}/metadata").first()[0]


def run_stream(
    source: DataFrame,
    ledger: Ledger,
    checkpoint: str,
    consumer_id: str = "fleetfold",
    available_now: bool = True,
    publish: Callable[[DataFrame], None] | None = None,
    after: Hook | None = None,
    deliver: Deliver | None = None,
    max_retries: int = classify.MAX_RETRIES,
) -> StreamingQuery:
    """Start the job. ``available_now`` drains what is there and stops, else it keeps running."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # A stream plans its own micro-batch without adaptive execution; what follows here is a batch
        # job over it, and wants the measured joins and skew handling of one.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        run = _run_id(batch.sparkSession, checkpoint)
        consume_batch(batch, ledger, run, batch_id, consumer_id, publish, after, deliver, max_retries)

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def replay(
    ledger: Ledger,
    produce: Callable[[DataFrame], None],
    at,
    operator: str,
    event_id: str | None = None,
    limit: int | None = None,
    everything: bool = False,
    requested: DataFrame | None = None,
) -> DataFrame:
    """Put dead letters back on their topic, then mark them. Returns every entry with its refusal.

    ``requested`` (event_id) names entries, as ``event_id`` names one; ids that are not there are refused as such.
    Publish first: a crash in between republishes an event again, which the ledger absorbs; the other
    order could lose it. Ineligible entries do not stop the rest.
    """
    found = ledger.dead_letters()
    plan = deadletters.plan_requests(found, requested) if requested is not None else deadletters.plan_replay(found, limit, event_id, everything)
    plan = plan.persist(StorageLevel.MEMORY_AND_DISK)
    ready = deadletters.eligible(plan)
    produce(deadletters.republished(ready))
    ledger.mark_replayed(ready, at, operator)
    return plan
