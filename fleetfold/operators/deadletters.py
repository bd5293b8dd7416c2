"""Dead letters: the action log, its fold, listings and replay.

Nothing is updated in place. A refusal and a replay mark are both rows of an append-only action
log, and the dead-letter table is their fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.text import error_headline, origin_label, readable_payload, rfc3339, truncate_bytes
from fleetfold.operators.ordered import BLOCK_SECONDS, Running, evenly, running, time_block, top_per_key
from fleetfold.schemas import DEAD_LETTERS, DLQ_ACTIONS, LOG, REASONS, columns

STATES = ("dead", "replayed")
DEFAULT_LIST_LIMIT = 100
HEADER_ERROR_BYTES = 200
# Kept from the refusal that first reported an event, whatever later ones say.
_FIRST = ["raw_payload", "topic", "partition", "offset"]


def _listed(reason: Column) -> Column:
    """A reason of the list; none at all is ``unknown``, any other text is an error of the caller."""
    unlisted = F.raise_error(F.concat(F.lit("not a reason for a refusal: "), reason)).cast("string")
    return F.when(F.coalesce(reason, F.lit("")) == "", "unknown").when(reason.isin(*REASONS), reason).otherwise(unlisted)


def refusals(ledger: DataFrame) -> DataFrame:
    """Ledger rows that were refused, as actions. The action id makes equal instants orderable."""
    rows = ledger.filter(F.col("outcome") == "dead")
    return rows.select(
        "event_id",
        F.lit("refuse").alias("action"),
        F.col("processed_at").alias("action_ts"),
        F.format_string("%010d/%020d/%s", F.col("partition"), F.col("offset"), F.col("topic")).alias("action_id"),
        F.col("value").alias("raw_payload"),
        F.coalesce("error", F.lit("")).alias("error"),
        _listed(F.col("reason")).alias("reason"),
        "attempts",
        "topic",
        "partition",
        "offset",
    )


def marks(winners: DataFrame, at: Column, operator: Column) -> DataFrame:
    """Replay marks for dead letters (event_id) as actions."""
    given = [F.lit("mark").alias("action"), at.alias("action_ts"), operator.alias("action_id")]
    nulls = {c: F.lit(None) for c in ["raw_payload", "error", "reason", "attempts", "topic", "partition", "offset"]}
    rows = winners.select("event_id", *given).withColumns(nulls)
    ddl = dict(zip(columns(DLQ_ACTIONS), ["string", "string", "timestamp", "string", "binary", "string", "string", "int", "string", "int", "bigint"], strict=True))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in ddl.items()])


def mark_outcomes(actions: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Every mark with ``marked``: whether it was the one that flipped the row.

    A mark wins iff the action right before it, for that event, is a refusal: an event is dead
    exactly from a refusal to the next mark.
    """
    order = [F.col("action_ts"), F.col("action_id")]
    narrow = actions.select("event_id", "action", "action_ts", "action_id")
    narrow, block = evenly(narrow, ["event_id"], time_block("action_ts", seconds), order)
    rows = running(narrow, ["event_id"], block, order, Running("_before", "last_before", F.col("action")))
    marked = F.coalesce(F.col("_before") == "refuse", F.lit(False))
    return rows.filter(F.col("action") == "mark").select("event_id", "action_ts", "action_id", marked.alias("marked"))


def fold(actions: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The dead-letter table: attempts add up, the newest failure speaks, the first payload stays.

    A refusal after a mark returns the row to dead. Both aggregates combine before the shuffle, and
    actions are only ordered inside an event-and-hour block, so one event refused without end is
    handled like any other.
    """
    order = F.struct("action_ts", "action_id")
    refused = F.col("action") == "refuse"
    when_refused = F.when(refused, order)
    base = actions.groupBy("event_id").agg(
        F.min_by(F.struct(*_FIRST, "action_ts"), when_refused).alias("first"),
        F.max_by(F.struct("error", "reason", "action_ts"), when_refused).alias("latest"),
        F.sum(F.when(refused, F.col("attempts"))).cast("int").alias("attempts"),
        F.max(when_refused).alias("last_refusal"),
    )
    won = (
        mark_outcomes(actions, seconds)
        .filter("marked")
        .groupBy("event_id")
        .agg(F.max(order).alias("won"))
    )
    replayed = F.coalesce(F.col("won") > F.col("last_refusal"), F.lit(False))
    return (
        base.filter(F.col("last_refusal").isNotNull())
        .join(won, "event_id", "left")
        .select(
            "event_id",
            F.col("first.raw_payload").alias("raw_payload"),
            F.col("latest.error").alias("error"),
            F.col("latest.reason").alias("reason"),
            "attempts",
            F.col("first.action_ts").alias("first_failed_at"),
            F.col("latest.action_ts").alias("last_failed_at"),
            *[F.col(f"first.{c}").alias(c) for c in _FIRST[1:]],
            F.when(replayed, "replayed").otherwise("dead").alias("state"),
            F.when(replayed, F.col("won.action_ts")).alias("replayed_at"),
        )
        .select(*columns(DEAD_LETTERS))
    )


# One row per event: what its actions add up to. Summaries of parts of the action log merge in any order.
SUMMARY = (
    "event_id STRING, first STRUCT<action_ts: TIMESTAMP, action_id: STRING, raw_payload: BINARY, topic: STRING, partition: INT, offset: BIGINT>, "
    "latest STRUCT<action_ts: TIMESTAMP, action_id: STRING, error: STRING, reason: STRING>, attempts BIGINT, "
    "won STRUCT<action_ts: TIMESTAMP, action_id: STRING>"
)


def summarize(actions: DataFrame) -> DataFrame:
    """Actions as ``SUMMARY`` rows. Marks must be winners, as those of a ledger are: it marks dead entries only."""
    refused = F.col("action") == "refuse"
    order = F.when(refused, F.struct("action_ts", "action_id"))
    return actions.groupBy("event_id").agg(
        F.min_by(F.struct("action_ts", "action_id", *_FIRST), order).alias("first"),
        F.max_by(F.struct("action_ts", "action_id", "error", "reason"), order).alias("latest"),
        F.sum(F.when(refused, F.col("attempts"))).cast("bigint").alias("attempts"),
        F.max(F.when(~refused, F.struct("action_ts", "action_id"))).alias("won"),
    )


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One row per event from any number of summaries. Combines before the shuffle; no order is needed."""
    at = lambda c: F.struct(F.col(f"{c}.action_ts"), F.col(f"{c}.action_id"))
    given = lambda c: F.when(F.col(c).isNotNull(), at(c))
    return summaries.groupBy("event_id").agg(
        F.min_by("first", given("first")).alias("first"),
        F.max_by("latest", given("latest")).alias("latest"),
        F.sum("attempts").alias("attempts"),
        F.max("won").alias("won"),
    )


def entries(merged: DataFrame) -> DataFrame:
    """The dead-letter table from merged summaries; equal to ``fold`` of the actions they stand for."""
    last = F.struct("latest.action_ts", "latest.action_id")
    replayed = F.coalesce(F.col("won") > last, F.lit(False))
    return merged.filter(F.col("first").isNotNull()).select(
        "event_id",
        F.col("first.raw_payload").alias("raw_payload"),
        F.col("latest.error").alias("error"),
        F.col("latest.reason").alias("reason"),
        F.col("attempts").cast("int").alias("attempts"),
        F.col("first.action_ts").alias("first_failed_at"),
        F.col("latest.action_ts").alias("last_failed_at"),
        *[F.col(f"first.{c}").alias(c) for c in _FIRST[1:]],
        F.when(replayed, "replayed").otherwise("dead").alias("state"),
        F.when(replayed, F.col("won.action_ts")).alias("replayed_at"),
    ).select(*columns(DEAD_LETTERS))


def depth(dead_letters: DataFrame) -> DataFrame:
    """Rows awaiting replay; always one row, 0 when there are none."""
    return dead_letters.agg(F.count_if(F.col("state") == "dead").alias("depth"))


def normalize_state(state: str | None) -> str | None:
    if state in (None, "", "all"):
        return None
    if state in STATES:
        return state
    raise ValueError(f"state must be dead, replayed or all, not {state!r}")


def list_dead_letters(dead_letters: DataFrame, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest failure first. A limit that is not positive means the default."""
    wanted = normalize_state(state)
    rows = dead_letters if wanted is None else dead_letters.filter(F.col("state") == wanted)
    n = limit if limit and limit > 0 else DEFAULT_LIST_LIMIT
    return rows.orderBy(F.desc("last_failed_at"), "event_id").limit(n)


def listing(dead_letters: DataFrame) -> DataFrame:
    """The columns an operator reads in a listing."""
    return dead_letters.select(
        "event_id",
        "reason",
        "attempts",
        rfc3339(F.col("last_failed_at")).alias("last_failed"),
        origin_label(F.col("topic"), F.col("partition"), F.col("offset")).alias("origin"),
        error_headline(F.col("error")).alias("headline"),
    )


def get_dead_letter(dead_letters: DataFrame, event_id: str) -> DataFrame:
    """One entry, or no row."""
    return dead_letters.filter(F.col("event_id") == event_id)


def detail(entries: DataFrame) -> DataFrame:
    """Everything about an entry, its payload rendered for reading."""
    return entries.withColumns(
        {"payload_bytes": F.octet_length("raw_payload"), "payload_text": readable_payload(F.col("raw_payload"))}
    ).drop("raw_payload")


def recent_failures_by_topic(dead_letters: DataFrame, limit: int) -> DataFrame:
    return top_per_key(dead_letters, ["topic"], [F.desc("last_failed_at"), F.asc("event_id")], limit)


def replay_refusal(state: Column, payload: Column) -> Column:
    """Why an entry may not be replayed; NULL when it may."""
    return F.when(state != "dead", "already replayed").when(
        payload.isNull() | (F.octet_length(payload) == 0), "no stored payload"
    )


def sorted_headers(headers: Column) -> Column:
    """Headers by key, so equal records have equal bytes."""
    return F.array_sort(headers)


def republished(entries: DataFrame) -> DataFrame:
    """Original bytes as log records, keyed by event id, with where they came from in the headers."""
    origin = {
        "x-replay": F.lit("true"),
        "x-origin-topic": F.col("topic"),
        "x-origin-partition": F.col("partition").cast("string"),
        "x-origin-offset": F.col("offset").cast("string"),
        "x-origin-reason": F.col("reason"),
        "x-origin-error": truncate_bytes(F.col("error"), HEADER_ERROR_BYTES),
    }
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in origin.items()])
    return entries.select(
        F.encode("event_id", "UTF-8").alias("key"),
        F.col("raw_payload").alias("value"),
        "topic",
        sorted_headers(headers).alias("headers"),
    )


def plan_replay(
    dead_letters: DataFrame, limit: int | None = None, event_id: str | None = None, everything: bool = False
) -> DataFrame:
    """Entries to replay with ``refusal`` (NULL when eligible).

    One by id, or the newest dead ones up to the limit, or all dead ones, which needs no order and so
    stays spread over the cluster.
    """
    if event_id is not None:
        return plan_requests(dead_letters, dead_letters.sparkSession.createDataFrame([(event_id,)], "event_id STRING"))
    if everything:
        rows = dead_letters.filter(F.col("state") == "dead")
    else:
        rows = list_dead_letters(dead_letters, "dead", limit)
    return rows.withColumn("refusal", replay_refusal(F.col("state"), F.col("raw_payload")))


def plan_requests(dead_letters: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids (event_id), each once, with their entries and ``refusal``: missing, already replayed, or without payload."""
    found = requested.select("event_id").distinct().join(dead_letters, "event_id", "left").select(*columns(DEAD_LETTERS))
    refusal = F.when(F.col("state").isNull(), "no such dead letter").otherwise(replay_refusal(F.col("state"), F.col("raw_payload")))
    return found.withColumn("refusal", refusal)


def eligible(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("refusal").isNull()).drop("refusal")


def replay_into_log(log: DataFrame, replayed: DataFrame) -> DataFrame:
    """A log with republished records appended; they have no position until the log assigns one."""
    blank = {"partition": F.lit(None).cast("int"), "offset": F.lit(None).cast("bigint"), "timestamp": F.lit(None).cast("timestamp")}
    names = columns(LOG)
    return log.select(*names).unionByName(replayed.withColumns(blank).select(*names))
