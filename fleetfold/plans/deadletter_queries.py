"""Queries over dead letters: action log, fold, listings, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions import text
from fleetfold.operators import deadletters as dl
from fleetfold.plans import telemetry as t
from fleetfold.schemas import DEAD_LETTERS, DLQ_ACTIONS
from fleetfold.session import work_dir
from fleetfold.sources import tables

D = t.CLASSIFIED_SQL + t.NAME_BASED_SQL


def _actions(spark, sf):
    """Refusals of the log, then per event: later refusals, marks that race, refusals after a mark.

    Stored as one table, as a ledger has it, since every fold reads the actions four times.
    """
    path = work_dir(spark, "refusals")
    dl.refusals(t.classified(spark, sf)).write.parquet(path)
    first = tables.read_table(spark, path, DLQ_ACTIONS)
    off = F.col("offset")
    again = first.filter(off % 3 == 0).withColumns(
        {"action_ts": F.col("action_ts") + F.expr("INTERVAL 1 DAY"), "error": F.lit("second failure\nwith detail"), "attempts": F.lit(2), "reason": F.lit("retries_exhausted"), "raw_payload": F.lit(b"later")}
    )
    marked = [
        dl.marks(first.filter(off % 2 == 0), F.col("action_ts") + F.expr("INTERVAL 2 DAYS"), F.lit(operator)) for operator in ("op-a", "op-b")
    ]
    back = first.filter(off % 5 == 0).withColumns(
        {"action_ts": F.col("action_ts") + F.expr("INTERVAL 3 DAYS"), "error": F.lit("failed after replay"), "attempts": F.lit(1)}
    )
    out = first
    for part in (again, *marked, back):
        out = out.unionByName(part)
    return t.stored(out, "actions")


_ACTIONS_SQL = f"""WITH {D},
refused AS (SELECT event_id, part, off, reason, error, logged_at AS acted, printf('%010d/%020d/telemetry.raw', part, off) AS action_id FROM dead),
actions AS (
  SELECT *, 'refuse' AS action, 0 AS attempts FROM refused
  UNION ALL SELECT event_id, part, off, 'retries_exhausted', 'second failure' || chr(10) || 'with detail', acted + INTERVAL 1 DAY, action_id, 'refuse', 2 FROM refused WHERE off % 3 = 0
  UNION ALL SELECT event_id, part, off, NULL, NULL, acted + INTERVAL 2 DAYS, 'op-a', 'mark', NULL FROM refused WHERE off % 2 = 0
  UNION ALL SELECT event_id, part, off, NULL, NULL, acted + INTERVAL 2 DAYS, 'op-b', 'mark', NULL FROM refused WHERE off % 2 = 0
  UNION ALL SELECT event_id, part, off, reason, 'failed after replay', acted + INTERVAL 3 DAYS, action_id, 'refuse', 1 FROM refused WHERE off % 5 = 0),
chained AS (SELECT *, lag(action) OVER (PARTITION BY event_id ORDER BY acted, action_id) AS before FROM actions),
firsts_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acted, action_id) AS rn FROM actions WHERE action = 'refuse') WHERE rn = 1),
lasts_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acted DESC, action_id DESC) AS rn FROM actions WHERE action = 'refuse') WHERE rn = 1),
ends_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acted DESC, action_id DESC) AS rn FROM actions) WHERE rn = 1),
totals_d AS (SELECT event_id, sum(attempts)::INTEGER AS attempts FROM actions WHERE action = 'refuse' GROUP BY event_id),
won_d AS (SELECT event_id, max(acted) AS won FROM chained WHERE action = 'mark' AND before = 'refuse' GROUP BY event_id),
dead_letters AS (
  SELECT f.event_id, l.error, l.reason, s.attempts, f.acted AS first_failed_at, l.acted AS last_failed_at, 'telemetry.raw' AS topic, f.part, f.off,
    CASE WHEN e.action = 'mark' THEN 'replayed' ELSE 'dead' END AS state, CASE WHEN e.action = 'mark' THEN w.won END AS replayed_at
  FROM firsts_d f JOIN lasts_d l ON f.event_id = l.event_id JOIN ends_d e ON f.event_id = e.event_id
    JOIN totals_d s ON f.event_id = s.event_id LEFT JOIN won_d w ON f.event_id = w.event_id)"""


def _dead_letters(spark, sf):
    return dl.fold(_actions(spark, sf))


def _short(frame):
    return frame.drop("raw_payload").withColumnRenamed("partition", "part").withColumnRenamed("offset", "off")


def record_dead_letter(spark, sf):
    return dl.refusals(t.classified(spark, sf)).select("event_id", "reason", "error", "attempts", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("action_ts").alias("first_failed_at"))


def write_dlq_topic(spark, sf):
    """Original bytes and key of every refusal, written as the topic copy and read back."""
    refused = t.classified(spark, sf).filter(F.col("outcome") == "dead")
    path = work_dir(spark, "dlq")
    refused.select("key", "value").write.parquet(path)
    copy = spark.read.schema("key BINARY, value BINARY").parquet(path)
    return copy.groupBy(F.col("key").cast("string").alias("vehicle_id")).agg(
        F.count("*").alias("records"), F.count_if(F.col("value").cast("string") == "{this is not valid json").alias("corrupt")
    )


def fold_dead_letters(spark, sf):
    return _short(_dead_letters(spark, sf))


def read_dead_letters(spark, sf):
    path = work_dir(spark, "dead")
    _dead_letters(spark, sf).write.parquet(path)
    return _short(tables.read_table(spark, path, DEAD_LETTERS))


def dlq_depth(spark, sf):
    return dl.depth(_dead_letters(spark, sf))


def list_dead_letters(spark, sf):
    return _short(dl.list_dead_letters(_dead_letters(spark, sf), "dead", 50)).select("event_id", "last_failed_at", "state")


def listing(spark, sf):
    return dl.listing(_dead_letters(spark, sf))


def dead_letter_detail(spark, sf):
    d = dl.detail(_dead_letters(spark, sf))
    payload = F.col("payload_text")
    return d.select("event_id", (payload == "{this is not valid json").alias("raw"), F.get_json_object(payload, "$.source").alias("source"))


def get_dead_letter(spark, sf):
    """The oldest entry, looked up by its identifier."""
    dead = _dead_letters(spark, sf)
    oldest = dead.select(F.min_by("event_id", F.struct("first_failed_at", "event_id"))).scalar()
    return _short(dl.get_dead_letter(dead, oldest)).select("event_id", "reason", "attempts", "state")


def recent_failures_by_topic(spark, sf):
    d = _dead_letters(spark, sf).withColumn("topic", F.concat("topic", F.lit("."), F.col("partition").cast("string")))
    return dl.recent_failures_by_topic(d, 10).select("topic", "event_id", "last_failed_at", "rank")


def mark_replayed(spark, sf):
    return dl.mark_outcomes(_actions(spark, sf)).withColumnsRenamed({"action_ts": "marked_at", "action_id": "operator"})


def truncate_error(spark, sf):
    d = t.table(spark, sf, "documents")
    cut = text.truncate_bytes(F.col("text"), 200)
    return d.select("doc_id", F.hex(F.substring(cut.cast("binary"), 1, 200)).alias("kept"), F.endswith(cut, F.lit("…")).alias("was_cut"))


def error_headline(spark, sf):
    e = t.events(spark, sf)
    long = F.concat(F.repeat(F.lit("e"), (F.col("event_id") % 90).cast("int")), F.lit("\nsecond line"))
    return e.select("event_id", text.error_headline(long).alias("headline"))


def origin_label(spark, sf):
    return t.rows(spark, sf).select(F.col("partition").alias("part"), F.col("offset").alias("off"), text.origin_label(F.lit(t.TOPIC), F.col("partition"), F.col("offset")).alias("origin"))


def payload_contains(spark, sf):
    c = t.raw_log(spark, sf)
    return c.agg(F.count_if(text.payload_contains(F.col("value"), "not valid")).alias("corrupt"), F.count_if(text.payload_contains(F.col("value"), '"vehicle_id":"veh-0001"')).alias("of_one_vehicle"))


def rfc3339_text(spark, sf):
    return t.events(spark, sf).select("event_id", text.rfc3339(F.col("ts").cast("timestamp")).alias("at"))


def republish(spark, sf):
    r = dl.republished(dl.eligible(dl.plan_replay(_dead_letters(spark, sf), everything=True)))
    flat = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";")
    return r.select(F.col("key").cast("string").alias("event_id"), "topic", F.translate(flat, "\n", "/").alias("headers"), (F.octet_length("value") > 0).alias("has_bytes"))


def replay_all(spark, sf):
    """Newest dead entries with what would be done to each; the payload of every 7th is gone."""
    d = _dead_letters(spark, sf).withColumn("raw_payload", F.when(F.col("offset") % 7 != 0, F.col("raw_payload")))
    return dl.plan_replay(d, limit=40).select("event_id", "state", "refusal")


def merge_dead_letters(spark, sf):
    """The table from summaries of four parts of the action log, as a ledger keeps them: no order is taken."""
    actions = _actions(spark, sf)
    won = dl.mark_outcomes(actions).filter("marked").select("event_id", "action_ts", "action_id")
    kept = actions.filter("action = 'refuse'").unionByName(actions.filter("action = 'mark'").join(won, ["event_id", "action_ts", "action_id"], "left_semi"))
    parts = [dl.summarize(kept.filter(F.pmod(F.xxhash64("event_id", "action_ts", "action_id"), F.lit(4)) == k)) for k in range(4)]
    return _short(dl.entries(dl.merge_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))))


def replay_one(spark, sf):
    """Entries asked for by id, some of them not there, without payload or replayed before: published, then marked.

    Shows for every id why it was refused, whether its record was published, and the state it is in afterwards.
    """
    actions = _actions(spark, sf).withColumn("raw_payload", F.when((F.col("action") == "mark") | (F.col("offset") % 7 != 0), F.col("raw_payload")))
    found = dl.fold(actions)
    asked = found.filter(F.col("offset") % 4 != 1).select("event_id")
    absent = t.events(spark, sf).filter(F.col("event_id") % 40 == 0).select(F.concat(F.lit("absent-"), F.col("event_id").cast("string")).alias("event_id"))
    path = work_dir(spark, "replay")
    dl.plan_requests(found, asked.unionByName(absent)).write.parquet(path)
    plan = spark.read.parquet(path)
    published = dl.republished(dl.eligible(plan)).select(F.col("key").cast("string").alias("event_id"), F.lit(True).alias("published"))
    marks = dl.marks(dl.eligible(plan), F.col("last_failed_at") + F.expr("INTERVAL 9 DAYS"), F.lit("op-z"))
    after = dl.fold(actions.unionByName(marks)).select("event_id", F.col("state").alias("state_after"))
    shown = plan.select("event_id", "refusal").join(published, "event_id", "left").join(after, "event_id", "left")
    return shown.select("event_id", "refusal", F.coalesce("published", F.lit(False)).alias("published"), "state_after")


def replay_into_log(spark, sf):
    replayed = dl.republished(dl.eligible(dl.plan_replay(_dead_letters(spark, sf), everything=True)))
    log = dl.replay_into_log(t.raw_log(spark, sf), replayed)
    return log.groupBy("topic", (F.size("headers") > 0).alias("replayed")).agg(F.count("*").alias("records"), F.count("offset").alias("positioned"))


_ROW = "event_id, error, reason, attempts, first_failed_at, last_failed_at, topic, part, off, state, replayed_at"
_HEADERS_SQL = """concat('x-origin-error=', replace(error, chr(10), '/'), ';x-origin-offset=', off, ';x-origin-partition=', part, ';x-origin-reason=', reason, ';x-origin-topic=', topic, ';x-replay=true')"""

QUERIES = {
    "record_dead_letter": (record_dead_letter, f"WITH {D} SELECT event_id, reason, error, 0 AS attempts, part, off, logged_at AS first_failed_at FROM dead"),
    "write_dlq_topic": (write_dlq_topic, f"WITH {D} SELECT vehicle_id, count(*) AS records, count(*) FILTER (WHERE kind = 'corrupt') AS corrupt FROM dead GROUP BY vehicle_id"),
    "fold_dead_letters": (fold_dead_letters, f"{_ACTIONS_SQL} SELECT {_ROW} FROM dead_letters"),
    "read_dead_letters": (read_dead_letters, f"{_ACTIONS_SQL} SELECT {_ROW} FROM dead_letters"),
    "dlq_depth": (dlq_depth, f"{_ACTIONS_SQL} SELECT count(*) FILTER (WHERE state = 'dead') AS depth FROM dead_letters"),
    "list_dead_letters": (list_dead_letters, f"{_ACTIONS_SQL} SELECT event_id, last_failed_at, state FROM dead_letters WHERE state = 'dead' ORDER BY last_failed_at DESC, event_id LIMIT 50"),
    "dead_letter_listing": (listing, f"""{_ACTIONS_SQL} SELECT event_id, reason, attempts, strftime(last_failed_at, '%Y-%m-%dT%H:%M:%SZ') AS last_failed,
        concat(topic, '/', part, '/', off) AS origin, split_part(error, chr(10), 1) AS headline FROM dead_letters"""),
    "dead_letter_detail": (dead_letter_detail, f"""{_ACTIONS_SQL} SELECT x.event_id, d.kind = 'corrupt' AS raw, CASE WHEN d.kind <> 'corrupt' THEN 'fleet' END AS source
        FROM dead_letters x JOIN dead d ON x.part = d.part AND x.off = d.off"""),
    "get_dead_letter": (get_dead_letter, f"{_ACTIONS_SQL} SELECT event_id, reason, attempts, state FROM dead_letters ORDER BY first_failed_at, event_id LIMIT 1"),
    "recent_failures_by_topic": (recent_failures_by_topic, f"""{_ACTIONS_SQL} SELECT * FROM (SELECT concat(topic, '.', part) AS topic, event_id, last_failed_at,
        row_number() OVER (PARTITION BY part ORDER BY last_failed_at DESC, event_id) AS rank FROM dead_letters) WHERE rank <= 10"""),
    "mark_replayed": (mark_replayed, f"{_ACTIONS_SQL} SELECT event_id, acted AS marked_at, action_id AS operator, coalesce(before = 'refuse', false) AS marked FROM chained WHERE action = 'mark'"),
    "error_headline": (error_headline, "SELECT event_id, CASE WHEN event_id % 90 <= 60 THEN repeat('e', CAST(event_id % 90 AS INTEGER)) ELSE concat(repeat('e', 60), '…') END AS headline FROM events"),
    "origin_label": (origin_label, f"WITH {t.BASE_SQL} SELECT part, off, concat('telemetry.raw/', part, '/', off) AS origin FROM log"),
    "truncate_error": (truncate_error, "SELECT doc_id, substr(hex(encode(text)), 1, 400) AS kept, strlen(text) > 200 AS was_cut FROM documents"),
    "payload_contains": (payload_contains, f"""WITH {t.BASE_SQL} SELECT count(*) FILTER (WHERE kind = 'corrupt') AS corrupt, count(*) FILTER (WHERE kind <> 'corrupt' AND vehicle_id = 'veh-0001') AS of_one_vehicle FROM log"""),
    "rfc3339_text": (rfc3339_text, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events"),
    "republish": (republish, f"{_ACTIONS_SQL} SELECT event_id, topic, {_HEADERS_SQL} AS headers, true AS has_bytes FROM dead_letters WHERE state = 'dead'"),
    "replay_all": (replay_all, f"""{_ACTIONS_SQL} SELECT event_id, state, CASE WHEN off % 7 = 0 THEN 'no stored payload' END AS refusal FROM dead_letters WHERE state = 'dead'
        ORDER BY last_failed_at DESC, event_id LIMIT 40"""),
    "merge_dead_letters": (merge_dead_letters, f"{_ACTIONS_SQL} SELECT {_ROW} FROM dead_letters"),
    "replay_one": (replay_one, f"""{_ACTIONS_SQL}, asked AS (SELECT event_id FROM dead_letters WHERE off % 4 <> 1 UNION ALL SELECT concat('absent-', event_id) FROM events WHERE event_id % 40 = 0),
        judged AS (SELECT a.event_id, d.state, CASE WHEN d.state IS NULL THEN 'no such dead letter' WHEN d.state <> 'dead' THEN 'already replayed' WHEN d.off % 7 = 0 THEN 'no stored payload' END AS refusal
          FROM asked a LEFT JOIN dead_letters d ON a.event_id = d.event_id)
        SELECT event_id, refusal, refusal IS NULL AS published, CASE WHEN refusal IS NULL THEN 'replayed' ELSE state END AS state_after FROM judged"""),
    "replay_into_log": (replay_into_log, f"""{_ACTIONS_SQL} SELECT 'telemetry.raw' AS topic, false AS replayed, count(*) AS records, count(*) AS positioned FROM log
        UNION ALL SELECT 'telemetry.raw', true, count(*), 0 FROM dead_letters WHERE state = 'dead'"""),
}
