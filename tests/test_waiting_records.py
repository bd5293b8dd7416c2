"""What waits behind a failed record is judged once and stays where it is."""

from pyspark.sql import functions as F

from fleetfold.schemas import columns
from fleetfold.streaming import consume
from fleetfold.streaming.ledger import UNJUDGED, Ledger
from tests.helpers import T0, at, envelope, event_id, log_of, position


def test_waiting_records_are_not_judged_again(spark, tmp_path, monkeypatch):
    ledger, judged, judge = Ledger(spark, str(tmp_path)), [], consume.judge
    monkeypatch.setattr(consume, "judge", lambda rows: judged.append(rows.count()) or judge(rows))

    def fails_once(rows):
        return rows.filter((F.col("offset") == 0) & (F.col("tries") < 1)).select("topic", "partition", "offset", F.lit(True).alias("transient"), F.lit("busy").alias("error"))

    docs = [envelope(n, payload=position(ts=at(n))) for n in range(3)] + ["{"]
    consume.consume_batch(log_of(spark, *docs), ledger, "run", 0, deliver=fails_once, now=T0)
    waiting = ledger.queue()
    assert [(r["offset"], r["event_id"], r["reason"]) for r in waiting.orderBy("offset").limit(3).collect()] == [(n, event_id(n), None) for n in range(3)]
    # A queue as ledgers kept it before, of records only, is still read.
    waiting.select(*columns(UNJUDGED)).write.parquet(f"{tmp_path}/data/queue/old")
    old, new = {**ledger.manifest(), "queue": "data/queue/old"}, ["offset", "tries", "event_id", "reason", "event_ts"]
    assert {tuple(r) for r in ledger.queue(old).select(*new).collect()} == {tuple(r) for r in waiting.select(*new).collect()}
    assert consume.drain_retries(ledger, fails_once) == 1
    assert judged == [4, 0]
    assert {(r["offset"], r["outcome"], r["value"] is None) for r in ledger.rows().collect()} == {(0, "applied", True), (1, "applied", True), (2, "applied", True), (3, "dead", False)}


def test_failures_leave_the_records_where_they_are(spark):
    """Few failures are copied to the records: these are shuffled by neither position nor partition."""
    judged = log_of(spark, *[envelope(n) for n in range(4)]).withColumns({"tries": F.lit(0), "due_at": F.lit(None).cast("timestamp"), "held": F.lit(False), "reason": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "attempts": F.lit(0)})
    found = judged.filter("offset = 1").select("topic", "partition", "offset", F.lit(True).alias("transient"), F.lit("busy").alias("error"))
    verdicts = consume.failures(judged, found, 5, lambda rows: rows)
    out = consume.delivered(judged, verdicts, 0.2, T0)
    assert [(r["offset"], r["held"], r["tries"], r["due_at"] is None) for r in out.orderBy("offset").collect()] == [(0, False, 0, True), (1, True, 1, False), (2, True, 0, True), (3, True, 0, True)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert consume.failures(judged, found.limit(0), 5, lambda rows: rows) is None
