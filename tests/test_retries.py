"""A writer that fails for single records: tries, order within a partition, what waits, restarts."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetfold.streaming.consume import RETRY_RUN, consume_batch, drain_retries
from fleetfold.streaming.ledger import Ledger
from tests.helpers import T0, at, envelope, event_id, log_of, position


def event(n, vehicle="v", ts=0.0, **more):
    return envelope(n, payload=position(vehicle=vehicle, ts=at(ts), **more))


class Writer:
    """Fails for an event in the given number of calls, for a passing reason or not; keeps what it wrote, in order."""

    def __init__(self, times, transient=True):
        self.times, self.transient, self.wrote = dict(times), transient, []

    def __call__(self, rows):
        bad, failing = [], set()
        # Handed over in order, as a writer of one partition sees it.
        for r in rows.select("topic", "partition", "offset", "event_id").orderBy("partition", "offset").collect():
            if self.times.get(r["event_id"], 0) > 0:
                failing.add(r["event_id"])
                bad.append((r["topic"], r["partition"], r["offset"], self.transient, "store is busy"))
            else:
                self.wrote.append(r["offset"])
        for e in failing:
            self.times[e] -= 1
        return rows.sparkSession.createDataFrame(bad, "topic STRING, partition INT, offset BIGINT, transient BOOLEAN, error STRING")


def outcomes(ledger):
    return {(r["partition"], r["offset"]): (r["outcome"], r["reason"], r["attempts"]) for r in ledger.rows().collect()}


def log(spark):
    docs = [(0, 0, event(1, "a", 0)), (0, 1, event(2, "a", 10)), (0, 2, event(3, "a", 5)), (1, 0, event(4, "b", 0)), (0, 3, event(2, "a", 10)), (1, 1, event(5, "b", 9))]
    return log_of(spark, *docs)


def test_a_failing_record_holds_its_partition_back(spark, tmp_path):
    ledger, writer = Ledger(spark, str(tmp_path)), Writer({event_id(2): 2})
    consume_batch(log(spark), ledger, "run", 0, deliver=writer, now=T0)
    applied = ("applied", None, 0)
    assert outcomes(ledger) == {(0, 0): applied, (1, 0): applied, (1, 1): applied}
    assert {tuple(r) for r in ledger.read_positions().collect()} == {("raw", 0, 1), ("raw", 1, 2)}
    waiting = ledger.queue().orderBy("offset").collect()
    assert [(r["offset"], r["tries"]) for r in waiting] == [(1, 1), (2, 0), (3, 0)]
    assert waiting[0]["due_at"] is not None and waiting[1]["due_at"] is None
    # Not due yet: new records of the partition wait too, those of others do not.
    consume_batch(log_of(spark, (0, 4, event(6, "a", 20)), (1, 2, event(7, "b", 10))), ledger, "run", 1, deliver=writer, now=T0 + timedelta(milliseconds=100))
    assert set(outcomes(ledger)) == {(0, 0), (1, 0), (1, 1), (1, 2)} and ledger.queue().count() == 4
    assert drain_retries(ledger, writer) == 2
    done = outcomes(ledger)
    assert [done[0, k][0] for k in range(5)] == ["applied", "applied", "late", "duplicate", "applied"]
    assert ledger.manifest()["queue"] is None and {tuple(r) for r in ledger.read_positions().collect()} == {("raw", 0, 5), ("raw", 1, 3)}
    assert ledger.history().count() == 7 and ledger.processed().count() == 7


def test_tries_are_limited(spark, tmp_path):
    ledger, writer = Ledger(spark, str(tmp_path)), Writer({event_id(2): 10**6})
    consume_batch(log(spark), ledger, "run", 0, deliver=writer, now=T0)
    assert drain_retries(ledger, writer) == 5
    done = outcomes(ledger)
    # Refused after the first try and five more; the event after it is no longer late, and its copy is handled.
    assert done[0, 1] == ("dead", "retries_exhausted", 6) and done[0, 2][0] == "applied"
    entry = ledger.dead_letters().filter(F.col("event_id") == event_id(2)).first()
    assert (entry["error"], entry["reason"]) == ("store is busy", "retries_exhausted") and entry["raw_payload"] is not None


def test_a_failure_that_cannot_pass_is_refused_at_once(spark, tmp_path):
    ledger, writer = Ledger(spark, str(tmp_path)), Writer({event_id(2): 1}, transient=False)
    consume_batch(log(spark), ledger, "run", 0, deliver=writer, now=T0)
    done = outcomes(ledger)
    assert done[0, 1][:2] == ("dead", "decode") and done[0, 3][0] == "applied" and ledger.manifest()["queue"] is None


@pytest.mark.parametrize("step", ["begin", "dlq_topic", "rows", "snapshot"])
def test_what_waits_survives_a_kill(spark, tmp_path, step):
    ledger = Ledger(spark, str(tmp_path))
    consume_batch(log(spark), ledger, "run", 0, deliver=Writer({event_id(2): 1}), now=T0)

    def die(name):
        if name == step:
            raise RuntimeError("killed")

    later = T0 + timedelta(seconds=5)
    with pytest.raises(RuntimeError, match="killed"):
        consume_batch(log_of(spark), ledger, RETRY_RUN, 0, deliver=Writer({}), now=later, after=die)
    again = Ledger(spark, str(tmp_path))
    assert again.queue().count() == 3
    drain_retries(again, Writer({}))
    assert [outcomes(again)[0, k][0] for k in range(4)] == ["applied", "applied", "late", "duplicate"]
