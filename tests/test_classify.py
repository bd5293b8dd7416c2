import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import classify, state
from fleetfold.operators.envelope import judge
from tests.helpers import at, envelope, log_of, position


def ledger_of(classified):
    return classified.withColumns({"processed_at": F.col("timestamp"), "consumer_id": F.lit("t")})


def outcomes(df):
    return [r["outcome"] for r in df.orderBy("partition", "offset").collect()]


def event(n, vehicle="v", ts=0.0, **more):
    return envelope(n, payload=position(vehicle=vehicle, ts=at(ts), **more))


def test_seven_records_one_of_them_twice(spark):
    docs = [event(n, vehicle=f"v{n % 3}", ts=n) for n in range(6)]
    done = ledger_of(classify.classify(judge(log_of(spark, *docs, docs[0]))))
    assert outcomes(done) == ["applied"] * 6 + ["duplicate"]
    assert state.history(done).count() == 6
    assert {r["outcome"]: r["events"] for r in classify.outcome_ledger(done).collect()} == {"applied": 6, "duplicate": 1, "late": 0, "dead": 0}
    assert state.schema_versions(done).first()["event_count"] == 6


def test_eight_deliveries_are_applied_once(spark):
    docs = [(p % 3, p, event(1)) for p in range(8)]
    assert sorted(outcomes(classify.classify(judge(log_of(spark, *docs))))) == ["applied"] + ["duplicate"] * 7


def test_late_is_kept_and_does_not_move_the_state(spark):
    done = ledger_of(classify.classify(judge(log_of(spark, event(1, ts=0), event(2, ts=-600), event(3, ts=0)))))
    assert outcomes(done) == ["applied", "late", "late"]
    hist = state.history(done)
    assert hist.count() == 3
    now = state.current_state(hist).first()
    assert now["last_event_id"] == done.filter("offset = 0").first()["event_id"]
    assert state.state_drift(state.current_state(hist), hist).count() == 0


def test_refused_first_then_resent_correctly_is_applied(spark):
    assert outcomes(classify.classify(judge(log_of(spark, event(1, lat=999), event(1, lat=12.5))))) == ["dead", "applied"]


def test_poison_does_not_block(spark):
    done = classify.classify(judge(log_of(spark, "{this is not valid json", event(1))))
    assert outcomes(done) == ["dead", "applied"]
    assert bytes(done.filter("offset = 0").first()["value"]) == b"{this is not valid json"


def sequential(records, seen=(), newest=()):
    """The definition: one record at a time, in processing order."""
    seen, newest, out = set(seen), dict(newest), []
    for _, _, key, vehicle, ts, valid in sorted(records):
        if not valid:
            out.append("dead")
        elif key in seen:
            out.append("duplicate")
        else:
            seen.add(key)
            late = vehicle in newest and ts <= newest[vehicle]
            newest[vehicle] = max(ts, newest.get(vehicle, ts))
            out.append("late" if late else "applied")
    return out, seen, newest


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_record_at_a_time(spark, seed):
    """Hot id, hot vehicle, ties, refusals; in one batch and in two with a ledger between; tiny blocks."""
    rng = random.Random(seed)
    records = []
    for off in range(160):
        key = 0 if rng.random() < 0.3 else rng.randrange(1, 90)
        vehicle = "hot" if key % 3 == 0 else f"v{key % 7}"
        records.append((rng.randrange(3), off, key, vehicle, (key * 37) % 50, rng.random() > 0.1))
    def docs(rows):
        return [(p, o, event(k, vehicle=v, ts=t) if ok else "{") for p, o, k, v, t, ok in rows]

    want, _, _ = sequential(records)
    whole = classify.classify(judge(log_of(spark, *docs(records))), rows_per_block=9)
    assert outcomes(whole) == want

    first, second = records[:70], records[70:]
    want1, seen, newest = sequential(first)
    want2, _, _ = sequential(second, seen, newest)
    done1 = ledger_of(classify.classify(judge(log_of(spark, *docs(first))), rows_per_block=9))
    assert outcomes(done1) == want1
    for small in (True, False):
        done2 = classify.classify(judge(log_of(spark, *docs(second))), state.processed(done1), state.current_state(state.history(done1)), 9, small)
        assert outcomes(done2) == want2


def test_committable_prefix_stops_before_the_first_failure(spark):
    far = classify.BLOCK_ROWS
    rows = [("a", 0, 0, False), ("a", 0, 1, False), ("a", 0, 2, True), ("a", 0, 3, False), ("a", 1, 5, True), ("a", 2, 7, False)]
    rows += [("b", 0, 0, False), ("b", 1, 5, False), ("b", 2, 1, False), ("b", 2, far + 4, False), ("b", 2, far + 5, True), ("b", 2, far + 6, False)]
    df = spark.createDataFrame(rows, "topic STRING, partition INT, offset BIGINT, failed BOOLEAN")
    got = {(r["topic"], r["partition"]): (r["next_offset"], r["records"]) for r in classify.committable_prefix(df).collect()}
    assert got == {("a", 0): (2, 2), ("a", 2): (8, 1), ("b", 0): (1, 1), ("b", 1): (6, 1), ("b", 2): (far + 5, 2)}


def test_topics_that_share_positions_are_ordered(spark):
    rows = [(e, "v", datetime(2024, 1, 1, s), 0, 7, topic) for e, s, topic in [("e1", 3, "a"), ("e2", 2, "b"), ("e3", 1, "c")]]
    ddl = "event_id STRING, vehicle_id STRING, event_ts TIMESTAMP, partition INT, offset BIGINT, topic STRING"
    for order in (rows, rows[::-1]):
        late = classify.classify_late(spark.createDataFrame(order, ddl))
        assert {r["event_id"]: r["late"] for r in late.collect()} == {"e1": False, "e2": True, "e3": True}


def test_transient_failures_have_a_budget(spark):
    df = spark.createDataFrame([(1, True), (5, True), (6, True), (1, False)], "attempts INT, transient BOOLEAN")
    got = [(r["verdict"], r["reason"]) for r in classify.retry_budget(df).collect()]
    assert got == [("retry", None), ("retry", None), ("dead", "retries_exhausted"), ("dead", "decode")]
