import hashlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import deadletters as dl
from fleetfold.schemas import DEAD_LETTERS, DLQ_ACTIONS
from tests.helpers import event_id

DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)


def refuse(n, day, attempts=0, error="bad", payload=b"{oops", reason="decode", offset=46):
    return (event_id(n), "refuse", DAY + timedelta(days=day), f"r{day}", payload, error, reason, attempts, "raw", 0, offset)


def mark(n, day, who="op"):
    return (event_id(n), "mark", DAY + timedelta(days=day), who, None, None, None, None, None, None, None)


def fold(spark, *actions, seconds=3600):
    return dl.fold(spark.createDataFrame(list(actions), DLQ_ACTIONS), seconds)


def test_attempts_add_up_and_the_first_payload_stays(spark):
    row = fold(spark, refuse(1, 0, 1, "first"), refuse(1, 1, 2, "second", b"other", "retries_exhausted", 99)).first()
    assert (row["attempts"], row["error"], row["reason"], row["state"]) == (3, "second", "retries_exhausted", "dead")
    assert bytes(row["raw_payload"]) == b"{oops" and row["offset"] == 46
    assert row["last_failed_at"] - row["first_failed_at"] == timedelta(days=1)


def test_a_refusal_after_a_mark_is_dead_again_and_a_mark_without_refusal_is_nothing(spark):
    rows = {r["event_id"]: r for r in fold(spark, refuse(1, 0), mark(1, 1), refuse(1, 2), refuse(2, 0), mark(2, 1), mark(3, 0)).collect()}
    assert (rows[event_id(1)]["state"], rows[event_id(1)]["replayed_at"]) == ("dead", None)
    assert rows[event_id(2)]["state"] == "replayed" and rows[event_id(2)]["replayed_at"] is not None
    assert event_id(3) not in rows


def test_eight_marks_have_one_winner(spark):
    actions = spark.createDataFrame([refuse(1, 0), *[mark(1, 1, f"op{i}") for i in range(8)]], DLQ_ACTIONS)
    outcome = dl.mark_outcomes(actions).orderBy("action_id").collect()
    assert [r["marked"] for r in outcome] == [True] + [False] * 7


def test_depth_counts_dead_rows_and_is_zero_when_empty(spark):
    assert dl.depth(fold(spark, refuse(1, 0), refuse(2, 0), mark(2, 1))).first()["depth"] == 1
    assert dl.depth(spark.createDataFrame([], DEAD_LETTERS)).first()["depth"] == 0


def test_listing_order_state_and_limit(spark):
    dead = fold(spark, *[refuse(n, n) for n in range(5)], mark(4, 9))
    assert [r["event_id"] for r in dl.list_dead_letters(dead, "dead", 2).collect()] == [event_id(3), event_id(2)]
    assert dl.list_dead_letters(dead, "all").count() == dl.list_dead_letters(dead, "").count() == 5
    assert dl.list_dead_letters(dead, "replayed").count() == 1
    with pytest.raises(ValueError):
        dl.list_dead_letters(dead, "lost")


def test_republished_bytes_are_identical_and_headers_sorted(spark):
    body = bytes(range(256))
    row = dl.republished(fold(spark, refuse(1, 0, error="e" * 300, payload=body))).first()
    assert bytes(row["value"]) == body and bytes(row["key"]).decode() == event_id(1) and row["topic"] == "raw"
    headers = {h["key"]: bytes(h["value"]).decode() for h in row["headers"]}
    assert [h["key"] for h in row["headers"]] == sorted(headers)
    assert headers == {
        "x-replay": "true", "x-origin-topic": "raw", "x-origin-partition": "0", "x-origin-offset": "46", "x-origin-reason": "decode", "x-origin-error": "e" * 200 + "…",
    }


def test_plan_refuses_what_cannot_be_replayed_and_keeps_the_rest(spark):
    dead = fold(spark, refuse(1, 0), refuse(2, 1, payload=b""), refuse(3, 2), mark(3, 3))
    plan = {r["event_id"]: r["refusal"] for r in dl.plan_replay(dead).collect()}
    assert plan == {event_id(1): None, event_id(2): "no stored payload"}
    assert dl.plan_replay(dead, event_id=event_id(3)).first()["refusal"] == "already replayed"
    missing = dl.plan_replay(dead, event_id=event_id(9))
    assert [r["refusal"] for r in missing.collect()] == ["no such dead letter"] and dl.eligible(missing).count() == 0
    assert dl.eligible(dl.plan_replay(dead)).count() == 1


def test_detail_normalises_json_and_keeps_other_bytes(spark):
    dead = fold(spark, refuse(1, 0, payload=b'{ "b" : [1, 2],\n "a":1 }'), refuse(2, 0, payload=b"{oops"))
    shown = {r["event_id"]: r["payload_text"] for r in dl.detail(dead).collect()}
    assert shown == {event_id(1): '{"a":1,"b":[1,2]}', event_id(2): "{oops"}


def test_fold_equals_a_state_machine(spark):
    actions, state = [], {}
    for i in range(120):
        n = int(hashlib.md5(str(i).encode()).hexdigest(), 16)
        who, day = (0 if n % 3 else n % 5), i / 10
        if n % 2:
            actions.append((*refuse(who, 0, 1)[:2], DAY + timedelta(days=day), f"{i:04d}", *refuse(who, 0, 1)[4:]))
            attempts = state.get(who, (None, 0, None))[1]
            state[who] = ("dead", attempts + 1, None)
        else:
            actions.append((event_id(who), "mark", DAY + timedelta(days=day), f"{i:04d}", *[None] * 7))
            if who in state and state[who][0] == "dead":
                state[who] = ("replayed", state[who][1], DAY + timedelta(days=day))
    got = fold(spark, *actions, seconds=7200).withColumn("at", F.unix_micros("replayed_at")).collect()
    micros = lambda t: None if t is None else round(t.timestamp() * 1_000_000)
    assert {r["event_id"]: (r["state"], r["attempts"], r["at"]) for r in got} == {event_id(k): (s, a, micros(t)) for k, (s, a, t) in state.items()}
