"""Manifests, id buckets with filters, merging, and operators that mark at the same time."""

import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import deadletters as dl
from fleetfold.operators import known_ids
from fleetfold.schemas import DLQ_ACTIONS
from fleetfold.streaming.consume import consume_batch
from fleetfold.streaming.ledger import Ledger
from fleetfold.streaming.manifest import KEEP, Manifests
from tests.helpers import T0, at, envelope, event_id, log_of, position


def ids(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "n BIGINT")
    return rows.select(F.concat(F.lit("id-"), "n").alias("event_id"), F.lit(T0).cast("timestamp").alias("processed_at"), F.lit("c").alias("consumer_id"), F.lit(0).alias("partition"), F.col("n").alias("offset"))


def test_versions_are_taken_once(spark, tmp_path):
    manifests = Manifests(spark, str(tmp_path))
    assert manifests.load()["version"] == 0

    def add(n):
        manifests.commit(lambda m: m["runs"].update({str(n): n}))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(24)))
    found = manifests.load()
    assert found["version"] == 24 and found["runs"] == {str(n): n for n in range(24)}
    # Old versions do not pile up, so neither does what is listed.
    assert len(manifests.versions()) <= KEEP + 2


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ids")
    ranges = [range(0, 3000), range(3000, 3010), range(4000, 9000)]
    return [known_ids.write_ids(ids(spark, r), f"{root}/{i}", len(r), 8) for i, r in enumerate(ranges)]


@pytest.mark.parametrize("slice_", [50_000, 100])
def test_a_batch_opens_the_buckets_it_falls_into(spark, tmp_path, monkeypatch, slice_):
    monkeypatch.setattr(known_ids, "SLICE", slice_)
    entries = [known_ids.write_ids(ids(spark, r), f"{tmp_path}/{i}", len(r), 8) for i, r in enumerate([range(0, 3000), range(3000, 3010), range(4000, 9000)])]
    asked = ids(spark, [17, 18, 3004, 10**6, 10**6 + 1])
    place = {r["offset"]: r["b"] for r in asked.select("offset", known_ids.bucket_of(8).alias("b")).collect()}
    hits = known_ids.hit_buckets(asked.select("event_id"), entries, 5)
    assert hits == {entries[0].path: sorted({place[17], place[18]}), entries[1].path: [place[3004]]}
    opened = known_ids.known(asked.select("event_id"), entries, 5)
    folders = {f.split("/ids/bucket=")[0].removeprefix("file://") + "|" + f.split("bucket=")[1].split("/")[0] for f in opened.inputFiles()}
    assert folders <= {f"{p}|{b}" for p, bs in hits.items() for b in bs}
    held = {r[0] for r in opened.collect()}
    assert {"id-17", "id-18", "id-3004"} <= held and "id-1000000" not in held
    # Nothing known: nothing is opened.
    assert known_ids.hit_buckets(ids(spark, range(20_000, 22_000)).select("event_id"), entries, 2000) == {}


def test_filters_lose_nothing(spark, entries, monkeypatch):
    monkeypatch.setattr(known_ids, "BATCH_SLICE", 50)
    everything = [*range(0, 3010), *range(4000, 9000)]
    asked = ids(spark, [*everything, *range(20_000, 25_000)]).select("event_id")
    maybe = {r[0] for r in known_ids.maybe_known(asked, entries, 13_010).collect()}
    assert {f"id-{n}" for n in everything} <= maybe and len(maybe) <= len(everything) + 2
    assert known_ids.read_ids(spark, entries).count() == len(everything)


def event(n, vehicle="v", ts=0.0, **more):
    return envelope(n, payload=position(vehicle=vehicle, ts=at(ts), **more))


def feed(spark, ledger, batches, **how):
    start = 0
    for k, docs in enumerate(batches):
        consume_batch(log_of(spark, *docs, start=start), ledger, "run", k, **how)
        start += len(docs)


def state_of(ledger):
    rows = [tuple(r) for r in ledger.rows().select("commit", "offset", "outcome").orderBy("commit", "offset").collect()]
    drop = lambda f, *c: sorted(map(str, f.drop(*c).collect()))
    return rows, drop(ledger.current(), "updated_at"), drop(ledger.processed(), "processed_at"), sorted(r[0] for r in ledger.frames().collect()), drop(ledger.dead_letters(), "first_failed_at", "last_failed_at")


def batches(n=4):
    rng = random.Random(1)
    out = []
    for k in range(n):
        out.append([event(rng.randrange(12), f"v{rng.randrange(3)}", rng.randrange(50)) for _ in range(4)] + ["{poison", event(100 + k % 2, lat=999)])
    return out


def test_merging_changes_nothing_also_when_killed(spark, tmp_path):
    plain, merged = Ledger(spark, f"{tmp_path}/plain", fanout=100), Ledger(spark, f"{tmp_path}/merged", fanout=100)
    for ledger in (plain, merged):
        feed(spark, ledger, batches())
    before = state_of(merged)
    assert before == state_of(plain)
    merged.fanout = 2

    def die(name):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        merged.compact(die)
    assert state_of(merged) == before and len(merged.manifest()["tables"]["rows"]) == 4
    assert merged.compact() > 0
    assert state_of(merged) == before
    assert all(len(e) <= 2 for e in merged.manifest()["tables"].values())
    # Equal again after more batches, some of whose ids are in merged folders.
    merged.fanout = plain.fanout = 3
    for ledger in (plain, merged):
        consume_batch(log_of(spark, event(3, ts=90), event(500, "v1", 90), start=1000), ledger, "run", 4)
    assert state_of(merged) == state_of(plain)


def test_a_batch_is_applied_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    feed(spark, ledger, [[event(1), "{poison"]])
    version = ledger.manifest()["version"]
    feed(spark, ledger, [[event(1), "{poison"]])
    assert ledger.manifest()["version"] == version and ledger.rows().count() == 2
    assert [tuple(r) for r in ledger.read_positions().collect()] == [("raw", 0, 2)]


def test_untouched_buckets_are_not_written_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    feed(spark, ledger, [[event(n, f"v{n}") for n in range(30)]])
    before = ledger.manifest()["current"]
    consume_batch(log_of(spark, event(100, "v3", 10, sequence=5), start=30), ledger, "run", 1)
    after = ledger.manifest()["current"]
    assert sum(before[b] != after[b] for b in before) == 1 and ledger.current().count() == 30
    found = ledger.current_position(["v3", "nobody"]).collect()
    assert [(r["event_id"], r["sequence"]) for r in found] == [(event_id(100), 5)]


def test_eight_operators_at_once_have_one_winner_each(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    feed(spark, ledger, [[event(n, lat=999) for n in range(3)]])
    entries = ledger.dead_letters().select("event_id").persist()
    gate, won = threading.Barrier(8), {}

    def mark(k):
        gate.wait()
        won[k] = {r[0] for r in Ledger(spark, str(tmp_path)).mark_replayed(entries, T0 + timedelta(days=400), f"op-{k}").collect()}

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(mark, range(8)))
    assert sorted(e for ids_ in won.values() for e in ids_) == sorted(event_id(n) for n in range(3))
    assert ledger.actions().filter("action = 'mark'").count() == 3
    assert {r["state"] for r in ledger.dead_letters().collect()} == {"replayed"}
    # A refusal after the mark makes it dead again, and it can be marked anew.
    consume_batch(log_of(spark, event(1, lat=999), start=10), ledger, "run", 1, now=T0 + timedelta(days=500))
    assert {r["event_id"]: r["state"] for r in ledger.dead_letters().collect()}[event_id(1)] == "dead"
    assert ledger.mark_replayed(entries, T0 + timedelta(days=600), "late").count() == 1
    assert sorted(map(str, dl.fold(ledger.actions()).collect())) == sorted(map(str, ledger.dead_letters().collect()))


@pytest.mark.parametrize("seed", range(2))
def test_merged_summaries_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, dead = [], {}
    for n in range(60):
        name = f"e{rng.randrange(8)}"
        when = T0 + timedelta(seconds=n // 2)
        if dead.get(name) and rng.random() < 0.4:
            rows.append((name, "mark", when, f"{n:03d}", None, None, None, None, None, None, None))
            dead[name] = False
        else:
            rows.append((name, "refuse", when, f"{n:03d}", f"p{n}".encode(), f"error {n}", "decode", rng.randrange(3), "t", 0, n))
            dead[name] = True
    rng.shuffle(rows)
    make = lambda part: spark.createDataFrame(part, DLQ_ACTIONS)
    cuts = [0, *sorted(rng.sample(range(60), 3)), 60]
    parts = [dl.summarize(make(rows[a:b])) for a, b in zip(cuts, cuts[1:]) if a < b]
    while len(parts) > 1:
        a = parts.pop(rng.randrange(len(parts)))
        b = parts.pop(rng.randrange(len(parts)))
        parts.append(dl.merge_summaries(a.unionByName(b)))
    merged = dl.entries(dl.merge_summaries(parts[0]))
    assert sorted(map(str, merged.collect())) == sorted(map(str, dl.fold(make(rows)).collect()))
    assert "Window [" not in merged._jdf.queryExecution().executedPlan().toString()
