from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import reconcile
from fleetfold.operators.envelope import judge
from fleetfold.sources import log as log_source
from fleetfold.streaming.consume import replay, run_stream
from fleetfold.streaming.ledger import Ledger
from tests.helpers import at, envelope, event_id, log_of, position


def event(n, vehicle="v", ts=0.0, **more):
    return envelope(n, payload=position(vehicle=vehicle, ts=at(ts), **more))


class Setup:
    def __init__(self, spark, path):
        self.spark, self.log, self.checkpoint = spark, f"{path}/log", f"{path}/checkpoint"
        self.ledger, self.next = Ledger(spark, f"{path}/ledger"), 0

    def produce(self, *docs):
        log_source.write_log(log_of(self.spark, *docs, start=self.next).coalesce(1), self.log)
        self.next += len(docs)

    def drain(self, checkpoint=None, **more):
        source = log_source.read_log(self.spark, self.log, stream=True, max_files=1)
        run_stream(source, self.ledger, checkpoint or self.checkpoint, **more).awaitTermination()

    def outcomes(self):
        return [r["outcome"] for r in self.ledger.rows().orderBy("commit", "offset").collect()]


@pytest.fixture
def setup(spark, tmp_path):
    return Setup(spark, tmp_path)


@pytest.mark.parametrize("step", ["begin", "dlq_topic", "rows", "snapshot"])
def test_killed_between_writes_and_restarted(setup, step):
    setup.produce(event(1, ts=0), event(2, ts=10), "{poison", event(1, ts=0))
    setup.drain()
    setup.produce(event(3, ts=5), event(4, ts=20), event(2, ts=10), "{more")

    def die(name):
        if name == step:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        setup.drain(after=die)
    setup.drain()
    assert setup.outcomes() == ["applied", "applied", "dead", "duplicate", "late", "applied", "duplicate", "dead"]
    assert setup.ledger.current().first()["last_event_id"] == event_id(4)
    assert setup.ledger.history().count() == 4 and setup.ledger.frames().count() == 4
    copies = setup.spark.read.parquet(setup.ledger.root + "/dlq_topic").select(F.col("value").cast("string")).collect()
    assert sorted(r[0] for r in copies) == ["{more", "{poison"]
    assert reconcile.reconcile_log_vs_ledger(judge(log_source.read_log(setup.spark, setup.log)), setup.ledger.processed()).count() == 0


def test_rewind_applies_nothing_new(setup, tmp_path):
    setup.produce(*[event(n, vehicle=f"v{n % 2}", ts=n) for n in range(4)])
    setup.produce(*[event(n, vehicle=f"v{n % 2}", ts=n) for n in range(4, 7)])
    setup.drain()
    before = setup.ledger.current().orderBy("vehicle_id").collect()
    setup.drain(checkpoint=f"{tmp_path}/again")
    assert setup.outcomes() == ["applied"] * 7 + ["duplicate"] * 7
    assert setup.ledger.history().count() == 7 and setup.ledger.current().orderBy("vehicle_id").collect() == before


def test_a_failing_publisher_loses_frames_only(setup):
    def broken(frames):
        raise OSError("bus down")

    setup.produce(event(1))
    setup.drain(publish=broken)
    assert setup.outcomes() == ["applied"] and setup.ledger.frames().count() == 0


def test_half_written_commits_are_not_read(setup):
    setup.produce(event(1, ts=0), "{poison")
    setup.drain()
    setup.produce(event(2, ts=10), "{more")

    def die(name):
        if name == "rows":
            raise RuntimeError("killed")

    # A writer that died with its folders in place but no marker, then another run over the same log.
    with pytest.raises(Exception, match="killed"):
        setup.drain(after=die)
    listed = {e["path"] for e in setup.ledger.manifest()["tables"]["rows"]}
    left = {f"data/rows/{p.name}" for p in Path(setup.ledger.root, "data", "rows").iterdir()} - listed
    assert len(left) == 1
    assert setup.ledger.history().count() == 1 and setup.ledger.dead_letters().count() == 1
    setup.drain(setup.checkpoint + "-2")
    assert {r["event_id"] for r in setup.ledger.history().collect()} == {event_id(1), event_id(2)}
    assert setup.ledger.processed().count() == 2 and not left & {e["path"] for e in setup.ledger.manifest()["tables"]["rows"]}
    assert setup.ledger.rows().filter("outcome <> 'dead' and value is not null").count() == 0


def test_positions_are_counted_per_topic(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("b", 0, 3)]
    records = spark.createDataFrame(rows, "topic STRING, partition INT, arrival BIGINT")
    ends = spark.createDataFrame([("a", 0, 5), ("b", 0, 9), ("c", 0, 1)], "topic STRING, partition INT, end_offset BIGINT")
    placed = log_source.assign_positions(records, 1, "arrival", ends)
    assert sorted((r["topic"], r["offset"]) for r in placed.collect()) == [("a", 5), ("a", 6), ("b", 9)]


def test_replay_of_a_dead_letter_then_refused_again(setup):
    setup.produce(event(1, lat=999), "{poison", event(2))
    setup.drain()
    assert setup.ledger.dead_letters().filter("state = 'dead'").count() == 2

    def produce(records):
        stamped = records.withColumns({"arrival": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()})
        ends = reconcile.topic_offsets(log_source.read_log(setup.spark, setup.log))
        log_source.write_log(log_source.assign_positions(stamped, 1, "arrival", ends), setup.log)

    replay(setup.ledger, produce, datetime.now(timezone.utc), "op")
    assert {r["state"] for r in setup.ledger.dead_letters().collect()} == {"replayed"}
    setup.drain()
    dead = {r["event_id"]: r["state"] for r in setup.ledger.dead_letters().collect()}
    # The event with an id of its own is the same dead letter again; the undecodable copy has a new position.
    assert dead[event_id(1)] == "dead" and sorted(dead.values()) == ["dead", "dead", "replayed"]
    assert log_source.read_log(setup.spark, setup.log).filter("offset >= 3").count() == 2


def test_positions_are_consecutive_and_follow_the_key(spark):
    keys = spark.range(500).select(F.lit("raw").alias("topic"), F.encode(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20).cast("string")), "UTF-8").alias("key"), (F.col("id") * 2).alias("arrival"))
    placed = log_source.assign_positions(keys, 6, "arrival", rows_per_block=17)
    per = placed.groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("z"), F.count("*").alias("n"), F.countDistinct("offset").alias("d")).collect()
    assert all(r["a"] == 0 and r["z"] == r["n"] - 1 and r["d"] == r["n"] for r in per) and len(per) > 1
    assert reconcile.key_partition_check(placed).count() == 0
    rows = placed.orderBy("partition", "offset").collect()
    assert all(a["arrival"] < b["arrival"] for a, b in zip(rows, rows[1:]) if a["partition"] == b["partition"])
