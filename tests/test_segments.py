"""A log of segments: what the index says, which files a read opens, batches bounded by records."""

from pyspark.sql import functions as F

from fleetfold.operators import reconcile
from fleetfold.sources import segments
from fleetfold.streaming.consume import consume_log
from fleetfold.streaming.ledger import Ledger
from tests.helpers import at, envelope, log_of, position


def event(n, vehicle="v", ts=0.0):
    return envelope(n, payload=position(vehicle=vehicle, ts=at(ts)))


def filled(spark, path):
    docs = [(p, o, event(100 * p + o, f"v{p}", o)) for p in range(2) for o in range(0, 40, 2)]
    segments.append(log_of(spark, *docs[:30]), path, 10)
    segments.append(log_of(spark, *docs[30:], (2, 7, event(999, "w"))), path, 10)
    return log_of(spark, *docs, (2, 7, event(999, "w")))


def test_index_says_what_the_records_say(spark, tmp_path):
    log = filled(spark, str(tmp_path))
    want = sorted(map(tuple, reconcile.topic_offsets(log).collect()))
    assert sorted(map(tuple, segments.ends(spark, str(tmp_path)).collect())) == want
    assert sorted(r["offset"] for r in segments.read(spark, str(tmp_path)).collect()) == sorted(r["offset"] for r in log.collect())


def test_a_read_opens_later_segments_only(spark, tmp_path):
    filled(spark, str(tmp_path))
    found = segments.read(spark, str(tmp_path), {("raw", 0): 31, ("raw", 1): 40, ("raw", 2): 8})
    assert sorted((r["partition"], r["offset"]) for r in found.collect()) == [(0, o) for o in (32, 34, 36, 38)]
    assert len(found.inputFiles()) == 1
    part = segments.read(spark, str(tmp_path), {("raw", 0): 5}, {("raw", 0): 9, ("raw", 1): 0, ("raw", 2): 0})
    assert [r["offset"] for r in part.collect()] == [6, 8] and len(part.inputFiles()) == 1
    assert segments.read(spark, str(tmp_path), {("raw", p): 99 for p in range(3)}).count() == 0


def test_a_half_written_append_is_not_part_of_the_log(spark, tmp_path):
    filled(spark, str(tmp_path))
    before = segments.read(spark, str(tmp_path)).count()
    log_of(spark, event(5000)).write.parquet(f"{tmp_path}/segments/half/_topic=raw/_partition=0/_segment=9")
    assert segments.read(spark, str(tmp_path)).count() == before


def test_batches_hold_so_many_records_at_the_most(spark, tmp_path):
    filled(spark, f"{tmp_path}/log")
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    sizes = consume_log(spark, f"{tmp_path}/log", ledger, 30)
    assert sum(sizes) == 41 and max(sizes) <= 30 and len(sizes) > 1
    assert {tuple(r) for r in ledger.read_positions().collect()} == {("raw", 0, 39), ("raw", 1, 39), ("raw", 2, 8)}
    assert consume_log(spark, f"{tmp_path}/log", ledger, 30) == []
    segments.append(log_of(spark, (0, 50, event(51, "v0", 50))), f"{tmp_path}/log", 10)
    assert consume_log(spark, f"{tmp_path}/log", ledger, 30) == [1]
    assert consume_log(spark, f"{tmp_path}/log", ledger, 1000, "again", rewind=True) == [42]
    assert ledger.history().count() == 42 and ledger.rows().filter(F.col("outcome") == "duplicate").count() == 42
