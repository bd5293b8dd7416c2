"""Stored positions against a plain sort, also after late appends, with a stuck clock and without a window."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import resume
from fleetfold.schemas import HISTORY, columns
from fleetfold.streaming.timeline import Timeline
from tests.helpers import T0


def history(spark, rows):
    number = lambda i: int(i[1:]) if i[1:].isdigit() else 9999
    full = [(i, "v", "r", 1.0, 2.0, 3.0, 4.0, t, t, t, 0, number(i), number(i)) for i, t in rows]
    return spark.createDataFrame(full, HISTORY)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    # A third at one instant.
    return [(f"e{k:04d}", T0 if k % 3 == 0 else T0 + timedelta(seconds=rng.randrange(3000))) for k in range(n)]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    rows = rows_of(1)
    random.Random(2).shuffle(rows)
    timeline = Timeline(spark, str(tmp_path_factory.mktemp("t")), 600, 40)
    for part in (rows[:200], rows[200:290], rows[290:]):
        timeline.append(history(spark, part))
    return timeline, rows


def test_positions_are_those_of_a_sort(filled):
    timeline, rows = filled
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["event_id"]: r["position"] for r in timeline.rows().collect()}
    assert got == {e: n + 1 for n, (e, _) in enumerate(order)}
    assert timeline.index().agg(F.sum("rows")).first()[0] == len(rows)


def test_an_append_writes_the_blocks_it_falls_into(spark, filled, tmp_path):
    timeline = Timeline(spark, str(tmp_path), 600)
    timeline.append(history(spark, rows_of(3)))
    before = {r["block"]: r["path"] for r in timeline.index().collect()}
    timeline.append(history(spark, [("late", T0 + timedelta(seconds=1300))]))
    after = {r["block"]: r["path"] for r in timeline.index().collect()}
    assert sum(before[b] != after[b] for b in before) == 1
    plan = timeline.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and "Window(" not in plan


def test_one_reader_opens_its_blocks_only(filled):
    timeline, rows = filled
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for at in (0, 99, 150, 295, 299):
        event_id, ts = order[at]
        found = timeline.since(event_id, F.lit(ts).cast("timestamp"), 7)
        assert [r["event_id"] for r in found.collect()] == [e for e, _ in order[at + 1 : at + 8]]
    assert timeline.since("zzz", F.lit(T0 + timedelta(days=9)).cast("timestamp"), 7).count() == 0
    with pytest.raises(ValueError):
        timeline.since("", F.lit(T0), 7)


@pytest.mark.parametrize("window", [0, 1500])
def test_many_readers_get_what_the_plain_operator_gives(spark, filled, window):
    timeline, rows = filled
    now = F.lit(T0 + timedelta(seconds=3000)).cast("timestamp")
    clients = spark.createDataFrame([(c, e) for c, e in enumerate([rows[5][0], rows[5][0], rows[77][0], "unknown", None, "", *[r[0] for r in rows[100:140]]])], "client_id INT, last_event_id STRING")
    want = resume.resume(clients, history(spark, rows), now, window, 11)
    got = timeline.resume(clients, now, window, 11)
    for a, b in zip(want, got):
        names = [c for c in a.columns if c in ("client_id", "verdict", "frames", "event_id", "frame_no", "event_ts", "sequence")]
        assert sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))
    assert got[0].count() == 46 and set(columns(HISTORY)) <= set(got[1].columns)
