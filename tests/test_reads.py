"""Resume, geometry, reports and reconciliation against plain definitions."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetfold.functions import geo
from fleetfold.operators import reconcile, reports, resume, routes
from fleetfold.schemas import HISTORY
from fleetfold.sources import tables
from tests.helpers import event_id

T = datetime(2026, 5, 1, tzinfo=timezone.utc)


def history(spark, rows):
    """rows: (n, seconds)"""
    full = [(event_id(n), "v", "r", 1.0, 2.0, None, None, T + timedelta(seconds=s), T, T, 0, n, n) for n, s in rows]
    return spark.createDataFrame(full, HISTORY)


def test_same_second_siblings_are_resumed(spark):
    hist = history(spark, [(1, 0), (2, 0), (3, 0)])
    ids = sorted(event_id(n) for n in (1, 2, 3))
    got = resume.positions_since(hist, F.lit(T).cast("timestamp"), ids[0]).collect()
    assert [r["event_id"] for r in got] == ids[1:]
    with pytest.raises(ValueError):
        resume.positions_since(hist, F.lit(T), ids[0], 0)
    with pytest.raises(ValueError):
        resume.positions_since(hist, F.lit(T), "")


def test_many_readers_equal_one_reader_at_a_time(spark):
    rng = random.Random(5)
    rows = [(n, rng.randrange(60) * 30) for n in range(150)]
    hist = history(spark, rows)
    clients = [("new", None), ("lost", event_id(999)), *[(f"c{i}", event_id(rng.choice([0, 1, rng.randrange(150)]))) for i in range(40)]]
    now, window, limit = T + timedelta(seconds=2000), 900, 7
    order = sorted((T + timedelta(seconds=s), event_id(n)) for n, s in rows)
    at = {e: ts for ts, e in order}
    want_verdicts, want_frames = {}, {}
    for client, last in clients:
        if last is None:
            want_verdicts[client] = ("ready", 0)
        elif last not in at or (now - at[last]).total_seconds() > window:
            want_verdicts[client] = ("reset", 0)
        else:
            frames = [e for ts, e in order if (ts, e) > (at[last], last)][:limit]
            want_verdicts[client], want_frames[client] = ("resumed", len(frames)), frames
    table = spark.createDataFrame(clients, "client_id STRING, last_event_id STRING")
    verdicts, frames = resume.resume(table, hist, F.lit(now).cast("timestamp"), window, limit, block_seconds=45)
    assert {r["client_id"]: (r["verdict"], r["frames"]) for r in verdicts.collect()} == want_verdicts
    got = {}
    for r in frames.orderBy("client_id", "frame_no").collect():
        got.setdefault(r["client_id"], []).append(r["event_id"])
    assert got == {c: f for c, f in want_frames.items() if f}


LOOP = [(13.0358, 77.5970), (13.0402, 77.6205), (13.0331, 77.6521), (12.9591, 77.6974), (13.0358, 77.5970)]


def waypoints(spark, **more):
    rows = [("loop", i, *p) for i, p in enumerate(LOOP)] + [(k, i, *p) for k, ps in more.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "route_id STRING, idx INT, lat DOUBLE, lon DOUBLE")


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_loop_is_closed_and_offsets_wrap(spark, block):
    w = waypoints(spark, still=[(1.0, 1.0), (1.0, 1.0)])
    segments, lengths = routes.route_segments(w, block), routes.route_lengths(w, block)
    total = sum(metres(a, b) for a, b in zip(LOOP, LOOP[1:]))
    loop = lengths.filter("route_id = 'loop'").first()
    assert loop["closed"] and math.isclose(loop["length_m"], total, rel_tol=1e-9)
    first = metres(LOOP[0], LOOP[1])
    asked = [(0, 0.5), (1, 3.5), (2, -0.5), (3, 0.0), (4, 1.0), (5, first / total)]
    offsets = spark.createDataFrame([(i, "loop", f * total) for i, f in asked] + [(9, "still", 5.0)], "offset_id BIGINT, route_id STRING, offset_m DOUBLE")
    got = {r["offset_id"]: r for r in routes.locate_on_route(offsets, segments, lengths, blocks_per_route=5).collect()}
    assert 9 not in got
    for other in (1, 2):
        assert metres((got[0]["lat"], got[0]["lon"]), (got[other]["lat"], got[other]["lon"])) < 1
    assert (got[3]["lat"], got[3]["lon"], got[3]["segment"]) == (*LOOP[0], 0)
    assert metres((got[5]["lat"], got[5]["lon"]), LOOP[1]) < 1


def test_geometry_documents_and_their_faults(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"note":["x"],"routes":[{"id":"a","name":"A","points":[[1,2],{"lat":1.5,"lon":2.5},[1,2]]},'
        '{"id":"b","name":"B","points":[[1,2]]},{"id":"c","name":"C","points":[[1,2],[1,2]]},{"id":"d","name":"D","points":[[1,2,3],[1,2]]}]}'
    )
    w = tables.read_waypoints(spark, str(tmp_path))
    assert [tuple(r) for r in w.filter("route_id = 'a'").orderBy("idx").collect()] == [("a", 0, 1.0, 2.0), ("a", 1, 1.5, 2.5), ("a", 2, 1.0, 2.0)]
    assert {r["route_id"] for r in tables.geometry_faults(w).collect()} == {"b", "c", "d"}


def test_bearing_of_equal_points_and_north(spark):
    b = lambda *v: spark.range(1).select(geo.bearing_deg(*map(F.lit, v)).alias("b")).first()["b"]
    assert b(1.0, 1.0, 1.0, 1.0) == 0 and b(1.0, 1.0, 2.0, 1.0) == 0 and abs(b(0.0, 1.0, 0.0, 0.0) - 270) < 1e-9


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [0.0, -3.5, 7.25, 7.25, 1e-9, 1e12, -1e-300], [round(random.Random(1).gauss(3, 20), 2) for _ in range(500)], [10.0 + i * 1e-7 for i in range(101)]])
def test_nearest_rank_is_exact(spark, values):
    def rank(percent):
        """The smallest value that at least as many values reach as the share rounds to, one at least."""
        wanted = max(1, round(len(values) * percent / 100))
        return min(v for v in values if sum(other <= v for other in values) >= wanted)

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    got = reports.nearest_rank(df, F.col("v"), {"p1": 1, "p50": 50, "p95": 95, "p99": 99}).first()
    assert tuple(got) == tuple(rank(p) for p in (1, 50, 95, 99))


def test_histogram_and_empty_reports(spark):
    df = spark.createDataFrame([(1,), (5,), (60,), (900,)], "n INT")
    got = [(r["le"], r["cumulative"], r["value_sum"], r["total"]) for r in reports.histogram(df, F.col("n"), [1, 10, 100]).collect()]
    assert got == [(1.0, 1, 966, 4), (10.0, 2, 966, 4), (100.0, 3, 966, 4), (None, 4, 966, 4)]
    empty = spark.createDataFrame([], "latency_ms DOUBLE")
    row = reports.latency_report(empty).first()
    assert (row["delivered"], row["undelivered"], row["p50_ms"]) == (0, 0, None)


def test_lag_and_reconciliation(spark):
    ends = spark.createDataFrame([("a", 0, 10), ("a", 1, 4), ("a", 2, 3), ("b", 0, 9)], "topic STRING, partition INT, end_offset BIGINT")
    read = spark.createDataFrame([("a", 0, 7), ("a", 1, 6), ("b", 0, None)], "topic STRING, partition INT, committed BIGINT")
    lags = reconcile.lag_by_partition(ends, read)
    assert {(r["topic"], r["partition"]): r["lag"] for r in lags.collect()} == {("a", 0): 3, ("a", 2): 3}
    assert reconcile.total_lag(lags).first()[0] == 6 and reconcile.total_lag(lags.limit(0)).first()[0] == 0
    log = spark.createDataFrame([("x", None), ("x", None), ("y", None), ("z", None), ("q", "decode")], "event_id STRING, reason STRING")
    ledger = spark.createDataFrame([("x",), ("y",), ("y",), ("w",)], "event_id STRING")
    got = {r["event_id"]: r["problem"] for r in reconcile.reconcile_log_vs_ledger(log, ledger).collect()}
    assert got == {"y": "processed more than once", "z": "never processed", "w": "not in the log"}
