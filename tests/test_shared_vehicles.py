"""Vehicles that lie in several partitions: batches must follow the order of the whole log (see ``stream_queries._steps``)."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetfold.operators import classify
from fleetfold.operators.envelope import judge
from fleetfold.plans import log_queries, stream_queries
from fleetfold.sources import segments
from fleetfold.streaming.consume import consume_log
from fleetfold.streaming.ledger import Ledger
from tests.helpers import at, envelope, log_of, position
from tests.oracle import normal

QUERIES = log_queries.QUERIES | stream_queries.QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Users 10,000 to 10,019 are two vehicles, as identifiers are cut to four digits."""
    path = str(tmp_path_factory.mktemp("sf"))
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 7919 % 90000) AS ts, 10000 + i * 13 % 20 AS user_id, 'click' AS event_type,
        i / 7.0 AS value, '{{}}' AS props FROM range(1200) r(i)) TO '{path}/events.parquet'""")
    return path


@pytest.mark.parametrize("name", ["incremental_outcomes", "run_stream", "rewind_stream", "retry_stream", "bounded_batches"])
def test_batches_equal_one_batch(spark, folder, name):
    query, sql = QUERIES[name]
    found = query(spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        cursor = con.execute(sql)
        want = normal([d[0] for d in cursor.description], cursor.fetchall())
    columns = [F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in found.dtypes]
    assert normal(found.columns, [tuple(r) for r in found.select(*columns).collect()]) == want


@pytest.mark.parametrize("most", [7, 25])
def test_batches_in_order_are_ranges_of_the_log(spark, tmp_path, most):
    docs = [(p, o, envelope(100 * p + o, payload=position(vehicle="v", ts=at(o - 9.0 * p)))) for p in range(3) for o in range(0, 24, 3)]
    for part in (docs[::2], docs[1::2]):
        segments.append(log_of(spark, *part), f"{tmp_path}/log", 10)
    positions, taken = {}, []
    while stops := segments.next_stops(spark, f"{tmp_path}/log", positions, most, in_order=True):
        batch = [(r["partition"], r["offset"]) for r in segments.read(spark, f"{tmp_path}/log", {k: positions.get(k, 0) for k in stops}, stops).collect()]
        assert len(batch) <= most and stops != positions
        taken += sorted(batch)
        positions = stops
    assert taken == [(p, o) for p, o, _ in docs]
    if most == 7:
        ledger = Ledger(spark, f"{tmp_path}/ledger")
        consume_log(spark, f"{tmp_path}/log", ledger, most, in_order=True)
        whole = classify.classify(judge(log_of(spark, *docs)))
        outcomes = lambda rows: sorted(tuple(r) for r in rows.select("partition", "offset", "outcome").collect())
        assert outcomes(ledger.rows()) == outcomes(whole)
