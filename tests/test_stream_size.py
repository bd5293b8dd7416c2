"""What a batch of the streaming job keeps and how its log is written do not grow with single tasks."""

import pytest

from fleetfold.plans import stream_queries
from fleetfold.plans import telemetry as t
from fleetfold.streaming import consume
from fleetfold.streaming.ledger import Ledger
from tests.helpers import envelope, log_of


class Enough(Exception):
    pass


def test_bytes_are_kept_of_refused_records_only(spark, tmp_path, monkeypatch):
    seen = {}

    def stop(rows, *_):
        seen.update({r["offset"]: r["value"] is not None for r in rows.collect()})
        raise Enough

    monkeypatch.setattr(consume.classify, "classify", stop)
    with pytest.raises(Enough):
        consume.consume_batch(log_of(spark, (0, 0, envelope(1)), (0, 1, "{")), Ledger(spark, str(tmp_path)), "run", 0)
    assert seen == {0: False, 1: True}


def test_a_longer_log_is_written_in_more_files(spark, monkeypatch):
    monkeypatch.setattr(t, "SPREAD_ROWS", 10)
    assert stream_queries._files(spark.range(100), 2) == stream_queries.FILES
    assert stream_queries._files(spark.range(1001), 2) == 51
