"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetfold.plans import catalog  # noqa: E402
from fleetfold.plans import stream_queries  # noqa: E402
from fleetfold.plans import telemetry as t  # noqa: E402
from fleetfold.session import build_session, work_dir  # noqa: E402
from fleetfold.sources import log as log_source  # noqa: E402
from fleetfold.streaming.consume import run_stream  # noqa: E402
from fleetfold.streaming.ledger import Ledger  # noqa: E402

# Classification end to end, the state it leaves, ingest, dead letters, resume, reports, geometry.
HEADLINE = [
    "outcome_ledger", "classify", "append_history", "current_state", "state_drift", "incremental_outcomes",
    "reconcile_log_vs_ledger", "accept_submissions", "fold_dead_letters", "resume_clients", "latency_report",
    "nearest_rank", "interval_rate", "route_lengths", "track_legs", "vehicle_track", "run_stream",
]


def batch_times(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of a micro-batch, over a stream of one file to a batch."""
    path = stream_queries._produced(spark, sf_dir)
    source = log_source.read_log(spark, path, stream=True, max_files=1)
    query = run_stream(source, Ledger(spark, work_dir(spark, "ledger")), work_dir(spark, "checkpoint"))
    query.awaitTermination()
    took = sorted(p["durationMs"]["triggerExecution"] / 1000 for p in query.recentProgress if p["numInputRows"])
    at = lambda share: took[min(len(took) - 1, int(share * len(took)))]
    return {"micro_batches": len(took), "micro_batch_p50_s": at(0.5), "micro_batch_p95_s": at(0.95)} if took else {}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    only = sys.argv[1:] or HEADLINE
    known["outcome_ledger"](spark, sf_dir).collect()  # warm-up: class loading and code generation
    times = {}
    for name in only:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    records = t.rows(spark, sf_dir).count()
    extra = {"log_records": records}
    for name in ("outcome_ledger", "run_stream"):
        if name in times:
            extra[f"{name}_events_per_s"] = round(records / times[name], 1)
    if "reconcile_log_vs_ledger" in times:
        extra["reconcile_records_per_s"] = round(records / times["reconcile_log_vs_ledger"], 1)
    if not sys.argv[1:]:
        extra |= batch_times(spark, sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
