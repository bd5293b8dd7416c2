"""The ledger: what became of every log record, and all that follows from it, as of one manifest.

A batch writes its rows and what it derives from them into new folders, side by side: handled ids with their
filters, refusals folded per event, frames, and the buckets of the current state that it changes. One manifest
then makes all of it visible at once (see ``manifest``); before that nothing is, so redoing a batch leaves only
folders nobody lists. A run and batch number that a manifest has recorded is not applied again.

Tables grow by one folder per batch and are merged in tiers: ``FANOUT`` folders of a tier become one of the next, so
there are about FANOUT * log(batches) of them, and a row is rewritten log(batches) times. Merging is a commit
like any other and changes no result. Payload bytes are kept for refused records only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.operators import deadletters, known_ids, state
from fleetfold.operators.envelope import judge
from fleetfold.schemas import CURRENT, DLQ_ACTIONS, LEDGER, LOG, columns
from fleetfold.streaming.manifest import Abandon, Manifests, retire

ROWS = LEDGER + ", commit BIGINT"
CURRENT_SEQUENCE = CURRENT + ", sequence BIGINT"
UNJUDGED = LOG + ", tries INT, due_at TIMESTAMP"
QUEUE = (
    UNJUDGED + ", event_id STRING, schema_version BIGINT, event_type STRING, produced_at TIMESTAMP, source STRING, vehicle_id STRING, route_id STRING, "
    "lat DOUBLE, lon DOUBLE, speed_kph DOUBLE, bearing_deg DOUBLE, event_ts TIMESTAMP, sequence DECIMAL(20,0), reason STRING, attempts INT, error_field STRING, error STRING"
)
SCHEMAS = {"rows": ROWS, "frames": "frame STRING", "summary": deadletters.SUMMARY, "marks": DLQ_ACTIONS}
FANOUT = 8
BUCKETS = 16
FILE_ROWS = 1_000_000  # rows to a file of a merged folder


class Ledger:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark = spark
        self.root = root.rstrip("/")
        self.manifests = Manifests(spark, self.root)
        self.buckets, self.fanout = buckets, fanout

    # -- reading -------------------------------------------------------------------------------

    def manifest(self) -> dict:
        return self.manifests.load()

    def _path(self, *parts: object) -> str:
        return self.manifests.path(*parts)

    def _entries(self, table: str, manifest: dict | None = None) -> list[dict]:
        return (manifest or self.manifest())["tables"].get(table, [])

    def _read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """Rows of the folders that the manifest lists, and of no others."""
        paths = [self._path(e["path"]) for e in self._entries(table, manifest)]
        reader = self.spark.read.schema(SCHEMAS[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def rows(self) -> DataFrame:
        """Handled records with the ``commit`` that handled them."""
        return self._read("rows")

    def id_entries(self, manifest: dict | None = None) -> list[known_ids.Entry]:
        return [known_ids.Entry(self._path(e["path"]), e["rows"], e["buckets"]) for e in self._entries("ids", manifest)]

    def processed(self) -> DataFrame:
        return known_ids.read_ids(self.spark, self.id_entries())

    def known(self, ids: DataFrame, batch: int, manifest: dict | None = None) -> DataFrame:
        """Handled ids among ``ids`` (and others of their buckets)."""
        return known_ids.known(ids, self.id_entries(manifest), batch)

    def history(self) -> DataFrame:
        return state.history(self.rows())

    def _current(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["current"]
        paths = [self._path(held[str(b)]) for b in (range(self.buckets) if buckets is None else buckets) if str(b) in held]
        return self.spark.read.schema(CURRENT_SEQUENCE).parquet(*paths) if paths else self.spark.createDataFrame([], CURRENT_SEQUENCE)

    def current(self) -> DataFrame:
        """Latest state per vehicle: a read of the stored buckets."""
        return self._current(self.manifest()).select(*columns(CURRENT))

    def current_position(self, vehicle_ids: list[str] | None = None) -> DataFrame:
        return state.current_position(self._current(self.manifest()), vehicle_ids)

    def frames(self) -> DataFrame:
        return self._read("frames")

    def read_positions(self) -> DataFrame:
        """Next offset to read per topic and partition, as the manifest has it; no table is read."""
        return self.spark.createDataFrame([tuple(p) for p in self.manifest()["positions"]], "topic STRING, partition INT, committed BIGINT")

    def queue(self, manifest: dict | None = None) -> DataFrame:
        """Records that wait, judged: to be tried again, or held back behind one that is."""
        path = (manifest or self.manifest())["queue"]
        if path and path.startswith("data/queue/"):  # written when records were judged again in every turn
            return judge(self.spark.read.schema(UNJUDGED).parquet(self._path(path)))
        return self.spark.read.schema(QUEUE).parquet(self._path(path)) if path else self.spark.createDataFrame([], QUEUE)

    # -- committing ----------------------------------------------------------------------------

    def handled(self, run_id: str, batch_id: int, manifest: dict | None = None) -> bool:
        return (manifest or self.manifest())["runs"].get(run_id, -1) >= batch_id

    def _store(self, table: str, rows: DataFrame) -> str:
        path = f"data/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(self._path(path))
        return path

    def commit_batch(
        self, base: dict, run_id: str, batch_id: int, rows: DataFrame, queue: DataFrame | None,
        positions: list[tuple[str, int, int]], step: Callable[[str], None], with_frames: bool = True,
    ) -> DataFrame:
        """Store classified ``rows`` (``LEDGER`` columns) and everything derived from them; returns the rows as stored."""
        number = base["commit"] + 1
        path = self._store("rows", rows.select(*columns(LEDGER)).withColumn("commit", F.lit(number).cast("bigint")))
        step("rows")
        new = self.spark.read.schema(ROWS).parquet(self._path(path))
        done = self._derive(base, new, queue, with_frames)
        step("snapshot")

        def change(manifest: dict) -> None:
            if self.handled(run_id, batch_id, manifest):
                raise Abandon
            manifest["commit"] = max(number, manifest["commit"])
            manifest["runs"][run_id] = batch_id
            added = {"rows": {"path": path}} | {k: v for k, v in done["tables"].items() if v}
            for table, entry in added.items():
                manifest["tables"].setdefault(table, []).append({"tier": 0, "commit": number, **entry})
            retire(manifest, *[manifest["current"].get(b) for b in done["current"]], manifest["queue"])
            manifest["current"].update(done["current"])
            manifest["queue"] = done["queue"]
            known = {(t, p): n for t, p, n in manifest["positions"]} | {(t, p): n for t, p, n in positions}
            manifest["positions"] = sorted([t, p, n] for (t, p), n in known.items())

        try:
            self.manifests.commit(change)
        except Abandon:
            pass
        return new

    def _derive(self, base: dict, new: DataFrame, queue: DataFrame | None, with_frames: bool) -> dict:
        """Write the folders that follow from new rows; they do not depend on one another."""
        applied = state.history(new)

        def ids() -> dict | None:
            handled = state.processed(new)
            count = handled.count()
            path = f"data/ids/{uuid.uuid4().hex}"
            return None if not count else {"path": path, "rows": count, "buckets": known_ids.write_ids(handled, self._path(path), count, self.buckets).buckets}

        def current() -> dict:
            place = F.pmod(F.xxhash64("vehicle_id"), F.lit(self.buckets)).cast("int").alias("_bucket")
            touched = sorted(r[0] for r in applied.select(place).distinct().collect())
            if not touched:
                return {}
            folder = f"data/current/{uuid.uuid4().hex}"
            merged = state.guarded_upsert(self._current(base, touched), applied, "sequence")
            merged.withColumn("bucket", place).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(self._path(folder))
            return {str(b): f"{folder}/bucket={b}" for b in touched}

        def frames() -> dict | None:
            found = state.fanout_frames(new)
            return {"path": self._store("frames", found.select(state.frame_json(found).alias("frame")))} if with_frames else None

        def summary() -> dict | None:
            dead = new.filter(F.col("outcome") == "dead")
            return None if dead.isEmpty() else {"path": self._store("summary", deadletters.summarize(deadletters.refusals(dead)))}

        def waiting() -> str | None:
            return None if queue is None else self._store("waiting", queue.select(*columns(QUEUE)))

        jobs = {"ids": ids, "current": current, "frames": frames, "summary": summary, "queue": waiting}
        with ThreadPoolExecutor(len(jobs)) as pool:
            running = {name: pool.submit(inheritable_thread_target(self.spark)(job)) for name, job in jobs.items()}
            done = {name: job.result() for name, job in running.items()}
        return {"tables": {k: done[k] for k in ("ids", "frames", "summary")}, "current": done["current"], "queue": done["queue"]}

    # -- merging -------------------------------------------------------------------------------

    def compact(self, step: Callable[[str], None] | None = None) -> int:
        """Merge every tier that is full; returns how many folders were merged. Safe to kill and to repeat."""
        merged = 0
        for table in ("rows", "ids", "frames", "summary", "marks"):
            while True:
                tiers: dict[int, list[dict]] = {}
                for entry in self._entries(table):
                    tiers.setdefault(entry["tier"], []).append(entry)
                full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
                if full is None:
                    break
                merged += self._merge(table, tiers[full][: self.fanout], full + 1, step)
        return merged

    def _merge(self, table: str, old: list[dict], tier: int, step: Callable[[str], None] | None) -> int:
        paths = [self._path(e["path"]) for e in old]
        entry = {"tier": tier, "commit": old[-1]["commit"]}
        if table == "ids":
            rows = sum(e["rows"] for e in old)
            entry |= {"path": f"data/ids/{uuid.uuid4().hex}", "rows": rows, "buckets": self.buckets}
            found = known_ids.read_ids(self.spark, [known_ids.Entry(p, e["rows"], e["buckets"]) for p, e in zip(paths, old)])
            known_ids.write_ids(found, self._path(entry["path"]), rows, self.buckets)
        else:
            found = self.spark.read.schema(SCHEMAS[table]).parquet(*paths)
            if table == "summary":
                found = deadletters.merge_summaries(found)
            else:
                found = found.coalesce(max(1, found.count() // FILE_ROWS))
            entry["path"] = self._store(table, found)
        if step:
            step("merged")
        gone = {e["path"] for e in old}

        def change(manifest: dict) -> None:
            entries = manifest["tables"][table]
            if not gone <= {e["path"] for e in entries}:
                raise Abandon  # another writer merged them
            at = min(i for i, e in enumerate(entries) if e["path"] in gone)
            rest = [e for e in entries if e["path"] not in gone]
            manifest["tables"][table] = [*rest[:at], entry, *rest[at:]]
            retire(manifest, *gone)

        try:
            self.manifests.commit(change)
        except Abandon:
            self.manifests.delete(entry["path"])
        return len(old)

    # -- dead letters --------------------------------------------------------------------------

    def actions(self) -> DataFrame:
        """Refusals (from the rows) and replay marks, for audits; ``dead_letters`` does not read them."""
        return deadletters.refusals(self.rows()).unionByName(self._read("marks"))

    def _dead_letters(self, manifest: dict) -> DataFrame:
        return deadletters.entries(deadletters.merge_summaries(self._read("summary", manifest)))

    def dead_letters(self) -> DataFrame:
        """Folded from the summaries of refusals and marks; applied rows are not read."""
        return self._dead_letters(self.manifest())

    def mark_replayed(self, entries: DataFrame, at: datetime, operator: str) -> DataFrame:
        """Mark the entries that are dead right now, and return them (event_id); of several operators one wins each.

        The marks count for the version they were computed from. If another commit was first they are computed
        anew, so an entry that somebody else has marked since is not marked again.
        """
        wanted = entries.select("event_id").distinct()
        winners: list[DataFrame] = []

        def change(manifest: dict) -> None:
            winners.clear()
            dead = self._dead_letters(manifest).filter("state = 'dead'")
            made = deadletters.marks(dead.join(wanted, "event_id", "left_semi"), F.lit(at).cast("timestamp"), F.lit(operator))
            path = self._store("marks", made)
            made = self.spark.read.schema(DLQ_ACTIONS).parquet(self._path(path))
            winners.append(made.select("event_id"))
            if made.isEmpty():
                raise Abandon
            number = manifest["commit"] = manifest["commit"] + 1
            for table, folder in (("marks", path), ("summary", self._store("summary", deadletters.summarize(made)))):
                manifest["tables"].setdefault(table, []).append({"tier": 0, "commit": number, "path": folder})

        try:
            self.manifests.commit(change)
        except Abandon:
            pass
        return winners[0]
