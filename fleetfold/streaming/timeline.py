"""A history stored in the order readers resume in, with its numbers.

Reports lie in blocks of event time, each row with its place in the (event_ts, event_id) order of its block, beside
an index of one row per block: rows in it and rows before it. A position in the whole history is the sum of
both, so a reader is served without numbering anything: late reports change the counts of the blocks that
follow, which are in the index, and no row there. An append rewrites the blocks that its reports fall into and
the index; one manifest shows both at once, and what a killed writer left is not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfold.functions.text import stored_sequence
from fleetfold.operators.ordered import BLOCK_ROWS, Running, evenly, running, salted_join, time_block
from fleetfold.operators.resume import DEFAULT_LIMIT, DEFAULT_WINDOW_SECONDS, resume_points, resume_verdict
from fleetfold.schemas import HISTORY, columns
from fleetfold.streaming.manifest import Manifests, retire

STORED = HISTORY + ", block BIGINT, place BIGINT"
INDEX = "block BIGINT, path STRING, rows BIGINT"
BLOCK_SECONDS = 3600


def block_of(event_ts: str = "event_ts", seconds: int = BLOCK_SECONDS) -> Column:
    return F.floor(F.unix_seconds(F.col(event_ts).cast("timestamp")) / seconds)


class Timeline:
    def __init__(self, spark: SparkSession, root: str, seconds: int = BLOCK_SECONDS, rows_per_task: int = BLOCK_ROWS):
        self.spark, self.seconds, self.rows_per_task = spark, seconds, rows_per_task
        self.manifests = Manifests(spark, root)

    def _index(self, manifest: dict) -> DataFrame:
        path = manifest.get("index")
        return self.spark.read.schema(INDEX).parquet(self.manifests.path(path)) if path else self.spark.createDataFrame([], INDEX)

    def index(self) -> DataFrame:
        """block, path, rows, ``before``. The window holds one row per block, however many reports there are."""
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return self._index(self.manifests.load()).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))

    def _rows(self, paths: list[str]) -> DataFrame:
        full = [self.manifests.path(p) for p in paths]
        return self.spark.read.schema(STORED).parquet(*full) if full else self.spark.createDataFrame([], STORED)

    def append(self, reports: DataFrame) -> None:
        """Add history rows. Only blocks that they fall into are written again. One writer at a time."""
        base = self.manifests.load()
        new = reports.select(*columns(HISTORY)).withColumn("block", block_of(seconds=self.seconds))
        touched = self._index(base).join(new.select("block").distinct(), "block", "left_semi")
        gone = [r["path"] for r in touched.select("path").collect()]
        both = self._rows(gone).drop("place").unionByName(new)
        # A block may be one instant of a stuck clock; it is numbered in ranges, then, not in one task.
        order = [F.col("event_ts"), F.col("event_id")]
        rows, parts = evenly(both, ["block"], time_block("event_ts", max(1, self.seconds // 60)), order, self.rows_per_task)
        placed = running(rows, ["block"], parts, order, Running("place", "sum", F.lit(1).cast("bigint")))
        folder = f"data/{uuid.uuid4().hex}"
        named = placed.select(*columns(STORED)).withColumn("_block", F.col("block"))
        named.repartition("_block", F.floor(F.col("place") / self.rows_per_task)).sortWithinPartitions("_block", "place").write.partitionBy("_block").parquet(self.manifests.path(folder))
        written = self.spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(self.manifests.path(folder))
        counts = written.groupBy("block").agg(F.count("*").alias("rows"))
        fresh = counts.select("block", F.concat(F.lit(f"{folder}/_block="), F.col("block").cast("string")).alias("path"), "rows")
        kept = self._index(base).join(fresh.select("block"), "block", "left_anti")
        index = f"index/{uuid.uuid4().hex}"
        kept.unionByName(fresh).coalesce(1).write.parquet(self.manifests.path(index))

        def change(manifest: dict) -> None:
            if manifest["version"] != base["version"]:
                raise RuntimeError("another writer has added to this history")
            retire(manifest, *gone, manifest.get("index"))
            manifest["index"] = index

        self.manifests.commit(change)

    def _opened(self, index: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
        """Rows, with ``position``, of the blocks that reach into positions low to high."""
        wanted = index
        if low is not None:
            wanted = wanted.filter((F.col("before") + F.col("rows") >= low) & (F.col("before") < high))
        found = wanted.collect()
        before = self.spark.createDataFrame([(r["block"], r["before"]) for r in found], "block BIGINT, _before BIGINT")
        # A row per opened block.
        return self._rows([r["path"] for r in found]).join(F.broadcast(before), "block").withColumn("position", F.col("_before") + F.col("place")).drop("_before")

    def rows(self) -> DataFrame:
        """The whole history with positions."""
        return self._opened(self.index())

    def since(self, event_id: str, event_ts: Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """One reader: up to ``limit`` reports behind (time, id), in order; opens the blocks that hold them."""
        if limit <= 0:
            raise ValueError("limit must be positive")
        if not event_id:
            raise ValueError("a reader resumes after an event; its id is empty")
        index = self.index()
        block = F.floor(F.unix_seconds(event_ts.cast("timestamp")) / self.seconds)
        here = self._rows([r["path"] for r in index.filter(F.col("block") == block).collect()])
        inside = here.filter((F.col("event_ts") < event_ts) | ((F.col("event_ts") == event_ts) & (F.col("event_id") <= F.lit(event_id)))).count()
        start = inside + (index.filter(F.col("block") < block).agg(F.sum("rows")).first()[0] or 0)
        rows = self._opened(index, F.lit(start + 1), F.lit(start + limit)).filter(F.col("position").between(start + 1, start + limit))
        return rows.select(*columns(HISTORY), "position").withColumn("sequence", stored_sequence(F.col("sequence"))).orderBy("position").drop("position")

    def resume(self, clients: DataFrame, now: Column, window_seconds: int = DEFAULT_WINDOW_SECONDS, limit: int = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
        """As ``operators.resume.resume``: (verdict and frame count per client, frames in order). Nothing is numbered.

        Positions p + 1 … p + limit of all clients lie between the first client's and the last one's, so only
        those blocks are opened, and only the id column of the window to find where clients stopped.
        """
        if limit <= 0:
            raise ValueError("limit must be positive")
        index = self.index()
        total = index.agg(F.sum("rows")).first()[0] or 0
        if window_seconds > 0:
            oldest = F.floor((F.unix_seconds(now.cast("timestamp")) - window_seconds) / self.seconds)
            window = self._opened(index.filter(F.col("block") >= oldest))
        else:
            window = self._opened(index)
        points = resume_verdict(resume_points(clients, window), now, window_seconds)
        stopped = points.filter(F.col("verdict") == "resumed").select("last_event_id").distinct()
        starts = stopped.join(window.select(F.col("event_id").alias("last_event_id"), F.col("position").alias("start")), "last_event_id")
        ends = starts.select("last_event_id", "start", F.least(F.lit(limit), F.lit(total) - F.col("start")).cast("bigint").alias("frames"))
        verdicts = salted_join(points, ends.select("last_event_id", "frames"), "last_event_id", "left").select(
            "client_id", "verdict", F.when(F.col("verdict") == "resumed", F.col("frames")).otherwise(F.lit(0)).cast("bigint").alias("frames")
        )
        low, high = ends.agg(F.min("start"), F.max(F.col("start") + F.col("frames"))).first()
        rows = self._opened(index, F.lit((low or 0) + 1), F.lit(high or 0)).withColumn("sequence", stored_sequence(F.col("sequence")))
        wanted = ends.filter(F.col("frames") > 0).select(
            "last_event_id", "start", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("frames"))).alias("position")
        )
        frames = wanted.join(rows.drop("block", "place"), "position").withColumn("frame_no", F.col("position") - F.col("start"))
        resumed = points.filter(F.col("verdict") == "resumed").select("client_id", "last_event_id")
        return verdicts, salted_join(resumed, frames.drop("start", "position"), "last_event_id")
