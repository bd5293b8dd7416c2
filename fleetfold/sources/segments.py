"""A log of segments with an index of offsets.

Records lie in files by topic and partition, each holding one range of offsets or a little more. An append first
writes its files, then one small index table that lists them with their first and last offset and number of
records; what is in no index is not part of the log, so a half-written append is never read. From the index
alone come the end of every partition (no record is read), the files a reader at some position still
needs, and micro-batches of a given number of records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.schemas import LOG, columns

INDEX = "topic STRING, partition INT, first BIGINT, last BIGINT, records BIGINT, file STRING"
SEGMENT_RECORDS = 1_000_000
Positions = dict[tuple[str, int], int]


def append(positioned: DataFrame, path: str, segment_records: int = SEGMENT_RECORDS) -> None:
    """Add records that have positions. Files of a partition are ranges of ``segment_records`` offsets."""
    spark = positioned.sparkSession
    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    rows = positioned.select(*columns(LOG), F.floor(F.col("offset") / segment_records).alias("_segment"))
    rows = rows.repartition("topic", "partition", "_segment").sortWithinPartitions("topic", "partition", "_segment", "offset")
    rows.withColumn("_topic", F.col("topic")).withColumn("_partition", F.col("partition")).write.partitionBy("_topic", "_partition", "_segment").parquet(folder)
    written = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(folder)
    held = written.groupBy("topic", "partition", F.input_file_name().alias("file")).agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("records"))
    held.select("topic", "partition", "first", "last", "records", "file").coalesce(1).write.parquet(f"{path}/index/{name}")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the log."""
    return spark.read.schema(INDEX).option("recursiveFileLookup", "true").parquet(f"{path}/index")


def ends(spark: SparkSession, path: str) -> DataFrame:
    """``reconcile.topic_offsets`` of the log, from the index: no segment is opened."""
    return index(spark, path).groupBy("topic", "partition").agg((F.max("last") + 1).alias("end_offset"), F.sum("records").alias("records"))


def read(spark: SparkSession, path: str, starts: Positions | None = None, stops: Positions | None = None) -> DataFrame:
    """Records from ``starts`` on (partitions without one: from their beginning) and before ``stops``.

    Only files whose offsets reach into the ranges are opened. The ranges are a row per partition.
    """
    starts, stops = starts or {}, stops or {}
    given = [(*k, starts.get(k, 0), stops.get(k)) for k in {*starts, *stops}]
    ranges = F.broadcast(spark.createDataFrame(given, "topic STRING, partition INT, _from BIGINT, _to BIGINT"))
    low, high = F.coalesce("_from", F.lit(0)), F.coalesce("_to", F.lit((1 << 63) - 1))
    wanted = index(spark, path).join(ranges, ["topic", "partition"], "left").filter((F.col("last") >= low) & (F.col("first") < high))
    files = [r[0] for r in wanted.select("file").collect()]
    if not files:
        return spark.createDataFrame([], LOG)
    found = spark.read.schema(LOG).parquet(*files)
    if not given:
        return found
    inside = found.join(ranges, ["topic", "partition"], "left").filter((F.col("offset") >= low) & (F.col("offset") < high))
    return inside.select(*columns(LOG))


def next_stops(spark: SparkSession, path: str, positions: Positions, most: int, in_order: bool = False) -> Positions:
    """Where the next micro-batch of ``most`` records at the most ends in every partition; none when all is read.

    It is dealt evenly to the partitions that have any; others end where they stand. With ``in_order`` it is given to
    the first partitions (of a log of one topic) that have any, so batches are consecutive ranges of (partition, offset).

    Offsets are unique in a partition, so a range of k offsets holds k records or fewer.
    """
    if in_order:
        return _next_in_order(spark, path, positions, most)
    left = {(r["topic"], r["partition"]): r["end_offset"] for r in ends(spark, path).collect()}
    behind = sorted(k for k, end in left.items() if positions.get(k, 0) < end)
    if not behind:
        return {}
    share = max(1, most // len(behind))
    # Where there are fewer records than partitions, the first ones have their turn first.
    firsts = _next_offsets(spark, path, positions, behind)
    served = {k: min(left[k], firsts[k] + share) for k in behind[:most]}
    return {k: served.get(k, positions.get(k, 0)) for k in left}


def _next_in_order(spark: SparkSession, path: str, positions: Positions, most: int) -> Positions:
    """Whole files as long as their records fit, then as many offsets as records are left. A row per file comes to the driver."""
    files: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for row in index(spark, path).collect():
        files.setdefault((row["topic"], row["partition"]), []).append((row["first"], row["last"] + 1, row["records"]))
    stops, behind, left = {k: positions.get(k, 0) for k in files}, False, most
    for key in sorted(files, key=lambda k: (k[1], k[0])):
        at = stops[key]
        unread = sorted((end, max(first, at), records) for first, end, records in files[key] if end > at)
        behind = behind or bool(unread)
        if not unread or not left:
            continue
        # At the most so many records lie before ``stop``.
        bound = lambda stop: sum(min(records, min(stop, end) - low) for end, low, records in unread if low < stop)  # noqa: E731, B023
        stop = max((end for end, _, _ in unread if bound(end) <= left), default=at)
        rest = left - (bound(stop) if stop > at else 0)
        beyond = [max(low, stop) for end, low, _ in unread if end > stop]
        if beyond:
            stop = min(min(beyond) + rest, unread[-1][0]) if rest else stop
        stops[key], left = stop, rest if stop == unread[-1][0] else 0
    return stops if behind else {}


def _next_offsets(spark: SparkSession, path: str, positions: Positions, behind: list[tuple[str, int]]) -> Positions:
    """Next offset at which a file of each partition holds something: gaps between files are stepped over."""
    given = spark.createDataFrame([(*k, positions.get(k, 0)) for k in behind], "topic STRING, partition INT, _at BIGINT")
    rows = index(spark, path).join(F.broadcast(given), ["topic", "partition"]).filter(F.col("last") >= F.col("_at"))
    return {(r["topic"], r["partition"]): r["at"] for r in rows.groupBy("topic", "partition").agg(F.min(F.greatest("first", "_at")).alias("at")).collect()}
