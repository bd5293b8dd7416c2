"""The keyed, partitioned log: Kafka in production, a parquet twin with the same columns elsewhere.

Both give the columns of Spark's Kafka source, so every operator works on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.operators.ordered import BLOCK_ROWS, numbered, offset_block
from fleetfold.schemas import LOG, columns


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = False, max_offsets: int | None = None) -> DataFrame:
    """Everything still retained, from the earliest offset (a checkpoint overrides this in a stream).

    Needs the spark-sql-kafka package on the class path.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("includeHeaders", "true")
    if stream and max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(*columns(LOG))


def write_kafka(records: DataFrame, servers: str) -> None:
    """Keyed produce; the key fixes the partition, and the job fails unless all records are acked."""
    names = [c for c in ("key", "value", "topic", "headers") if c in records.columns]
    records.select(*names).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("includeHeaders", "true").save()


def read_log(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """The parquet log; as a stream, ``max_files`` bounds a micro-batch."""
    if not stream:
        return spark.read.schema(LOG).parquet(path)
    reader = spark.readStream.schema(LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def partition_of(key: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def assign_positions(
    records: DataFrame, partitions: int, arrival: str, ends: DataFrame | None = None, rows_per_block: int = BLOCK_ROWS
) -> DataFrame:
    """Partition by key (unless already given), then consecutive offsets in ``arrival`` order after what the log holds.

    Offsets are counted per topic and partition; records without a ``topic`` are of one topic. ``arrival`` is a unique whole number that follows produce order. Six partitions mean six groups,
    so offsets are counted in blocks of arrivals and not by one sort per partition. ``ends`` is
    ``reconcile.topic_offsets`` of the log written so far.
    """
    given = "partition" in records.columns
    placed = records if given else records.withColumn("partition", partition_of(F.col("key"), partitions))
    where = ["topic", "partition"] if "topic" in placed.columns else ["partition"]
    rows = numbered(placed, where, offset_block(arrival, rows_per_block), [F.col(arrival)], "_n")
    if ends is None:
        base = F.lit(0)
    else:
        rows = rows.join(ends.select(*where, F.col("end_offset").alias("_end")), where, "left")
        base = F.coalesce("_end", F.lit(0))
    return rows.withColumn("offset", (F.col("_n") - 1 + base).cast("bigint")).drop("_n", "_end")


def write_log(positioned: DataFrame, path: str) -> None:
    """Append records to the parquet log. The write commits as a whole or not at all."""
    positioned.select(*columns(LOG)).write.mode("append").parquet(path)
