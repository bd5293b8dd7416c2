"""Sharded files of any format: deterministic shards, temporary names, a manifest that commits.

Tasks write through pyarrow's file systems to the shared work folder (file, hdfs, s3, gs, …), under
names that no other attempt uses. Each file written gives one manifest row; Spark's own commit of the
staged manifest decides which attempts count, so a task that is lost and run again leaves stray files
but no stray rows. Files are then moved to their final names, which depend on the data alone, and the
final manifest is written last. Readers open only what it lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file STRING, temporary STRING, shard INT, number INT, records BIGINT, units BIGINT, bytes BIGINT, sha256 STRING"
FIELDS = [c.split()[0] for c in MANIFEST.split(", ")]
# Sampled keys for each shard border: about this many times the shards come to the driver.
SAMPLED = 32
# Shards grow with the table once there are this many, so borders and sampled keys stay a few megabytes.
MOST_SHARDS = 20_000


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def shard_count(rows: int, shard_rows: int) -> int:
    return max(1, min(-(-rows // shard_rows), MOST_SHARDS))


def borders(rows: DataFrame, key: str, shards: int) -> list[int]:
    """Keys at which shards begin, the same on every run: a sample by hash, not by chance."""
    if shards <= 1:
        return []
    every = max(1, rows.count() // (shards * SAMPLED))
    chosen = rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0)).select(F.col(key).cast("long"))
    keys = np.sort(np.array([r[0] for r in chosen.distinct().collect()], dtype=np.int64))
    if not len(keys):
        return []
    picks = (np.arange(1, shards) * len(keys)) // shards
    return sorted({int(keys[i]) for i in picks})


def shard_of(key: Column, edges: list[int]) -> Column:
    """Number of the shard of a key; equal keys share one, null is in the first."""
    if not edges:
        return F.lit(0)
    known = np.array(edges, dtype=np.int64)

    @F.pandas_udf("int")
    def number(keys):
        values = keys.to_numpy(dtype="float64", na_value=np.nan) if keys.hasnans else keys.to_numpy(dtype=np.int64)
        found = np.searchsorted(known, values, side="right").astype(np.int32)
        if keys.hasnans:
            found[keys.isna().to_numpy()] = 0
        return pd.Series(found)

    return number(key.cast("long"))


def write_sharded(rows: DataFrame, folder: str, shards: int, order: list[str], encode: Callable[..., Iterator[tuple]], suffix: str) -> DataFrame:
    """Write rows, which have a column ``shard``, in their order; returns the final manifest.

    ``encode(batches)`` yields (shard, number in shard, bytes, records, units, last): pieces of files
    in order, ``last`` with the last piece of a file. It must not look across shards.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", *order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, root = filesystem(folder)
        store.create_dir(f"{root}/temporary", recursive=True)
        out = name = None
        for shard, number, piece, records, units, last in encode(batches):
            if out is None:
                name, digest, length, n, m = f"temporary/{uuid.uuid4().hex}{suffix}", hashlib.sha256(), 0, 0, 0
                out = store.open_output_stream(f"{root}/{name}")
            out.write(piece)
            digest.update(piece)
            length, n, m = length + len(piece), n + records, m + units
            if last:
                out.close()
                final = f"data/part-{shard:06d}-{number:05d}{suffix}"
                yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, (final, name, shard, number, n, m, length, digest.hexdigest())))], schema=_ARROW)
                out = None

    staged = f"{folder}/staged"
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(staged)
    return _publish(spark, folder, spark.read.schema(MANIFEST).parquet(staged))


_ARROW = pa.schema(
    [("file", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()),
     ("units", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)


def _publish(spark: SparkSession, folder: str, staged: DataFrame) -> DataFrame:
    """Move files to their final names, then write the manifest. Moving twice does no harm."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(f"{root}/data", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['temporary']}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{row['temporary']}", f"{root}/{row['file']}")
            yield batch

    staged.mapInArrow(move, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_files(manifest: DataFrame, folder: str, decode: Callable[..., Iterator[pa.RecordBatch]], schema: str, **columns: Column) -> DataFrame:
    """Rows of the files that a manifest lists. ``decode(stream, row)`` reads one file as a stream."""
    files = manifest.select("*", *[c.alias(n) for n, c in columns.items()])
    # One file to a task as far as there are tasks: a file is read from its beginning to its end.
    dealt = files.repartitionByRange(max(1, min(files.count(), 10_000)), "shard", "number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}") as stream:
                    yield from decode(stream, row)

    return dealt.mapInArrow(read, schema)


