"""Which ids were handled before, without reading them all.

Handled ids lie in hash buckets, a folder for every bucket of every entry (a commit, or several merged ones). Each
entry also has Bloom filters, one for every ``SLICE`` ids or so, of ``BITS`` bits to an id. A batch meets
the filters of its own slices; only ids that a filter may hold (all known ones, and about one in a million
others) are looked up, and only in the buckets they fall into. The plan is the same at every size; what grows with
the ledger is the filters, four bytes to an id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.schemas import PROCESSED

SLICE, BITS, HASHES = 50_000, 32, 20
LEAST = 1 << 13  # bits of a filter
BATCH_SLICE = 500_000  # ids of a batch that meet one filter in one task
FILTERS = "slice INT, bits BINARY"


@dataclass(frozen=True)
class Entry:
    """Ids of some commits: ``path``/ids/bucket=K holds them, ``path``/filters their filters."""

    path: str
    rows: int
    buckets: int

    @property
    def parts(self) -> int:
        """Filters to a bucket."""
        return max(1, -(-self.rows // (self.buckets * SLICE)))


def _first(event_id: str = "event_id") -> Column:
    return F.xxhash64(event_id)


def _second(event_id: str = "event_id") -> Column:
    return F.xxhash64(event_id, F.lit("second"))


def bucket_of(buckets: int | Column) -> Column:
    return F.pmod(_first(), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def _slice(buckets: Column, parts: Column) -> Column:
    return (F.pmod(F.col("_h"), buckets) * parts + F.pmod(F.shiftright(F.col("_g"), 8), parts)).cast("int")


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bits of each id, from two hashes; the cubic term keeps ids of equal step apart (enhanced double hashing)."""
    first, second = first.view(np.uint64)[:, None], (second.view(np.uint64) | np.uint64(1))[:, None]
    i = np.arange(1, HASHES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (first + i * second + (i * i * i - i) // np.uint64(6)) % np.uint64(size)


def _filter(key: tuple, rows: pa.Table) -> pa.Table:
    size = max(LEAST, rows.num_rows * BITS)
    bits = np.zeros(size, dtype=bool)
    bits[_places(*(rows[c].to_numpy() for c in ("_h", "_g")), size).ravel()] = True
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([size.to_bytes(8, "little") + np.packbits(bits).tobytes()], pa.binary())})


def write_ids(ids: DataFrame, path: str, rows: int, buckets: int) -> Entry:
    """Store distinct ids (``PROCESSED`` columns) and their filters."""
    entry = Entry(path, rows, buckets)
    placed = ids.withColumn("bucket", bucket_of(buckets))
    placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/ids")
    hashed = ids.select(_first().alias("_h"), _second().alias("_g"))
    sliced = hashed.withColumn("slice", _slice(F.lit(buckets), F.lit(entry.parts)))
    sliced.groupBy("slice").applyInArrow(_filter, FILTERS).write.parquet(f"{path}/filters")
    return entry


def read_ids(spark: SparkSession, entries: list[Entry], hits: dict[str, list[int]] | None = None) -> DataFrame:
    """Ids of all entries, or of the given buckets of each only."""
    if hits is None:
        paths = [f"{e.path}/ids" for e in entries if e.rows]
    else:
        paths = [f"{path}/ids/bucket={k}" for path, buckets in hits.items() for k in buckets]
    return spark.read.schema(PROCESSED).option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], PROCESSED)


def _maybe(left: pa.Table, right: pa.Table) -> pa.Table:
    """Ids of a slice that its filter may hold; a slice without a filter holds none."""
    names = ["event_id", "_entry", "_bucket"]
    if not left.num_rows or not right.num_rows:
        return left.select(names).slice(0, 0)
    raw = right["bits"][0].as_py()
    size = int.from_bytes(raw[:8], "little")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=size).astype(bool)
    held = bits[_places(*(left[c].to_numpy() for c in ("_h", "_g")), size)].all(axis=1)
    return left.select(names).filter(pa.array(held))


def maybe_known(ids: DataFrame, entries: list[Entry], batch: int) -> DataFrame:
    """(event_id, _entry, _bucket): ids that some entry may hold, and where. ``batch``: number of ids."""
    spark = ids.sparkSession
    known = [e for e in entries if e.rows]
    rows = [(i, e.buckets, e.parts, max(1, batch // (e.buckets * e.parts * BATCH_SLICE))) for i, e in enumerate(known)]
    shapes = F.array(*[F.struct(F.lit(i).alias("_entry"), F.lit(b).alias("_buckets"), F.lit(p).alias("_parts"), F.lit(s).alias("_spread")) for i, b, p, s in rows])
    each = ids.select("event_id", _first().alias("_h"), _second().alias("_g"), F.inline(shapes))
    each = each.select(
        "event_id", "_h", "_g", "_entry", F.pmod("_h", "_buckets").cast("int").alias("_bucket"), _slice(F.col("_buckets"), F.col("_parts")).alias("slice"),
        F.pmod(F.shiftright("_h", 20), F.col("_spread")).cast("int").alias("_part"),
    )
    filters = None
    for i, entry in enumerate(known):
        own = spark.read.schema(FILTERS).parquet(f"{entry.path}/filters").select(F.lit(i).alias("_entry"), "slice", F.explode(F.sequence(F.lit(0), F.lit(rows[i][3] - 1))).alias("_part"), "bits")
        filters = own if filters is None else filters.unionByName(own)
    keys = ["_entry", "slice", "_part"]
    return each.groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInArrow(_maybe, "event_id STRING, _entry INT, _bucket INT")


def hit_buckets(ids: DataFrame, entries: list[Entry], batch: int) -> dict[str, list[int]]:
    """Buckets of each entry that may hold one of the ids: a row per entry and bucket at the most comes to the driver."""
    with_ids = [e for e in entries if e.rows]
    if not with_ids or not batch:
        return {}
    hits: dict[str, list[int]] = {}
    for row in maybe_known(ids, with_ids, batch).select("_entry", "_bucket").distinct().orderBy("_entry", "_bucket").collect():
        hits.setdefault(with_ids[row["_entry"]].path, []).append(row["_bucket"])
    return hits


def known(ids: DataFrame, entries: list[Entry], batch: int) -> DataFrame:
    """Handled ids (event_id) of every bucket that a filter sends the batch to: all of the batch's that were handled, and others."""
    return read_ids(ids.sparkSession, entries, hit_buckets(ids, entries, batch)).select("event_id")
