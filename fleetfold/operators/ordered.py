"""Ordered running values per key that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. When one key holds
a third of the log, that task never ends. Here every key is cut into *blocks* along the order (a
range of offsets, an hour of event time). The window runs inside a block; what earlier blocks
contribute is one pre-aggregated row per block, carried forward by a second, much smaller window.
With N rows and blocks of B rows no task ever orders more than max(B, N / B) rows of a key, and the
result is exactly that of the plain window.

The rows are shuffled once, by key and block: the window and the join with the carried values want
the same partitioning. The input is read twice, so it must be deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.session import work_dir

# Offsets per block. Four million narrow rows sort comfortably in one task.
BLOCK_ROWS = 1 << 22
# Event-time width of a block.
BLOCK_SECONDS = 3600


@dataclass(frozen=True)
class Running:
    """One running column: ``how`` over ``value`` of the rows before (or up to) each row.

    ``max_before``, ``last_before`` and ``sum_before`` exclude the row itself, ``sum`` includes it.
    """

    out: str
    how: str
    value: Column

    def block_value(self, order: Sequence[Column]) -> Column:
        if self.how == "max_before":
            return F.max(self.value)
        if self.how in ("sum", "sum_before"):
            return F.sum(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))

    def within(self, window) -> Column:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        if self.how == "max_before":
            return F.max(self.value).over(before)
        if self.how == "sum_before":
            return F.sum(self.value).over(before)
        if self.how == "sum":
            return F.sum(self.value).over(window.rowsBetween(Window.unboundedPreceding, 0))
        return F.last(self.value, ignorenulls=True).over(before)

    def carried(self, column: str, window) -> Column:
        if self.how == "max_before":
            return F.max(column).over(window)
        if self.how in ("sum", "sum_before"):
            return F.sum(column).over(window)
        return F.last(column, ignorenulls=True).over(window)

    def merged(self, local: str, carry: str) -> Column:
        if self.how == "max_before":
            return F.greatest(local, carry)
        if self.how in ("sum", "sum_before"):
            return F.coalesce(F.col(carry), F.lit(0)) + F.coalesce(F.col(local), F.lit(0))
        return F.coalesce(local, carry)


def running(
    rows: DataFrame,
    keys: Sequence[str],
    block: Sequence[Column],
    order: Sequence[Column],
    *steps: Running,
    seed: tuple[DataFrame, str, str] | None = None,
) -> DataFrame:
    """Add one column per step. ``block`` must follow ``order`` (an earlier row has no later block).

    ``seed`` = (table, column, step) starts a ``max_before`` step from a value stored per key; it is
    joined to the block summaries, not to the rows, so a hot key costs one lookup per block.
    """
    names = [f"_block{i}" for i in range(len(block))]
    rows = rows.withColumns(dict(zip(names, block, strict=True)))
    group = [*keys, *names]

    summary = rows.groupBy(*group).agg(*[s.block_value(order).alias(f"_sum_{s.out}") for s in steps])
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*group, *[s.carried(f"_sum_{s.out}", earlier).alias(f"_carry_{s.out}") for s in steps])
    if seed is not None:
        table, column, step = seed
        carry = (
            carry.join(table.select(*keys, F.col(column).alias("_seed")), list(keys), "left")
            .withColumn(f"_carry_{step}", F.greatest(f"_carry_{step}", "_seed"))
            .drop("_seed")
        )

    window = Window.partitionBy(*group).orderBy(*order)
    kept = [c for c in rows.columns if c not in names]
    local = rows.select("*", *[s.within(window).alias(f"_local_{s.out}") for s in steps])
    return local.join(carry, group, "left").select(
        *kept, *[s.merged(f"_local_{s.out}", f"_carry_{s.out}").alias(s.out) for s in steps]
    )


def evenly(
    rows: DataFrame, keys: Sequence[str], block: Sequence[Column], order: Sequence[Column], limit: int = BLOCK_ROWS
) -> tuple[DataFrame, list[Column]]:
    """Blocks of at most about ``limit`` rows: the given ones when they are that small, else ranges.

    Blocks of time or of a counter are only as even as the data: a device with a stuck clock puts
    everything into one. The heaviest block is measured (a combining count, one number to the
    driver); when it is too heavy, rows are range-partitioned by key and order, which ties cannot
    defeat because the order ends in a unique column, and written with the number of their range,
    so that every later read sees the same blocks.
    """
    sizes = rows.groupBy(*keys, *[b.alias(f"_b{i}") for i, b in enumerate(block)]).agg(F.count("*").alias("n"))
    heaviest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (heaviest or 0) <= limit:
        return rows, list(block)
    spark = rows.sparkSession
    path = work_dir(spark, "ranges")
    ranges = 2 * -(-total // limit)
    by = [*map(F.col, keys), *order]
    rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema(rows.withColumn("_range", F.lit(0)).schema).parquet(path)
    return stored, [F.col("_range")]


def log_block(rows_per_block: int = BLOCK_ROWS) -> list[Column]:
    """Blocks of the order (partition, offset)."""
    return [F.col("partition"), F.floor(F.col("offset") / rows_per_block)]


def offset_block(column: str = "offset", rows_per_block: int = BLOCK_ROWS) -> list[Column]:
    """Blocks of a whole-number order that is dense or nearly so."""
    return [F.floor(F.col(column) / rows_per_block)]


def time_block(column: str = "event_ts", seconds: int = BLOCK_SECONDS) -> list[Column]:
    """Blocks of an event-time order."""
    return [F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / seconds)]


def numbered(
    rows: DataFrame, keys: Sequence[str], block: Sequence[Column], order: Sequence[Column], out: str
) -> DataFrame:
    """1-based position of each row within its key."""
    return running(rows, keys, block, order, Running(out, "sum", F.lit(1).cast("bigint")))


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows of every key.

    The filter on the rank lets Spark keep only ``limit`` rows per key and map task before the
    shuffle (WindowGroupLimit), so a hot key sends tasks x limit rows and not all of its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= limit)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 10_000) -> DataFrame:
    """Join a side with hot keys to a side whose rows per key are few.

    Keys holding more than 1/``share`` of the left side are split over several salts, and only their
    right rows are repeated. There are at most ``share`` such keys, so their table is small whatever
    the data, and is the one thing that is broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    heavy = F.greatest(F.lit(100_000), counts.select(F.sum("_n") / share).scalar())
    hot = counts.filter(F.col("_n") > heavy).select(key, F.ceil(F.col("_n") / heavy).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    spread = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")
