"""Run reports: exact percentiles, histograms, rates and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.text import rate_tenth
from fleetfold.operators.ordered import Running, running

# Upper bounds of the published histograms.
BATCH_SIZE_BOUNDS = [1, 10, 50, 100, 250, 500]
POLL_SIZE_BOUNDS = [1, 5, 10, 50, 100, 200, 500]
REPLAY_SIZE_BOUNDS = [0, 1, 10, 50, 100, 500, 1000]
PRODUCE_SECONDS_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5]
TX_SECONDS_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5]
PUBLISH_SECONDS_BOUNDS = [0.0001, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.05]


def histogram(rows: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound (NULL = no bound), with the sum and count of all values.

    One aggregate with a counter per bound, unpivoted afterwards: the rows are never multiplied.
    """
    counters = [F.count_if(value <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    one = rows.agg(*counters, F.count(value).alias("total"), F.sum(value).alias("value_sum"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("cumulative")))
    return one.select(F.explode(F.array(*pairs)).alias("b"), "value_sum", "total").select("b.*", "value_sum", "total")


def _magnitude_block(value: Column, steps: int) -> Column:
    """An order-preserving block of a number: ``steps`` per doubling of its size."""
    # 1100 doublings are more than a double has below 1, so positive numbers stay above 0.
    size = F.floor((F.log2(F.abs(value)) + 1100) * steps).cast("bigint")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def nearest_rank(rows: DataFrame, value: Column, percents: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles, one column per name; rank = round-half-even(p·n/100) in [1, n].

    A sort-everything percentile needs all values in one place. Here equal values are counted first;
    counts are summed per block of magnitude (at most some thousands of blocks), which tells in which
    block each rank lies; only those blocks are then looked at value by value.
    """
    freq = rows.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    freq = freq.withColumn("block", _magnitude_block(F.col("v").cast("double"), 1024))
    blocks = freq.groupBy("block").agg(F.sum("n").alias("n"))
    # The only global windows: over the blocks, whose number is bounded by the magnitudes in use.
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = blocks.select(
        "block", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.col("n").alias("inside"), F.sum("n").over(everything).alias("total")
    )
    targets = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p / 100.0).alias("p")) for k, p in percents.items()])
    rank = F.greatest(F.lit(1), F.least(F.col("total"), F.bround(F.col("t.p") * F.col("total"), 0).cast("bigint")))
    hit = (
        placed.withColumn("t", F.explode(targets))
        .withColumn("k", rank)
        .filter((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("inside")))
        .select("block", F.col("t.name").alias("name"), "before", "k")
    )
    # At most one row per requested percentile.
    inside = freq.join(F.broadcast(hit), "block")
    finer = [_magnitude_block(F.col("v").cast("double"), 1 << 22)]
    summed = running(inside, ["name"], finer, [F.col("v")], Running("_upto", "sum", F.col("n")))
    found = summed.filter(F.col("before") + F.col("_upto") >= F.col("k"))
    return found.agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in percents])


def _beside(one_row: DataFrame, other: DataFrame, digits: int | None = None) -> DataFrame:
    """Columns of a one-row table next to those of another, as a scalar subquery."""
    packed = other.select(F.struct(*other.columns)).scalar()
    value = lambda c: F.col("_p")[c] if digits is None else F.round(F.col("_p")[c], digits)
    return one_row.withColumn("_p", packed).select(*one_row.columns, *[value(c).alias(c) for c in other.columns])


def latency_report(deliveries: DataFrame) -> DataFrame:
    """Delivered, undelivered, nearest-rank p50/p95/p99, max and mean of ``latency_ms``."""
    latency = F.col("latency_ms")
    counts = deliveries.agg(
        F.count(latency).alias("delivered"),
        F.count_if(latency.isNull()).alias("undelivered"),
        F.round(F.max(latency), 2).alias("max_ms"),
        F.round(F.avg(latency), 2).alias("mean_ms"),
    )
    ranks = nearest_rank(deliveries, latency, {"p50_ms": 50, "p95_ms": 95, "p99_ms": 99})
    return _beside(counts, ranks, 2)


def frames_per_client(deliveries: DataFrame) -> DataFrame:
    """How evenly frames reached clients, and how soon: ``client_id``, ``waited_s`` (NULL = no frame)."""
    per_client = deliveries.groupBy("client_id").agg(
        F.count("waited_s").alias("frames"), F.min("waited_s").alias("first_s")
    )
    counts = per_client.agg(
        F.count("*").alias("clients"),
        F.count_if(F.col("frames") > 0).alias("clients_receiving"),
        F.sum("frames").alias("total_frames"),
        F.min("frames").alias("min_frames"),
        F.max("frames").alias("max_frames"),
        F.round(F.max("first_s"), 3).alias("first_max_s"),
    )
    frames = nearest_rank(per_client, F.col("frames"), {"p50_frames": 50})
    firsts = nearest_rank(per_client, F.col("first_s"), {"first_p50_s": 50, "first_p95_s": 95})
    return _beside(_beside(counts, frames), firsts, 3)


def throughput_report(batches: DataFrame) -> DataFrame:
    """``accepted``, ``rejected``, ``sent_at`` per batch -> totals and rates of the whole run."""
    seconds = (F.unix_micros(F.max("sent_at").cast("timestamp")) - F.unix_micros(F.min("sent_at").cast("timestamp"))) / 1e6
    totals = batches.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.count("*").alias("batches"),
        seconds.alias("_seconds"),
    )
    return totals.select(
        "accepted",
        "rejected",
        "batches",
        rate_tenth(F.col("_seconds")).alias("duration_s"),
        rate_tenth(F.try_divide(F.col("accepted"), F.col("_seconds"))).alias("achieved_rate"),
        rate_tenth(F.col("accepted") / F.greatest(F.col("batches"), F.lit(1))).alias("accepted_per_batch"),
    )


def interval_rate(rows: DataFrame, ts: Column, seconds: int = 5) -> DataFrame:
    """Events and events per second in every interval that has any."""
    window = F.window(ts, f"{seconds} seconds")
    return rows.groupBy(window.alias("w")).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("interval_start"), "events", rate_tenth(F.col("events") / seconds).alias("per_second")
    )
