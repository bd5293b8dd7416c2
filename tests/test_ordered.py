import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetfold.operators.ordered import Running, evenly, log_block, numbered, offset_block, running, salted_join, time_block, top_per_key


def hot_rows(spark, n=600, seed=3):
    """One key holds most rows; ties in the value; positions sparse."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(3), i * 3 + rng.randrange(3), rng.choice([None, rng.randrange(50)])) for i in range(n)]
    return spark.createDataFrame(rows, "k STRING, partition INT, offset BIGINT, v BIGINT")


@pytest.mark.parametrize("rows_per_block", [7, 100, 1 << 22])
def test_blocks_change_nothing(spark, rows_per_block):
    df = hot_rows(spark)
    order = [F.col("partition"), F.col("offset")]
    steps = [Running("top", "max_before", F.col("v")), Running("total", "sum", F.col("v")), Running("before", "sum_before", F.lit(1)), Running("last", "last_before", F.col("v"))]
    got = running(df, ["k"], log_block(rows_per_block), order, *steps)
    w = Window.partitionBy("k").orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.max("v").over(past).alias("top"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("total"),
        F.coalesce(F.count("*").over(past), F.lit(0)).alias("before"), F.last("v", ignorenulls=True).over(past).alias("last"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_seed_starts_the_maximum(spark):
    df = hot_rows(spark).filter("v IS NOT NULL")
    seed = spark.createDataFrame([("hot", 25), ("k1", 49)], "k STRING, s BIGINT")
    got = running(df, ["k"], log_block(10), [F.col("partition"), F.col("offset")], Running("top", "max_before", F.col("v")), seed=(seed, "s", "top"))
    w = Window.partitionBy("k").orderBy("partition", "offset").rowsBetween(Window.unboundedPreceding, -1)
    want = df.join(seed, "k", "left").select(*df.columns, F.greatest(F.max("v").over(w), "s").alias("top"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_stuck_clock_falls_back_to_ranges(spark):
    """All rows of the hot key have one timestamp: no width of time block could split them."""
    df = hot_rows(spark).withColumn("event_ts", F.timestamp_seconds(F.lit(1000)))
    order = [F.col("event_ts"), F.col("offset")]
    rows, block = evenly(df, ["k"], time_block(), order, limit=40)
    assert "_range" in rows.columns and rows.select("_range").distinct().count() > 4
    got = running(rows, ["k"], block, order, Running("n", "sum", F.lit(1))).select("k", "offset", "n")
    want = df.select("k", "offset", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
    same, _ = evenly(df, ["k"], time_block(), order)
    assert "_range" not in same.columns


def test_numbered_and_top_per_key(spark):
    df = hot_rows(spark)
    got = numbered(df, ["partition"], offset_block("offset", 11), [F.col("offset")], "n").select("partition", "offset", "n")
    want = df.select("partition", "offset", F.row_number().over(Window.partitionBy("partition").orderBy("offset")).alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
    top = top_per_key(df, ["k"], [F.desc("offset")], 3)
    assert top.groupBy("k").count().filter("count > 3").count() == 0
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how, monkeypatch):
    left = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 40).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("8", 4)], "k STRING, v INT")
    real = F.lit
    # Lower the floor of what counts as heavy, so that the hot key is really split.
    monkeypatch.setattr("fleetfold.operators.ordered.F.lit", lambda v: real(50 if v == 100_000 else v))
    got = salted_join(left, right, "k", how, share=100)
    assert sorted(map(str, got.select("i", "k", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("i", "k", "v").collect()))
