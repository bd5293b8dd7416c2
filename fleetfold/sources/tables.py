"""Submissions, waypoints and stored tables as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold import schemas
from fleetfold.operators.ingest import batch_verdict, read_elements

GEOMETRY = "note ARRAY<STRING>, routes ARRAY<STRUCT<id: STRING, name: STRING, points: ARRAY<STRING>>>"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.HISTORY)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CURRENT)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.DEAD_LETTERS)


def read_submissions(submissions: DataFrame, **limits: int) -> DataFrame:
    """Batch documents -> one row per element of every acceptable batch."""
    return read_elements(batch_verdict(submissions, **limits))


def read_waypoints(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Geometry documents, one to a file or one to a line -> ``route_id, idx, lat, lon``."""
    return waypoints_of(spark.read.schema(GEOMETRY).option("multiLine", str(not lines).lower()).json(path))


def waypoints_of(geometry: DataFrame) -> DataFrame:
    """A point is ``[lat, lon]`` or ``{"lat": …, "lon": …}``; one that is neither has NULLs."""
    routes = geometry.select(F.explode("routes").alias("r")).select(F.col("r.id").alias("route_id"), F.posexplode("r.points").alias("idx", "point"))
    pair = F.from_json("point", "array<double>")
    obj = F.from_json("point", "lat DOUBLE, lon DOUBLE")
    is_pair = F.ltrim("point").startswith("[")
    exact = F.when(F.size(pair) == 2, pair)
    return routes.select(
        "route_id",
        "idx",
        F.when(is_pair, exact[0]).otherwise(F.coalesce(obj["lat"], F.lit(0.0))).alias("lat"),
        F.when(is_pair, exact[1]).otherwise(F.coalesce(obj["lon"], F.lit(0.0))).alias("lon"),
    )


def geometry_faults(waypoints: DataFrame) -> DataFrame:
    """Routes that cannot be travelled, with the reason; empty when the geometry is usable."""
    from fleetfold.operators.routes import route_lengths

    shape = waypoints.groupBy("route_id").agg(
        F.count("*").alias("points"),
        F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("unreadable"),
        F.max("idx").alias("last"),
    )
    lengths = route_lengths(waypoints).select("route_id", "length_m")
    fault = (
        F.when(F.coalesce("route_id", F.lit("")) == "", "no id")
        .when(F.col("unreadable") > 0, "a point is not a pair of numbers")
        .when(F.col("points") != F.col("last") + 1, "the id appears more than once")
        .when(F.col("points") < 2, "fewer than 2 points")
        .when(F.coalesce("length_m", F.lit(0.0)) <= 0, "zero length")
    )
    return shape.join(lengths, "route_id", "left").withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("route_id", "points", "fault")
