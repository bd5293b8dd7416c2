"""The telemetry log that the given ``events`` table stands for, faults included.

``events`` is clean, so faults are derived from its ids: undecodable bytes, an unsupported version,
an unknown type, an impossible latitude, late reports and redeliveries. The SQL below and
``rows`` say the same thing; the SQL feeds the checks, the DataFrame feeds the operators.
Offsets are arrival numbers: unique and increasing in a partition, which is all that order needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.functions.ids import dashed
from fleetfold.operators.envelope import judge, marshal_envelope
from fleetfold.operators import classify, state
from fleetfold.session import work_dir
from fleetfold.sources.tables import read_history

TOPIC = "telemetry.raw"
PARTITIONS = 6
# Events to a task: the longest task is one of these however large the log is.
SPREAD_ROWS = 50_000

BASE_SQL = """
base AS (
  SELECT event_id AS src_id, user_id, md5(CAST(event_id AS VARCHAR)) AS h, ts,
    concat('veh-', lpad(CAST(user_id AS VARCHAR), 4, '0')) AS vehicle_id, event_type AS route_id,
    CASE WHEN event_id % 83 = 11 THEN CAST(91.5 AS DOUBLE)
         ELSE CAST(12.8 AS DOUBLE) + CAST(event_id % 400 AS DOUBLE) / 1000 END AS lat,
    CAST(77.5 AS DOUBLE) + CAST(user_id % 300 AS DOUBLE) / 1000 AS lon,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS speed_kph,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3600 AS DOUBLE) / 10 END AS bearing_deg,
    CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 48 HOURS ELSE ts END AS event_ts,
    CASE WHEN event_id % 97 = 5 THEN 'corrupt' WHEN event_id % 101 = 13 THEN 'bad_version'
         WHEN event_id % 89 = 7 THEN 'unknown_type' WHEN event_id % 83 = 11 THEN 'bad_lat' ELSE 'ok' END AS kind
  FROM events),
copies AS (
  SELECT base.*, 2 * src_id AS off FROM base
  UNION ALL
  SELECT base.*, 2 * src_id + 101 AS off FROM base WHERE src_id % 10 = 3),
log AS (
  SELECT concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) AS event_id,
    src_id, vehicle_id, route_id, lat, lon, speed_kph, bearing_deg, ts, event_ts, kind,
    CAST(user_id % 6 AS INTEGER) AS part, off, ts + to_seconds(off % 60) AS logged_at
  FROM copies)"""

CLASSIFIED_SQL = BASE_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, off) AS copy FROM log WHERE kind = 'ok'),
firsts AS (
  SELECT *, max(event_ts) OVER (PARTITION BY vehicle_id ORDER BY part, off
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM ranked WHERE copy = 1),
classified AS (
  SELECT l.*, CASE WHEN l.kind <> 'ok' THEN 'dead' WHEN f.off IS NULL THEN 'duplicate'
                   WHEN f.event_ts <= f.newest THEN 'late' ELSE 'applied' END AS outcome
  FROM log l LEFT JOIN firsts f ON l.part = f.part AND l.off = f.off),
history AS (
  SELECT event_id, vehicle_id, route_id, lat, lon, CAST(speed_kph AS REAL) AS speed_kph,
    CAST(bearing_deg AS REAL) AS bearing_deg, event_ts, ts AS produced_at, logged_at AS ingested_at, part, off, src_id AS sequence
  FROM classified WHERE outcome IN ('applied', 'late')),
current_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, ingested_at, part, off) AS rn FROM history)
  WHERE rn = 1)"""

# Identifier of a refused record, in SQL: its own, or one derived from its position.
NAME_BASED_SQL = """,
hashed AS (
  SELECT *, sha1(unhex('0f397628915d4017804cd7d748afb01a') || encode(concat('telemetry.raw/', part, '/', off))) AS d FROM classified),
dead AS (
  SELECT CASE WHEN kind IN ('corrupt', 'bad_version') THEN
      concat(substr(d,1,8),'-',substr(d,9,4),'-5',substr(d,14,3),'-',
             translate(substr(d,17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr(d,18,3),'-',substr(d,21,12))
    ELSE event_id END AS event_id, kind, part, off, logged_at, vehicle_id,
    CASE WHEN kind = 'unknown_type' THEN 'unknown_version' ELSE 'decode' END AS reason,
    CASE kind WHEN 'corrupt' THEN 'not a valid envelope' WHEN 'bad_version' THEN 'schema_version: 2 is not supported'
         WHEN 'unknown_type' THEN 'event_type: vehicle.door is not implemented' ELSE 'lat: 91.5 is outside [-90, 90]' END AS error
  FROM hashed WHERE outcome = 'dead')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Event times are instants; the given column has no zone and means UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spread(table(spark, sf_dir, "events"))


def spread(frame: DataFrame) -> DataFrame:
    """Give every core work, and no task more than about ``SPREAD_ROWS`` rows, however few splits the input has.

    Rendering and parsing JSON is the expensive part of every plan here, and a split of narrow columns holds
    millions of rows. Rows are counted from the files' footers.
    """
    wanted = max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // SPREAD_ROWS))
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Rows written to the shared work folder and read again, for operators that read them more than once."""
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def naive(frame: DataFrame) -> DataFrame:
    """Instants as zone-free UTC, the form the given tables and the checks use."""
    kinds = dict(frame.dtypes)
    return frame.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in frame.columns])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log record, as columns."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    kind = (
        F.when(i % 97 == 5, "corrupt")
        .when(i % 101 == 13, "bad_version")
        .when(i % 89 == 7, "unknown_type")
        .when(i % 83 == 11, "bad_lat")
        .otherwise("ok")
    )
    base = e.select(
        i.alias("src_id"),
        dashed(F.md5(i.cast("string").cast("binary"))).alias("event_id"),
        F.concat(F.lit("veh-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("vehicle_id"),
        F.col("event_type").alias("route_id"),
        F.when(i % 83 == 11, 91.5).otherwise(F.lit(12.8) + (i % 400).cast("double") / 1000).alias("lat"),
        (F.lit(77.5) + (F.col("user_id") % 300).cast("double") / 1000).alias("lon"),
        F.when(i % 7 != 0, F.col("value")).alias("speed_kph"),
        F.when(i % 5 != 0, (i % 3600).cast("double") / 10).alias("bearing_deg"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(i % 11 == 0, F.col("ts") - F.expr("INTERVAL 48 HOURS")).otherwise(F.col("ts")).cast("timestamp").alias("event_ts"),
        kind.alias("kind"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
    )
    # One scan, not a union of two: a redelivered row is exploded into its copies.
    offsets = F.when(F.col("src_id") % 10 == 3, F.array(2 * F.col("src_id"), 2 * F.col("src_id") + 101)).otherwise(
        F.array(2 * F.col("src_id"))
    )
    return base.withColumn("offset", F.explode(offsets)).withColumns(
        {
            "logged_at": F.timestamp_add("SECOND", F.col("offset") % 60, F.col("ts")),
            "sequence": F.col("src_id"),
        }
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as a log: keyed bytes with positions."""
    r = rows(spark, sf_dir)
    body = marshal_envelope(r, F.col("ts"), F.lit("fleet")).cast("string")
    value = (
        F.when(F.col("kind") == "corrupt", F.lit("{this is not valid json"))
        .when(F.col("kind") == "bad_version", F.replace(body, F.lit('"schema_version":1'), F.lit('"schema_version":2')))
        .when(F.col("kind") == "unknown_type", F.replace(body, F.lit("vehicle.position"), F.lit("vehicle.door")))
        .otherwise(body)
    )
    return r.select(
        F.encode("vehicle_id", "UTF-8").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(TOPIC).alias("topic"),
        "partition",
        "offset",
        F.col("logged_at").alias("timestamp"),
        F.array().cast("array<struct<key: string, value: binary>>").alias("headers"),
    )


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the table it is in production: judging reads it twice and selects by its bytes, which would be rendered anew each time."""
    return stored(raw_log(spark, sf_dir), "log")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log judged and stored, since classification reads it three times; bytes are kept of refused records only."""
    rows_ = judge(stored_log(spark, sf_dir))
    refused = F.col("reason").isNotNull()
    return stored(rows_.withColumns({"key": F.when(refused, F.col("key")), "value": F.when(refused, F.col("value"))}), "judged")


def handled(done: DataFrame) -> DataFrame:
    """Classified records as ledger rows, handled when they were logged."""
    return done.withColumns({"processed_at": F.col("timestamp"), "consumer_id": F.lit("batch")})


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log judged and classified as one batch, handled when it was logged: the ledger rows."""
    return handled(classify.classify(judged(spark, sf_dir)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(classified(spark, sf_dir))


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as the table it is in production, for operators that read it more than once."""
    path = work_dir(spark, "history")
    history(spark, sf_dir).write.parquet(path)
    return read_history(spark, path)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(history(spark, sf_dir))
