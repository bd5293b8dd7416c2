"""Batches of submissions -> accepted rows and named rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions import fields, ids, rules
from fleetfold.operators.envelope import POSITION, POSITION_KINDS, document_verdict, marshal_envelope, position_columns

OBSERVATION_KINDS = {**POSITION_KINDS, "event_id": "string"}
_BATCH_KINDS = {"events": "any"}


def batch_verdict(
    submissions: DataFrame, max_batch: int = rules.MAX_BATCH, max_body_bytes: int = rules.MAX_BODY_BYTES
) -> DataFrame:
    """Add ``events`` (raw elements), ``outcome`` and ``batch_field`` to every batch document.

    A body is judged while it is read, so one that is too large is refused before its JSON is.
    """
    rows = fields.parse_document(submissions, F.col("body"), _BATCH_KINDS)
    listed = F.coalesce(fields.raw_text("events"), F.lit("null"))
    # Elements keep their JSON type, so that the text "{}" is not taken for an object.
    elements = F.from_json(F.concat(F.lit('{"events":'), listed, F.lit("}")), "events ARRAY<VARIANT>")["events"]
    malformed = F.col("_broken") | F.col("_unknown").isNotNull() | ~((listed == "null") | listed.startswith("["))
    count = F.coalesce(F.size(elements), F.lit(0))
    too_large = F.octet_length("body") > max_body_bytes
    bad_size = (count < 1) | (count > max_batch)
    outcome = F.when(too_large, "rejected").when(malformed, "malformed").when(bad_size, "rejected").otherwise("accepted")
    field = F.when(~too_large & ~malformed & bad_size, "events").otherwise("")
    raw = F.transform(elements, lambda e: F.to_json(e))
    judged = fields.once(
        rows, outcome.alias("outcome"), field.alias("batch_field"), count.alias("event_count"), raw.alias("_raw")
    )
    return judged.select(*submissions.columns, "outcome", "batch_field", "event_count", F.col("_raw").alias("events"))


def read_elements(batches: DataFrame) -> DataFrame:
    """One row per element of every accepted batch, its index kept."""
    return (
        batches.filter(F.col("outcome") == "accepted")
        .select("batch_id", F.posexplode("events").alias("index", "raw"))
    )


def judge_observations(elements: DataFrame, now: Column) -> DataFrame:
    """Typed columns, the (given or minted) ``event_id`` and the ``verdict`` of every element."""
    parsed = fields.parse_document(elements, F.col("raw"), OBSERVATION_KINDS)
    p = position_columns()
    given = F.coalesce("event_id", F.lit(""))
    bad_id = rules.first_failure(((given != "") & ids.canonical_uuid(given).isNull(), "event_id", "is not a UUID"))
    verdict = F.coalesce(
        document_verdict("observation"),
        rules.position_verdict(*[p[n] for n in POSITION if n != "sequence"]),
        rules.clock_verdict(p["event_ts"], now),
        bad_id,
    )
    minted = ids.submission_id(F.col("batch_id"), F.col("index"))
    judged = parsed.select(
        "batch_id",
        "index",
        "raw",
        *[c.alias(n) for n, c in p.items()],
        F.when(given == "", minted).otherwise(given).alias("event_id"),
        verdict.alias("_verdict"),
    )
    return fields.once(judged, F.col("_verdict").alias("verdict")).drop("_verdict")


def accept_submissions(elements: DataFrame, now: Column, source: str) -> DataFrame:
    """Judge every element and render the accepted ones as wire bytes (``value``)."""
    rows = judge_observations(elements, now)
    value = marshal_envelope(rows, now, F.lit(source))
    return rows.withColumn("value", F.when(F.col("verdict").isNull(), value))


def split_batch(submissions: DataFrame, now: Column, source: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(accepted records keyed by vehicle, rejections by batch and index).

    One bad element never fails its batch. Both results are filters of one plan; persist the judged
    rows when both are written.
    """
    judged = accept_submissions(read_elements(batch_verdict(submissions, **limits)), now, source)
    accepted = judged.filter(F.col("verdict").isNull()).select(
        "batch_id", "index", "event_id", F.encode("vehicle_id", "UTF-8").alias("key"), "value"
    )
    rejected = judged.filter(F.col("verdict").isNotNull()).select(
        "batch_id",
        "index",
        rules.error_field(F.col("verdict")).alias("field"),
        rules.error_text(F.col("verdict")).alias("reason"),
    )
    return accepted, rejected


def batch_counts(judged: DataFrame) -> DataFrame:
    """Accepted and rejected elements per batch."""
    return judged.groupBy("batch_id").agg(
        F.count_if(F.col("verdict").isNull()).alias("accepted"),
        F.count_if(F.col("verdict").isNotNull()).alias("rejected"),
    )


def request_outcomes(batches: DataFrame) -> DataFrame:
    """Batches by outcome."""
    return batches.groupBy("outcome").agg(F.count("*").alias("batches"))
