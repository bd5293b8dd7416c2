"""Log record -> typed row with a verdict, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions import fields, ids, rules
from fleetfold.functions.text import rfc3339_micros

ENVELOPE_KINDS = {
    "schema_version": "integer",
    "event_id": "string",
    "event_type": "string",
    "produced_at": "time",
    "source": "string",
    "payload": "any",
}

POSITION_KINDS = {
    "vehicle_id": "string",
    "route_id": "string",
    "lat": "number",
    "lon": "number",
    "speed_kph": "number",
    "bearing_deg": "number",
    "event_ts": "time",
    "sequence": "uint64",
}

_TIME = r'"[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?Z"'
_NAME = r'"[ !#-\[\]-~]{1,1000}+"'
# Pattern of whole records as our own producers write them, of the one version and type the sink takes: only values are
# left to be judged. What it must not match is what ``fields.plain_form`` must not match.
PRODUCED_FORM = (
    rf'^\{{"schema_version":{rules.SCHEMA_VERSION},"event_id":"[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}",'
    rf'"event_type":"{re.escape(rules.KNOWN_EVENT_TYPES[0])}","produced_at":{_TIME},"source":{_NAME},"payload":'
    rf'\{{"vehicle_id":{_NAME},"route_id":{_NAME},"lat":{fields.PLAIN_NUMBER},"lon":{fields.PLAIN_NUMBER},'
    rf'(?:"speed_kph":{fields.PLAIN_NUMBER},)?(?:"bearing_deg":{fields.PLAIN_NUMBER},)?"event_ts":{_TIME},"sequence":(?:0|[1-9][0-9]{{0,17}})\}}\}}\z'
)

HEADER = ["schema_version", "event_id", "event_type", "produced_at", "source"]
POSITION = list(POSITION_KINDS)


def document_verdict(what: str) -> Column:
    """Malformed, wrongly typed or undeclared content of the document just parsed; names no field."""
    unknown = F.col("_unknown")
    return rules.first_failure(
        (F.col("_broken"), "", f"not a valid {what}"),
        (unknown.isNotNull(), "", F.concat(F.lit(f"not a valid {what}: unknown field "), unknown)),
    )


def position_columns() -> dict[str, Column]:
    """Typed position columns of the document just parsed.

    Missing coordinates and counter read as 0; missing speed and bearing stay NULL.
    """
    zero = {"lat": F.lit(0.0), "lon": F.lit(0.0), "sequence": F.lit(0).cast("decimal(20,0)")}
    return {n: F.coalesce(n, zero[n]) if n in zero else F.col(n) for n in POSITION}


def decode_envelope(log: DataFrame) -> DataFrame:
    """Add the header columns, the payload text and ``header_verdict`` to every record.

    A payload is required but may be the JSON word null: the key is present, the value is judged
    later by the payload rules.
    """
    parsed = fields.parse_document(log, F.col("value").cast("string"), ENVELOPE_KINDS)
    verdict = F.coalesce(
        document_verdict("envelope"),
        rules.header_verdict(*map(F.col, HEADER[:4]), fields.is_present("payload")),
    )
    return parsed.select(
        *log.columns,
        *HEADER,
        fields.raw_text("payload").alias("payload"),
        verdict.alias("header_verdict"),
    )


def parse_position(decoded: DataFrame) -> DataFrame:
    """Add the payload's typed columns and ``position_verdict``."""
    parsed = fields.parse_document(decoded, F.col("payload"), POSITION_KINDS)
    p = position_columns()
    verdict = F.coalesce(
        document_verdict("vehicle position"),
        rules.position_verdict(*[p[n] for n in POSITION if n != "sequence"]),
    )
    return parsed.select(*decoded.columns, *[c.alias(n) for n, c in p.items()], verdict.alias("position_verdict"))


def judge(log: DataFrame) -> DataFrame:
    """Decode every record and classify its failure.

    ``reason`` is NULL for a record the sink may take; else one of the refusal categories. A record
    whose header cannot be trusted is identified by its position, any other by its own id. Records in the producers'
    form are read by one parse, all others exactly; ``log`` is read once for either, so it must be deterministic.
    """
    produced = F.coalesce(F.col("value").cast("string").rlike(PRODUCED_FORM), F.lit(False))
    return judge_produced(log.filter(produced)).unionByName(judge_exactly(log.filter(~produced)))


def judge_produced(log: DataFrame) -> DataFrame:
    """``judge`` for records of ``PRODUCED_FORM``, which leaves no question of keys, types, identifiers or version."""
    text = F.col("value").cast("string")
    rows = log.withColumn("_doc", fields.read_as(text, {n: ENVELOPE_KINDS[n] for n in HEADER}, payload=POSITION_KINDS))
    read = {n: F.col("_doc")[n] for n in HEADER} | {n: F.col("_doc.payload")[n] for n in POSITION}
    read |= {n: read[n].try_cast("timestamp") for n in ("produced_at", "event_ts")}
    rows = fields.once(rows, *[c.alias(n) for n, c in read.items()]).drop("_doc")
    p = position_columns()
    # A day that the calendar lacks is all that can be wrong with a time.
    bad_header = rules.first_failure(
        (F.col("produced_at").isNull(), "", "not a valid envelope"), (rules.is_zero_time(F.col("produced_at")), "produced_at", "is required")
    )
    bad_position = F.coalesce(
        rules.first_failure((F.col("event_ts").isNull(), "", "not a valid vehicle position")),
        rules.position_verdict(*[p[n] for n in POSITION if n != "sequence"]),
    )
    rows = rows.withColumns({"_header": bad_header, "_verdict": F.coalesce(bad_header, bad_position)})
    position = ids.position_id(F.col("topic"), F.col("partition"), F.col("offset"))
    judged = fields.once(
        rows,
        F.when(F.col("_header").isNotNull(), position).otherwise(F.col("event_id")).alias("_id"),
        F.when(F.col("_verdict").isNotNull(), "decode").alias("reason"),
        F.lit(0).alias("attempts"),
        F.when(F.col("_verdict").isNotNull(), rules.error_field(F.col("_verdict"))).alias("error_field"),
        F.when(F.col("_verdict").isNotNull(), rules.error_text(F.col("_verdict"))).alias("error"),
    )
    judged = judged.select(*log.columns, *HEADER, *[p[n].alias(n) for n in POSITION], "_id", "reason", "attempts", "error_field", "error")
    return judged.drop("event_id").withColumnRenamed("_id", "event_id")


def judge_exactly(log: DataFrame) -> DataFrame:
    """``judge`` for any record."""
    decoded = decode_envelope(log)
    rows = parse_position(decoded)
    bad_header = F.col("header_verdict").isNotNull()
    unknown = ~rules.known_event_type(F.col("event_type"))
    bad_position = F.col("position_verdict").isNotNull()
    unstorable = rules.unstorable_text(*map(F.col, ["vehicle_id", "route_id"]))

    unknown_verdict = F.struct(
        F.lit("event_type").alias("field"), F.concat(F.col("event_type"), F.lit(" is not implemented")).alias("reason")
    )
    nul_verdict = F.struct(F.lit("").alias("field"), F.lit("text contains a NUL character").alias("reason"))
    verdict = (
        F.when(bad_header, F.col("header_verdict"))
        .when(unknown, unknown_verdict)
        .when(bad_position, F.col("position_verdict"))
        .when(unstorable, nul_verdict)
    )
    reason = F.when(bad_header, "decode").when(unknown, "unknown_version").when(bad_position | unstorable, "decode")
    position = ids.position_id(F.col("topic"), F.col("partition"), F.col("offset"))
    event_id = F.when(bad_header, position).otherwise(ids.canonical_uuid(F.col("event_id")))
    # Only a refusal by the store itself counts as an attempt.
    stored = ~bad_header & ~unknown & ~bad_position
    judged = fields.once(
        rows,
        event_id.alias("_id"),
        reason.alias("reason"),
        F.when(stored & unstorable, 1).otherwise(0).alias("attempts"),
        F.when(verdict.isNotNull(), rules.error_field(verdict)).alias("error_field"),
        F.when(verdict.isNotNull(), rules.error_text(verdict)).alias("error"),
    )
    judged = judged.drop("header_verdict", "position_verdict", "payload", "event_id")
    return judged.withColumnRenamed("_id", "event_id")


def marshal_envelope(rows: DataFrame, produced_at: Column, source: Column) -> Column:
    """Wire bytes of a position row. NULL speed and bearing are left out, as readers expect."""
    payload = F.struct(
        "vehicle_id",
        "route_id",
        F.col("lat").alias("lat"),
        F.col("lon").alias("lon"),
        "speed_kph",
        "bearing_deg",
        rfc3339_micros(F.col("event_ts")).alias("event_ts"),
        "sequence",
    )
    envelope = F.struct(
        F.lit(rules.SCHEMA_VERSION).alias("schema_version"),
        F.col("event_id").alias("event_id"),
        F.lit(rules.KNOWN_EVENT_TYPES[0]).alias("event_type"),
        rfc3339_micros(produced_at).alias("produced_at"),
        source.alias("source"),
        payload.alias("payload"),
    )
    return F.encode(F.to_json(envelope, {"ignoreNullFields": "true"}), "UTF-8")
