"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of identifiers derived from a log position.
POSITION_NAMESPACE = "0f397628-915d-4017-804c-d7d748afb01a"

# Namespace of identifiers minted for submissions that carry none.
SUBMISSION_NAMESPACE = "5d1b6c1e-7a55-4f0c-9f0e-2f6a3f3f8f11"

_HEX = "[0-9a-fA-F]"
_DASHED = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"


def dashed(hex32: Column) -> Column:
    """32 hex digits to the 8-4-4-4-12 form."""
    parts = [F.substring(hex32, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(parts[0], *[c for part in parts[1:] for c in (F.lit("-"), part)])


def canonical_uuid(text: Column) -> Column:
    """Lower-case dashed form of any accepted spelling; NULL when the text is not a UUID."""
    return (
        F.when(text.rlike(f"^{_DASHED}$"), F.lower(text))
        .when(text.rlike(f"^{_HEX}{{32}}$"), dashed(F.lower(text)))
        .when(text.rlike(f"^\\{{{_DASHED}\\}}$"), F.lower(F.substring(text, 2, 36)))
        .when(text.rlike(f"^(?i:urn:uuid:){_DASHED}$"), F.lower(F.substring(text, 10, 36)))
    )


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based (SHA-1) UUID of a text column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))

    def stamped(d: Column) -> Column:
        variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(d, 1, 12), F.lit("5"), F.substring(d, 14, 3), variant, F.substring(d, 18, 15))

    # Through a one-element array the digest is written, and computed, once.
    return dashed(F.transform(F.array(digest), stamped)[0])


def position_id(topic: Column, partition: Column, offset: Column) -> Column:
    """Identifier of a record that cannot supply one: a function of where it lies in the log."""
    return uuid5(POSITION_NAMESPACE, F.concat_ws("/", topic, partition.cast("string"), offset.cast("string")))


def submission_id(batch_id: Column, index: Column) -> Column:
    """Identifier for a submission without one.

    A random id would change whenever a task is retried or a plan is recomputed, which would turn
    one observation into two; a function of the batch and the position cannot.
    """
    return uuid5(SUBMISSION_NAMESPACE, F.concat_ws("/", batch_id, index.cast("string")))
