"""Strictly typed fields of a JSON document.

``from_json`` with declared types is strict about numbers but forgiving about text: the number ``5``
becomes the string ``"5"``. Reading a field as VARIANT keeps its JSON type, but costs far more than a
plain read. So documents are read with plain types, and only a row whose text *could* hold a
mistyped field (a cheap pattern decides) is parsed again with VARIANT fields and judged exactly.
Most documents are written the way our own producers write them; one anchored pattern recognises those, and for
them the plain read is all there is to do (``plain_form``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_malformed",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}

_UINT64_MAX = "18446744073709551615"
_INT64_MAX = "9223372036854775807"

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"

_PLAIN_TYPE = {
    "string": "STRING",
    "time": "STRING",
    "any": "STRING",
    "number": "DOUBLE",
    "integer": "BIGINT",
    "uint64": "DECIMAL(20,0)",
}


def read_as(text: Column, kinds: dict[str, str], **nested: dict[str, str]) -> Column:
    """A document whose form is known, read with plain types; ``nested``: fields that are documents themselves."""
    inner = [f"{n} STRUCT<" + ", ".join(f"{m}: {_PLAIN_TYPE[k]}" for m, k in of.items()) + ">" for n, of in nested.items()]
    return F.from_json(text, ", ".join([*[f"{n} {_PLAIN_TYPE[k]}" for n, k in kinds.items()], *inner]), _STRICT)


def once(rows: DataFrame, *computed: Column) -> DataFrame:
    """Add named columns that are computed exactly once per row.

    The optimizer copies the expression behind a column into every filter that uses it. For a JSON
    parse that feeds a chain of rules this multiplies the work beyond reason. It does not look
    through a generator, so the values are passed through one that yields a single row.
    """
    packed = rows.withColumn("_once", F.struct(*computed))
    return packed.select(*rows.columns, F.inline(F.array("_once")))


def _uint64_limit() -> Column:
    return F.lit(_UINT64_MAX).cast("decimal(20,0)")


def json_type(value: Column) -> Column:
    """JSON type name of a VARIANT; missing and null are both VOID."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _exact_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT holds a JSON type its kind allows (numbers are judged by the plain read)."""
    t = json_type(value)
    if kind in ("string", "time"):
        return t.isin("VOID", "STRING")
    big = F.try_variant_get(value, "$", "decimal(20,0)")
    # Whole numbers that fit a long are BIGINT; a small DECIMAL was written with a fraction.
    whole = t.rlike(r"^DECIMAL\(\d+,0\)$") & (big > F.lit(_INT64_MAX).cast("decimal(20,0)")) & (big <= _uint64_limit())
    return F.coalesce((t == "VOID") | ((t == "BIGINT") & (big >= 0)) | whole, F.lit(False))


def _suspicious(text: Column, kinds: dict[str, str]) -> Column:
    """True for every document with a mistyped text or counter field (and for few others).

    Text fields must be followed by a quote and counters by digits alone. A key can also be spelled
    with escapes, so any unicode escape is looked at exactly. The pattern starts with the one quote
    all keys share: a search tries it at quotes only.
    """
    texts = "|".join(n for n, k in kinds.items() if k in ("string", "time"))
    counters = "|".join(n for n, k in kinds.items() if k == "uint64")
    parts = []
    if texts:
        parts.append(rf'(?:{texts})"\s*:\s*[^"\s]')
    if counters:
        parts.append(rf'(?:{counters})"\s*:\s*(?![0-9]+\s*[,}}])')
    escaped = F.contains(text, F.lit("\\u"))
    return escaped | text.rlike('"(?:' + "|".join(parts) + ")") if parts else escaped


# Values that cannot be mistyped, out of range or escaped. No repetition may hold a group without a bound: the
# matcher recurses there, and texts may have any length.
_PLAIN_TEXT = r'"[ !#-\[\]-~]*+"'
PLAIN_NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,20})?(?:[eE][-+]?[0-9]{1,2})?"
_NEXT = r'(?:,(?=")|(?=\}))'
_PLAIN_VALUE = {
    "string": _PLAIN_TEXT,
    "time": _PLAIN_TEXT,
    "any": r"\{(?:" + _PLAIN_TEXT + ":(?:" + _PLAIN_TEXT + "|" + PLAIN_NUMBER + ")" + _NEXT + r"){0,16}\}",
    "number": PLAIN_NUMBER,
    "integer": "(?:0|[1-9][0-9]{0,8})",
    "uint64": "(?:0|[1-9][0-9]{0,17})",
}


def plain_form(kinds: dict[str, str]) -> str:
    """Pattern of documents that need no further look: declared keys in their order, each once at the most, not null,
    of the right type, in printable ASCII without escapes or white space between them. Others are judged exactly.
    """
    return r"^\{" + "".join(f'(?:"{n}":{_PLAIN_VALUE[k]}{_NEXT})?' for n, k in kinds.items()) + r"\}\z"


def parse_document(rows: DataFrame, text: Column, kinds: dict[str, str]) -> DataFrame:
    """Parse a JSON object: add every declared field with its plain type, ``_broken`` and ``_unknown``.

    ``_broken``: not an object, or a field of the wrong JSON type. ``_unknown``: the first key
    outside the contract. Missing and null fields are both NULL (see ``is_present``).
    """
    names = list(kinds)
    plain = ", ".join(f"{n} {_PLAIN_TYPE[k]}" for n, k in kinds.items()) + ", _malformed STRING"
    rows = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    doc = F.from_json("_text", plain, _STRICT)
    read = once(
        rows.withColumns({"_doc": doc, "_plain": F.col("_text").rlike(plain_form(kinds))}),
        *[F.col("_doc")[n].alias(n) for n in names],
        (F.col("_doc").isNull() | F.col("_doc")["_malformed"].isNotNull()).alias("_bad_json"),
        F.when(F.col("_plain"), F.array_compact(F.array(*[F.when(F.col("_doc")[n].isNotNull(), F.lit(n)) for n in names])))
        .otherwise(F.json_object_keys("_text")).alias("_keys"),
    ).drop("_doc")
    read = read.select("*", *[rfc3339_to_ts(F.col(n)).alias(f"_at_{n}") for n, k in kinds.items() if k == "time"])

    strict = [n for n, k in kinds.items() if k in ("string", "time", "uint64")]
    exact_doc = F.from_json("_text", ", ".join(f"{n} VARIANT" for n in strict) + ", _malformed STRING", _STRICT)
    exact = F.lit(True)
    for n in strict:
        exact = exact & _exact_kind(exact_doc[n], kinds[n])
    mistyped = F.when(~F.col("_plain") & _suspicious(F.col("_text"), kinds), ~exact).otherwise(F.lit(False)) if strict else F.lit(False)
    for n, k in kinds.items():
        if k == "number":
            mistyped = mistyped | F.coalesce(F.abs(F.col(n)) == float("inf"), F.lit(False))
        elif k == "uint64":
            mistyped = mistyped | (~F.col("_plain") & F.coalesce((F.col(n) < 0) | (F.col(n) > _uint64_limit()), F.lit(False)))
        elif k == "time":
            mistyped = mistyped | (F.col(n).isNotNull() & F.col(f"_at_{n}").isNull())
    # The bare word null decodes to an empty document.
    broken = (F.col("_bad_json") & (F.trim("_text") != "null")) | mistyped
    unknown = F.when(~F.col("_plain"), F.try_element_at(F.array_except("_keys", F.array(*map(F.lit, names))), F.lit(1)))
    typed = [F.col(f"_at_{n}" if k == "time" else n).alias(n) for n, k in kinds.items()]
    kept = [c for c in rows.columns if c != "_text"]
    return read.select(*kept, *typed, broken.alias("_broken"), unknown.alias("_unknown"), "_keys", "_text", "_plain")


def is_present(name: str) -> Column:
    """The key is there in the document just parsed, whatever its value."""
    return F.coalesce(F.array_contains("_keys", name), F.lit(False))


def raw_text(name: str) -> Column:
    """JSON text of an ``any`` field: a string keeps its quotes, a null is the word null."""
    quoted = F.from_json("_text", f"{name} VARIANT, _malformed STRING", _STRICT)[name]
    return (
        F.when(F.col("_plain"), F.col(name))
        .when(F.contains("_text", F.lit("\\u")) | F.col("_text").rlike(rf'"{name}"\s*:\s*"'), F.to_json(quoted))
        .when(F.col(name).isNull() & is_present(name), "null")
        .otherwise(F.col(name))
    )


def rfc3339_to_ts(text: Column) -> Column:
    """RFC 3339 text to a timestamp (microseconds, extra digits cut); NULL when it is not one.

    A cast takes offsets of up to 18 hours; one beyond is subtracted from the same text read as UTC.
    """
    dotted = F.when(F.contains(text, F.lit(",")), F.translate(text, ",", ".")).otherwise(text)
    utc = F.concat(F.substr(dotted, F.lit(1), F.length(dotted) - 6), F.lit("Z")).try_cast("timestamp")
    offset = F.right(text, F.lit(6))
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")
    far = F.timestamp_add("MINUTE", F.when(offset.startswith("-"), minutes).otherwise(-minutes), utc)
    return F.when(text.rlike(_RFC3339), F.coalesce(dotted.try_cast("timestamp"), F.when(offset.rlike(r"^[+-]\d\d:\d\d$"), far)))


def is_zero_time(ts: Column) -> Column:
    """Missing, or the calendar's first instant, which the contract treats as missing."""
    return F.coalesce(ts == F.lit("0001-01-01T00:00:00Z").cast("timestamp"), F.lit(True))
