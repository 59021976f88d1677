"""Event parsing (B1-B3): JSON body -> typed event struct, quarantine flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync.schema import (CORRUPT_COL, EVENT_DDL, KNOWN_CONTENT, KNOWN_KEYS, KNOWN_NESTED, KNOWN_URL, R_MALFORMED,
                              R_UNKNOWN_FIELD)

UUID_PREFIX = "urn:uuid:"


def has_unknown_key(body: Column) -> Column:
    """True when the event, or an object nested in it, has a key the event model does not know."""
    def extra(keys: Column, known: list[str]) -> Column:
        return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, F.lit(False))

    found = extra(F.json_object_keys(body), KNOWN_KEYS)
    for name, known in KNOWN_NESTED.items():
        part = F.get_json_object(body, f"$.{name}")
        found = found | extra(F.json_object_keys(part), known)
        if "url" in known:
            links = F.from_json(F.get_json_object(part, "$.url"), "array<map<string,string>>")
            found = found | F.coalesce(F.exists(links, lambda u: extra(F.map_keys(u), KNOWN_URL)), F.lit(False))
    return found | extra(F.json_object_keys(F.get_json_object(body, "$.attachment.content")), KNOWN_CONTENT)


def parse_events(raw: DataFrame, body: str = "body", strict: bool = False) -> DataFrame:
    """Add ``event`` (struct), ``corrupt`` (string) and ``malformed`` (bool).

    The body is parsed exactly once per row.  ``from_json`` is placed in a
    one-element ``explode`` (a Generate node): Catalyst pushes filters through
    plain projections by substituting the aliased expression, which would copy
    the whole parse into every predicate that reads an event field; it does
    not push predicates on generated columns below the Generate.

    A body is malformed when it does not parse (corrupt text, null, empty,
    a JSON array) or a field has the wrong type.  With ``strict`` an
    unknown key, at the top or in a nested object, is also rejected.
    """
    parsed = F.from_json(
        F.col(body),
        EVENT_DDL,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL},
    )
    df = raw.select("*", F.explode(F.array(parsed)).alias("_parsed"))
    corrupt = F.col("_parsed").getField(CORRUPT_COL)
    malformed = F.col("_parsed").isNull() | corrupt.isNotNull()
    reason = F.when(malformed, F.lit(R_MALFORMED))
    if strict:
        df = df.select("*", F.explode(F.array(has_unknown_key(F.col(body)))).alias("_unknown"))
        reason = reason.when(F.col("_unknown"), F.lit(R_UNKNOWN_FIELD))
        malformed = malformed | F.col("_unknown")
    return (
        df.withColumn("event", F.col("_parsed").dropFields(CORRUPT_COL))
        .withColumn("corrupt", corrupt)
        .withColumn("malformed", malformed)
        .withColumn("parse_reason", reason)
        .drop("_parsed", "_unknown")
    )


def is_new_version(col: Column) -> Column:
    """Coerce isNewVersion (string or JSON boolean read as string) to boolean.

    Only true/false (any case, trimmed) are accepted; anything else is null.
    """
    v = F.lower(F.trim(col))
    return F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False))


def strip_uuid(object_id: Column) -> Column:
    """Remove every ``urn:uuid:`` occurrence (replace-all, not a prefix strip)."""
    return F.replace(object_id, F.lit(UUID_PREFIX), F.lit(""))
