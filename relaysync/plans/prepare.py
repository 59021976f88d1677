"""Parsed events as the jobs keep them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from relaysync.operators import requests as R

PREPARED_COLUMNS = ["seq", "ts", "stream", "headers", "base_url", "uuid", "jsonld_url", "json_url",
                    "canonical_url", "describes_url", "source_field", "is_new_version", "malformed",
                    "parse_reason", "event"]


Transform = Callable[[DataFrame], DataFrame]


def prepared(raw: DataFrame, strict: bool = False, transform: Transform | None = None) -> DataFrame:
    """Parsed events with the derived columns every operator reads, after the user hook."""
    f = R.prepare(raw, strict)
    if transform is not None:
        f = f.transform(transform)
    return f.select(*PREPARED_COLUMNS)
