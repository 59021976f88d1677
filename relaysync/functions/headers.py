"""Header map operations (B9, B10, B14). Header names compare case-insensitively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_MAP = "map<string,string>"


def _coalesced(headers: Column) -> Column:
    return F.coalesce(headers, F.create_map().cast(EMPTY_MAP))


def keep_headers(headers: Column, keep: list[str]) -> Column:
    """Remove every header except those named in ``keep``."""
    names = [k.lower() for k in keep]
    return F.map_filter(_coalesced(headers), lambda k, v: F.lower(k).isin(names))


def set_header(headers: Column, name: str, value: Column) -> Column:
    """Set ``name`` (replacing any spelling of it); ``map_concat`` would raise on a duplicate."""
    rest = F.map_filter(_coalesced(headers), lambda k, v: F.lower(k) != name.lower())
    return F.map_concat(rest, F.create_map(F.lit(name), value.cast("string")))


def default_header(headers: Column, name: str, value: Column) -> Column:
    """Add ``name`` only when the map has no header of that name."""
    h = _coalesced(headers)
    present = F.exists(F.map_keys(h), lambda k: F.lower(k) == name.lower())
    return F.when(present, h).otherwise(
        F.map_concat(h, F.create_map(F.lit(name), value.cast("string")))
    )


def header_value(headers: Column, name: str) -> Column:
    """Value of ``name`` in any spelling, or null."""
    hit = F.map_filter(_coalesced(headers), lambda k, v: F.lower(k) == name.lower())
    return F.get(F.map_values(hit), 0)
