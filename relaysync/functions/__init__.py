"""Column expressions (all JVM-side, no Python UDFs)."""

from relaysync.functions.headers import default_header, keep_headers, set_header
from relaysync.functions.http_options import add_http_options, add_http_options_col, option_elements
from relaysync.functions.parse import is_new_version, parse_events, strip_uuid
from relaysync.functions.urls import (
    canonical_url,
    describes_url,
    first_url,
    json_url,
    jsonld_url,
)

__all__ = [
    "add_http_options",
    "add_http_options_col",
    "canonical_url",
    "default_header",
    "describes_url",
    "first_url",
    "is_new_version",
    "json_url",
    "jsonld_url",
    "keep_headers",
    "option_elements",
    "parse_events",
    "set_header",
    "strip_uuid",
]
