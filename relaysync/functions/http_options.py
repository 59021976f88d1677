"""HTTP endpoint options.

Rule: split the option list on ``,``; drop empty elements, then trim (so a
whitespace-only element survives as ``""``); append ``connectionClose=true``
and ``disableStreamCache=true`` unless an element already starts with that
key; join with ``&``.  The joiner before the options is nothing for an empty
endpoint, ``&`` when the endpoint has a ``?`` or the caller forces it, ``?``
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: default endpoint options -------------------------------
DEFAULT_OPTIONS = [("connectionClose=", "connectionClose=true"),
                   ("disableStreamCache=", "disableStreamCache=true")]


def _java_trim(s: str) -> str:
    # trims every char <= U+0020, like java.lang.String.trim
    i, j = 0, len(s)
    while i < j and ord(s[i]) <= 32:
        i += 1
    while j > i and ord(s[j - 1]) <= 32:
        j -= 1
    return s[i:j]


def option_elements(options: str | None) -> list[str]:
    """Driver-side: the option elements, defaults appended."""
    elems = [_java_trim(e) for e in (options or "").split(",") if e != ""]
    for prefix, default in DEFAULT_OPTIONS:
        if not any(e.startswith(prefix) for e in elems):
            elems.append(default)
    return elems


def add_http_options(endpoint: str, options: str | None = "", force_ampersand: bool = False) -> str:
    """Driver-side form, used to fold a constant suffix into the plan."""
    common = "&".join(option_elements(options))
    if endpoint == "":
        return common
    joiner = "&" if ("?" in endpoint or force_ampersand) else "?"
    return endpoint + joiner + common


def options_suffix(options: str | None, force_ampersand: bool = False) -> str:
    """Suffix for a non-empty endpoint template without ``?``."""
    return ("&" if force_ampersand else "?") + "&".join(option_elements(options))


def _starts_with(prefix: str):
    return lambda e: e.startswith(prefix)


def add_http_options_col(endpoint: Column, options: Column | None = None,
                         force_ampersand: Column | bool = False) -> Column:
    """Column form, for endpoints or option lists that vary per row."""
    opts = F.coalesce(options, F.lit("")) if options is not None else F.lit("")
    elems = F.transform(
        F.filter(F.split(opts, ",", -1), lambda e: e != ""),
        lambda e: F.regexp_replace(e, r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
    )
    for prefix, default in DEFAULT_OPTIONS:
        has = F.exists(elems, _starts_with(prefix))
        elems = F.when(has, elems).otherwise(F.concat(elems, F.array(F.lit(default))))
    common = F.array_join(elems, "&")
    force = force_ampersand if isinstance(force_ampersand, Column) else F.lit(bool(force_ampersand))
    joiner = (
        F.when(endpoint == "", F.lit(""))
        .when(F.contains(endpoint, F.lit("?")) | F.coalesce(force, F.lit(False)), F.lit("&"))
        .otherwise(F.lit("?"))
    )
    return F.concat(endpoint, joiner, common)
