"""First-matching link of a url array (B6, B6a-d)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaysync.schema import MT_JSON, MT_JSONLD, REL_CANONICAL, REL_DESCRIBES


def first_url(urls: Column, media_type: str | None = None, rel: str | None = None) -> Column:
    """href of the first element satisfying every given condition.

    Equality is case-insensitive; an element whose mediaType/rel is null does
    not match; a null array has no match.  ``get`` (not ``[0]``) so an empty
    match list yields null instead of raising.
    """

    def pred(u: Column) -> Column:
        cond = F.lit(True)
        if media_type is not None:
            cond = cond & (F.lower(u.getField("mediaType")) == media_type.lower())
        if rel is not None:
            cond = cond & (F.lower(u.getField("rel")) == rel.lower())
        # null comparisons become false so filter never sees a null predicate
        return F.coalesce(cond, F.lit(False))

    return F.get(F.filter(urls, pred), 0).getField("href")


def jsonld_url(urls: Column) -> Column:
    return first_url(urls, media_type=MT_JSONLD)


def json_url(urls: Column) -> Column:
    return first_url(urls, media_type=MT_JSON)


def canonical_url(urls: Column) -> Column:
    # media type is deliberately not checked: any canonical link counts
    return first_url(urls, rel=REL_CANONICAL)


def describes_url(urls: Column) -> Column:
    return first_url(urls, rel=REL_DESCRIBES)
