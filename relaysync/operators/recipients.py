"""Recipient-list fan-out (D5): one row per listed recipient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.functions.headers import header_value
from relaysync.settings import Settings


def recipient_fanout(raw: DataFrame, settings: Settings) -> DataFrame:
    """Split the recipients header on ``,``, trim, drop empty entries."""
    lst = header_value(F.col("headers"), settings.recipients_header)
    names = F.filter(F.transform(F.split(lst, ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select("seq", F.explode(names).alias("recipient"))
