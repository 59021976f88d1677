"""Derivative routing.

The registry (one row per installed item) comes from properties; events are
routed to it by their stream.  The join carries no hint: adaptive execution
measures the registry and broadcasts it when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync import schema as S
from relaysync.functions.http_options import add_http_options_col
from relaysync.settings import KEY_DERIVATIVES, TRUE_WORDS, Settings
from relaysync.sources.properties import resolve

ITEM_KEY = r"^derivative\.(.+)\.(enabled|in\.stream|service\.url)$"
ROUTE_PREFIX = "derivative."


def _bool(v: Column, default: bool) -> Column:
    """Column form of ``settings.read_bool``: absent -> default, else on only for true/on/yes/1."""
    return F.when(v.isNull(), F.lit(default)).otherwise(F.lower(F.trim(v)).isin(*TRUE_WORDS))


def routes_registry(props: DataFrame, default_enabled: bool = False) -> DataFrame:
    """(route, item, stream, service_url, enabled) of every installed item.

    An installed item without a stream or service URL is dropped.
    """
    kv = resolve(props)
    installed = kv.where(F.col("key") == KEY_DERIVATIVES).select(
        F.explode(F.split("value", ",")).alias("item")
    ).select(F.trim("item").alias("item")).where(F.col("item") != "").distinct()
    per_item = (
        kv.select(F.regexp_extract("key", ITEM_KEY, 1).alias("item"),
                  F.regexp_extract("key", ITEM_KEY, 2).alias("prop"), "value")
        .where(F.col("item") != "")
        .groupBy("item")
        .agg(
            F.max(F.when(F.col("prop") == "enabled", F.col("value"))).alias("enabled"),
            F.max(F.when(F.col("prop") == "in.stream", F.col("value"))).alias("stream"),
            F.max(F.when(F.col("prop") == "service.url", F.col("value"))).alias("service_url"),
        )
    )
    return installed.join(per_item, "item", "inner").where(
        F.col("stream").isNotNull() & F.col("service_url").isNotNull()
    ).select(
        F.concat(F.lit(ROUTE_PREFIX), F.col("item")).alias("route"), "item", "stream", "service_url",
        _bool(F.col("enabled"), default_enabled).alias("enabled"),
    )


def routed(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw events of enabled items' streams: a semi-join below the parse, so no other body is parsed."""
    streams = registry.where(F.col("enabled")).select("stream")
    return raw.join(streams, "stream", "left_semi").select(*raw.columns)


def content_only(fields: DataFrame) -> DataFrame:
    """Fields whose event is cut to the attachment's content, all that these routes read of it: a far smaller row to keep."""
    content = F.col("event").getField("attachment").getField("content").alias("content")
    return fields.withColumn("event", F.struct(F.struct(content).alias("attachment")))


def derivative_outcomes(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of enabled derivative streams that stop before the service call."""
    reg = registry.where(F.col("enabled")).select("route", "stream")
    j = fields.join(reg, "stream", "inner")
    c = F.col("event").getField("attachment").getField("content")
    reason = (F.when(F.col("malformed"), F.coalesce(F.col("parse_reason"), F.lit(S.R_MALFORMED)))
              .when(c.isNull(), F.lit(S.R_MISSING_ATTACHMENT))
              .when(c.getField("source_uri").isNull(), F.lit("missing_source_uri")))
    return j.where(reason.isNotNull()).select(
        "seq", "ts",
        F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("route")).alias("request_id"),
        "route",
        F.when(reason == "missing_source_uri", F.lit("skipped")).otherwise(F.lit("failed")).alias("outcome"),
        reason.alias("reason"),
        F.when(reason == "missing_source_uri", F.lit("WARN")).otherwise(F.lit("ERROR")).alias("level"),
        F.lit(0).cast("bigint").alias("attempts"),
    )


def derivative_requests(fields: DataFrame, registry: DataFrame, settings: Settings) -> DataFrame:
    """One service request per event on an enabled item's stream."""
    reg = registry.where(F.col("enabled")).select("route", "stream", "service_url")
    j = fields.join(reg, "stream", "inner")
    c = F.col("event").getField("attachment").getField("content")
    ok = j.where(~F.col("malformed") & c.isNotNull() & c.getField("source_uri").isNotNull())
    return ok.select(
        "seq", "ts", "route",
        F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("route")).alias("request_id"),
        add_http_options_col(F.col("service_url"), F.lit(settings.http_options or "")).alias("service_uri"),
        c.getField("source_uri").alias("source_uri"),
        c.getField("args").alias("args"),
        c.getField("mimetype").alias("mimetype"),
        c.getField("destination_uri").alias("destination_uri"),
        c.getField("file_upload_uri").alias("file_upload_uri"),
    )
