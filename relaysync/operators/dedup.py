"""Re-delivered message removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync.functions.headers import header_value
from relaysync.settings import Settings


def message_id(settings: Settings) -> Column:
    """The message-id header, else stream and seq (``seq`` is unique only within its stream)."""
    return F.coalesce(header_value(F.col("headers"), settings.message_id_header),
                      F.concat_ws(":", "stream", F.col("seq").cast("string")))


def with_message_id(raw: DataFrame, settings: Settings) -> DataFrame:
    return raw.withColumn("message_id", message_id(settings))


def dedup_messages(raw: DataFrame, settings: Settings) -> DataFrame:
    """Batch: one copy per message id, the first delivered (partial aggregate, skew-safe).

    Copies are ordered by ``seq``, then ``ts``, ``stream`` and ``body``, so the
    kept copy does not depend on partitioning.  The key columns, the body and
    the rest are aggregates of their own: a caller that takes only ids and key
    columns neither sorts nor shuffles bodies and headers.
    """
    msgs = with_message_id(raw, settings)
    key, order = F.struct("seq", "ts", "stream"), F.struct("seq", "ts", "stream", "body")
    rest = [c for c in msgs.columns if c not in ("message_id", "seq", "ts", "stream", "body")]
    kept = msgs.groupBy("message_id").agg(
        F.min(key).alias("k"), F.min(order).alias("o"), *([F.min_by(F.struct(*rest), order).alias("m")] if rest else []))
    of = {"seq": "k", "ts": "k", "stream": "k", "body": "o"}
    return kept.select(*[F.col(of.get(c, "m")).getField(c).alias(c) for c in msgs.columns if c != "message_id"], "message_id")


def dedup_stream(raw: DataFrame, settings: Settings) -> DataFrame:
    """Stream: the first copy of each message id to arrive, however late it is.

    There is no watermark: a watermark would also drop messages that are late
    but not duplicates.  The state is one key per message id, kept for the
    life of the query (use the RocksDB state store).
    """
    return with_message_id(raw, settings).dropDuplicates(["message_id"])
