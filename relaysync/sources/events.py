"""Event sources (A1, A2, A3, A8): land messages as ``raw_events``.

``raw_events``: seq bigint, ts timestamp, stream string,
headers map<string,string>, body string.  Every route reads the same landed
table; the ``stream`` column says which queue a message came from, so
routing (C3) is a filter, and partition pruning when the landing table is
partitioned by ``stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.schema import RAW_EVENTS_DDL, RESOURCES_DDL

RAW_COLUMNS = ["seq", "ts", "stream", "headers", "body"]


def read_raw_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Batch read of a landed raw_events table (parquet or JSON lines)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(*RAW_COLUMNS)
    return spark.read.schema(RAW_EVENTS_DDL).format(fmt).load(path)


def read_raw_events_stream(spark: SparkSession, path: str, fmt: str = "json",
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of landed raw_events files."""
    r = spark.readStream.schema(RAW_EVENTS_DDL).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def read_bodies(spark: SparkSession, path: str, stream: str, streaming: bool = False) -> DataFrame:
    """One message body per text line of a queue dump (batch only).

    ``seq`` comes from ``monotonically_increasing_id`` (unique, ordered within
    a file) and ``ts`` is ingest time; headers are empty.  A plain text line
    carries no sequence number and a stream cannot number rows, so for a
    continuous source land the bodies with a ``seq`` (``land``) and read them
    with ``read_raw_events_stream``, or use ``read_kafka`` (offsets).
    """
    if streaming:
        raise ValueError("read_bodies is batch only: a stream of bare lines has no order; "
                         "land raw_events with a seq or read Kafka")
    df = spark.read.text(path)
    return df.select(
        F.monotonically_increasing_id().alias("seq"),
        F.current_timestamp().alias("ts"),
        F.lit(stream).alias("stream"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.col("value").alias("body"),
    )


def read_kafka(spark: SparkSession, servers: str, topics: list[str], streaming: bool = True,
               **options: str) -> DataFrame:
    """Kafka topics as raw_events (needs the Kafka connector on the classpath).

    topic -> stream, value -> body, headers -> map, offset and partition -> seq
    (``kafka_to_raw``).  Offsets are ordered only within a partition, so last-writer-wins by
    ``seq`` is exact when each subject's messages share one partition (produce
    them keyed by subject), which is also Kafka's own ordering guarantee.
    """
    reader = spark.readStream if streaming else spark.read
    r = reader.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", ",".join(topics)).option("includeHeaders", "true")
    for k, v in options.items():
        r = r.option(k, v)
    return kafka_to_raw(r.load())


# More partitions than a topic can usefully have; offsets stay exact below 2 ** 47.
KAFKA_PARTITIONS = 1 << 16
KAFKA_DDL = ("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
             "timestampType int, headers array<struct<key:string,value:binary>>")


def kafka_to_raw(df: DataFrame) -> DataFrame:
    """Kafka source rows -> raw_events (batch or stream).

    A header name that repeats keeps its last value.  ``seq`` is
    ``offset * KAFKA_PARTITIONS + partition``: unique within a topic, and in
    offset order within each partition.
    """
    entries = F.transform(
        F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")),
        lambda h: F.struct(h.getField("key").alias("k"), h.getField("value").cast("string").alias("v")))
    # keep only the last entry of each header name (a map cannot hold a key twice)
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
        lambda x: F.coalesce(x.getField("k") == e.getField("k"), F.lit(False))))
    hdrs = F.map_from_arrays(
        F.transform(last, lambda e: e.getField("k")), F.transform(last, lambda e: e.getField("v")))
    return df.select(
        (F.col("offset") * F.lit(KAFKA_PARTITIONS) + F.col("partition")).alias("seq"),
        F.col("timestamp").alias("ts"),
        F.col("topic").alias("stream"),
        hdrs.alias("headers"),
        F.col("value").cast("string").alias("body"),
    )


def read_resources(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already-fetched JSON-LD documents (url, body)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("url", "body")
    return spark.read.schema(RESOURCES_DDL).format(fmt).load(path)


def land(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Write raw events partitioned by stream (routing becomes partition pruning)."""
    raw.select(*RAW_COLUMNS).write.mode(mode).partitionBy("stream").parquet(path)
