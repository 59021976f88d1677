"""Continuous runs (I1) with an idempotent sink.

Every operator of the batch path runs unchanged on ``readStream`` input.
Sinks go through ``foreachBatch`` into a log of committed batches
(``streaming.batches``), so a batch replayed after a failure adds nothing and
readers see whole batches only; the checkpoint makes the source offsets exact.
Stateful steps are plain aggregations in update mode (max_by per subject,
attempt statistics per request); their sink is an append-only log of
updates that readers fold with the same aggregate (merge on read).
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync import storage
from relaysync.schema import RAW_EVENTS_DDL
from relaysync.session import scratch_dir
from relaysync.streaming.batches import BatchLog, log_writer


def files_per_chunk(df: DataFrame) -> int:
    try:
        return max(1, df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext view (Connect): fall back to the shuffle width
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def stage_in_order(df: DataFrame, path: str, order_col: str, chunks: int = 2, fmt: str = "parquet") -> int:
    """Land ``df`` in ``chunks`` successive writes ordered by ``order_col``.

    Successive writes give the file source an arrival order (file times), the
    way a real landing zone fills up.  The range filter of each chunk prunes
    the work to that chunk's rows, and the min/max job reads only
    ``order_col`` (column pruning).  Only the min/max reach the driver.
    Returns the number of files per chunk (use it as ``maxFilesPerTrigger``).
    """
    files = files_per_chunk(df)
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    if lo is None:  # empty, or every key null: one chunk with everything
        df.repartition(files).write.format(fmt).save(f"{path}/chunk-0000")
        return files
    width = max(1, (hi - lo) // chunks + 1)
    key = F.col(order_col)
    for i in range(chunks):
        in_range = (key >= lo + i * width) & (key < lo + (i + 1) * width)
        if i == 0:
            in_range = in_range | key.isNull()  # rows without a key land first, none is lost
        df.where(in_range).repartition(files).write.format(fmt).save(f"{path}/chunk-{i:04d}")
    return files


def stage_by_hash(df: DataFrame, path: str, *key: str, chunks: int = 3, fmt: str = "parquet", dealt: int | None = None) -> int:
    """Land ``df`` in ``chunks`` successive writes in hash order of ``key`` (shuffled arrival).

    Rows that must meet in state across triggers differ in some key column.
    Rows that are ``dealt`` evenly over that many tasks already are written where they are.
    """
    files = dealt or files_per_chunk(df)
    for i in range(chunks):
        some = df.where(F.pmod(F.xxhash64(*key), F.lit(chunks)) == i)
        (some if dealt else some.repartition(files)).write.format(fmt).save(f"{path}/chunk-{i:04d}")
    return files


def time_cuts(df: DataFrame, time_col: str, chunks: int) -> list[int]:
    """Times, in microseconds, that cut the rows of ``df`` into about ``chunks`` equal parts; rows of one time stay together."""
    if chunks < 2:
        return []
    shares = [k / chunks for k in range(1, chunks)]
    cuts = df.agg(F.percentile_approx(F.unix_micros(time_col), shares, max(10_000, 100 * chunks))).first()[0]
    return sorted(set(cuts or []))


def chunk_of(time_col: str, cuts: list[int]) -> Column:
    """The number of the part that a time lies in, earliest first; rows without a time are in the last."""
    us = F.unix_micros(time_col)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(us < cuts[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(cuts))


def stage_whole(df: DataFrame, path: str, files: int) -> None:
    """Land ``df``, dealt over ``files`` tasks, as exactly that many files, empty ones where it has too few rows.

    A trigger of so many files then takes all of it and nothing else.
    """
    df.write.option("maxRecordsPerFile", 0).parquet(f"{path}/rows")
    found = [n for n in storage.names(f"{path}/rows") if not n.startswith("_")]
    for k in range(len(found), files):
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/empty-{k}")


def read_stream(spark: SparkSession, path: str, ddl: str, max_files: int = 2, fmt: str = "json") -> DataFrame:
    return (spark.readStream.schema(ddl).format(fmt).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").load(path))


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 2, fmt: str = "json") -> DataFrame:
    return read_stream(spark, path, RAW_EVENTS_DDL, max_files, fmt)


def idempotent_writer(sink: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rows with their ``batch_id``, committed once whatever is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log_writer(BatchLog(batch.sparkSession, sink))(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    return write


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      timeout_s: float | None = None):
    """Process everything available (several triggers), then stop; returns the finished query."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(idempotent_writer(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()  # the sink is partial: say so instead of returning
        raise TimeoutError(f"stream not finished after {timeout_s} s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Queries that are started inside keep their state in ``n`` partitions (None: as many as the session shuffles to)."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    if n is not None:
        spark.conf.set(key, str(n))
    try:
        yield  # a query takes the setting when it is started
    finally:
        spark.conf.set(key, was)


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """The committed rows of a sink, with ``batch_id``."""
    rows = BatchLog(spark, sink).read("rows")
    if rows is None:
        raise ValueError(f"no committed batch in {sink}")
    return rows


class StreamRun:
    """Fresh folders (input / checkpoint / sink) under the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.root = scratch_dir(spark, name)
        self.input = f"{self.root}/input"
        self.checkpoint = f"{self.root}/checkpoint"
        self.sink = f"{self.root}/sink"
