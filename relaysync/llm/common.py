"""Shared helpers: staged tables, the shared folder, bounded reads."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.session import shared_root


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path (URI) under the shared folder; nothing is created."""
    return f"{shared_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def posix_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that tasks open as files.

    Needs a shared folder that is mounted on every machine (a ``file:`` URI
    or a plain path): memory mapping has no other way.
    """
    uri = urlparse(fresh(spark, name))
    if uri.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a mounted folder: "
                         f"workers map files in it, and {uri.scheme}: cannot be mapped")
    path = unquote(uri.path)
    os.makedirs(path, exist_ok=True)
    return path


def write_atomic(path: str, data: bytes) -> None:
    """Complete file or none, also when two attempts of a task overlap."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage)."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def text_buffer(column: pa.Array):
    """(bytes, int64 offsets) of a string column; null is the empty text."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(off, max_bytes: int):
    """Row ranges (lo, hi) of at most ``max_bytes`` bytes, or of one row."""
    import numpy as np

    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so others can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])
