"""Histogram sort into shards of near equal bytes, built-in functions only.

The sort key is a 64-bit hash of the row, so no range of it is hot.  Splitters
are found by counting: exact bytes below each candidate boundary, over all
partitions, first at 4,096 even boundaries of the key space, then at 4,096
boundaries inside each cell that holds an open splitter, until every splitter
is within tolerance or its cell cannot be divided.  Each round is one
aggregation, whose result has at most 4,096 rows per open splitter.  Rows
then move once.  Their slots need no shard-wide sort: cells of the first
histogram, cut at the splitters, know how many rows lie before them.

Defined results: a null text has no bytes; an empty table gives no rows;
rows equal in id and text have the same key and stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaysync.llm.common import own_columns, read, staged

BITS = 12
TOP = 60  # bits of a key: a whole number of rounds


def _key(id_col: str, column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(column)), 64 - TOP)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """Shard s takes keys in [splitter s-1, splitter s); ``keys`` has key and size.

    A splitter is accepted once the bytes below it are within ``tolerance`` of
    a shard's share from the ideal cut.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if shards < 2:
        return []
    goals = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    # per goal: (first key of the open range, bytes below it)
    open_at = {g: (0, 0.0) for g in range(len(goals))}
    done: dict[int, int] = {}
    shift = TOP - BITS
    while open_at:
        prefixes = sorted({lo >> (shift + BITS) for lo, _ in open_at.values()})
        cell = F.shiftright("key", shift)
        counted = (keys.filter(F.shiftright("key", shift + BITS).isin(prefixes))
                   .groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")).orderBy("cell").collect())
        for g, (lo, below) in list(open_at.items()):
            rows = [r for r in counted if r["cell"] >> BITS == lo >> (shift + BITS)]
            at, sum_below, nxt = lo, below, None
            for r in rows:
                if sum_below + r["size"] > goals[g]:
                    nxt = r
                    break
                sum_below += r["size"]
                at = (r["cell"] + 1) << shift
            if nxt is None:
                done[g] = at
            else:
                start, after = nxt["cell"] << shift, sum_below + nxt["size"]
                if goals[g] - sum_below <= slack or shift == 0:
                    close = goals[g] - sum_below <= after - goals[g]
                    done[g] = start if close else (nxt["cell"] + 1) << shift
                elif after - goals[g] <= slack:
                    done[g] = (nxt["cell"] + 1) << shift
                else:
                    open_at[g] = (start, sum_below)
                    continue
            del open_at[g]
        shift -= BITS
    return [done[g] for g in range(len(goals))]


def assign(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; shards hold near equal bytes."""
    own = own_columns(docs, id_col, column)
    text = F.coalesce(F.col(column), F.lit(""))
    keys = staged(own.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), _key(id_col, column).alias("key")), "shard-keys")
    cuts = find_splitters(keys, shards, tolerance)
    shard = F.lit(0)
    for s in cuts:
        shard = shard + F.when(F.col("key") >= s, 1).otherwise(0)
    placed = keys.withColumn("shard", shard).withColumn("cell", F.shiftright("key", TOP - BITS))
    # at most 4,096 cells and one more per splitter: a bounded table
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
             .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", id_col, "text_crc32")
    return (placed.withColumn("rank", F.row_number().over(inside) - 1)
            .join(F.broadcast(cells), ["shard", "cell"])
            .select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, tolerance: float = 0.001,
                 id_col: str = "doc_id", column: str = "text") -> None:
    """Write whole rows into ``path/shard=s``, in key order inside each file; one exchange of the rows."""
    keyed = docs.withColumn("_key", _key(id_col, column))
    text = F.coalesce(F.col(column), F.lit(""))
    keys = staged(keyed.select(F.col("_key").alias("key"), (F.octet_length(text) + 8).cast("long").alias("size")), "shard-keys")
    shard = F.lit(0)
    for s in find_splitters(keys, shards, tolerance):
        shard = shard + F.when(F.col("_key") >= s, 1).otherwise(0)
    (keyed.withColumn("shard", shard).repartitionByRange("_key").sortWithinPartitions("shard", "_key")
     .drop("_key").write.partitionBy("shard").parquet(path))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near equal bytes."""
    return (assign(read(spark, sf_dir, "documents"), 24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
