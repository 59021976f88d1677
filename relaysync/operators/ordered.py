"""Ordered work by key that does not depend on how many rows a key has.

A window over a key puts all rows of the key into one task.  Here the rows
are first cut into segments by a range partitioning over (key, order), so a
key that holds a third of all rows lies in many segments; windows run inside
(segment, key), and what earlier (or later) segments of the same key hold is
carried in.  A range boundary cuts at most one key, so at most two keys of a
segment lie in others too: the carried table has a few rows for each segment,
whatever the data, and is broadcast on that bound.

Keys must not be null, and (key, order) should be unique: rows that agree in
both stay in one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaysync.session import stage_table

SEGMENT = "_segment"


def segmented(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` in range segments of (keys, order), written once (a range cut is sampled, so it is fixed by writing)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_table(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                       .withColumn(SEGMENT, F.spark_partition_id()), name)


def _shared(seg: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that are first or last in a segment: all that can lie in several segments."""
    key = F.struct(*keys)
    edges = (seg.groupBy(SEGMENT).agg(F.min(key).alias("a"), F.max(key).alias("b"))
             .select(F.explode(F.array("a", "b")).alias("k")).select("k.*").distinct())
    # at most two keys a segment: a proven bound
    return seg.join(F.broadcast(edges), keys, "left_semi")


_FOLDS = {"sum": F.sum, "xor": F.bit_xor}


def _joined(kind: str, a: Column, b: Column) -> Column:
    b = F.coalesce(b, F.lit(0))
    return a + b if kind == "sum" else a.bitwiseXOR(b)


def running(seg: DataFrame, keys: list[str], order: list[Column], columns: dict[str, tuple[str, Column]],
            backward: bool = False) -> DataFrame:
    """Add running values of a ``segmented`` table, each row included.

    ``columns``: name -> (``sum`` or ``xor``, expression without nulls).
    ``backward`` runs from the end of each key instead of from its start.
    """
    w = Window.partitionBy(SEGMENT, *keys).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    if backward:
        w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        across = across.rowsBetween(1, Window.unboundedFollowing)
    else:
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        across = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = _shared(seg, keys).groupBy(SEGMENT, *keys).agg(
        *[_FOLDS[kind](e).alias(f"_t_{c}") for c, (kind, e) in columns.items()])
    carry = totals.select(SEGMENT, *keys, *[_FOLDS[kind](f"_t_{c}").over(across).alias(f"_c_{c}")
                                            for c, (kind, _) in columns.items()])
    local = seg.select("*", *[_FOLDS[kind](e).over(w).alias(c) for c, (kind, e) in columns.items()])
    return (local.join(F.broadcast(carry), [SEGMENT, *keys], "left")
            .select(*seg.columns, *[_joined(kind, F.col(c), F.col(f"_c_{c}")).alias(c)
                                    for c, (kind, _) in columns.items()]))


def lagged(seg: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Add the previous row's values by key (``columns``: source -> new name); null on a key's first row.

    The last row of a segment is carried into the key's next segment.
    """
    w = Window.partitionBy(SEGMENT, *keys).orderBy(*order)
    last = F.max_by(F.struct(*columns), F.struct(*[F.struct(o) for o in order]))
    ends = _shared(seg, keys).groupBy(SEGMENT, *keys).agg(last.alias("_last"))
    carry = ends.select(SEGMENT, *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SEGMENT)).alias("_before"))
    local = seg.withColumn("_prev", F.lag(F.struct(*columns)).over(w))
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return (local.join(F.broadcast(carry), [SEGMENT, *keys], "left")
            .select(*seg.columns, *[prev.getField(c).alias(new) for c, new in columns.items()]))
