"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables.

Per table a unit vector is padded to a power of two, sent through three rounds
of random signs and a fast Hadamard transform (a pseudo-rotation), and hashed
to its nearest signed axis, one of twice the dimension.  Every row stands in
one cell of each table; a query looks into the ``probes`` cells per table
whose axes are nearest to it.  Candidates are reranked by their exact cosine.

A vector that many rows hold is kept ``k + 1`` times, by its smallest ids:
further copies can be nobody's neighbour.  Equal queries are searched once.
A cell with many vectors, or many queries, is cut into blocks by a hash, and a
pair of blocks is one group of bounded size, so no cell needs a cap.  Only the
best ``k + 1`` of a pair of blocks leave it.  A query whose cells hold fewer
than it should return is compared with all rows, block by block.

Recall depends on the data: vectors here are noise around a few centres (the
nearest of 51,282 rows has a cosine of 0.49 on average), so a query must look
at many cells.  Measured recall at the parameters below: see README.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, and rows without id take no part; vectors are compared
only with vectors of their length; ties go to the smaller id; repeated rows
(same id, same vector) are one; of several vectors of one id each is a row,
and none is its own query's neighbour.  Lengths are scaled by the largest
component, so no norm overflows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaysync.llm.common import read, shuffle_width, staged

TABLES = 6
#: Of the cells of a table, a query looks into this share.
PROBED = 1 / 8
BLOCK = 8192
QUERY_BLOCK = 1024
SEED = 20


def unit_rows(column) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of unit rows."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([SEED, table, n]).choice([-1.0, 1.0], size=(3, n))
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for s in signs:
        x = _hadamard(x * s)
    return x


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: 2 * i for axis i, 2 * i + 1 for its opposite."""
    both = np.empty((len(y), 2 * y.shape[1]))
    both[:, 0::2], both[:, 1::2] = y, -y
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _cells(tables: int, probed: float | None):
    """Rows (dim, id, v) with each table's cell (index) or cells (queries: a share ``probed``)."""
    def run(frames):
        for f in frames:
            for dim, g in f.groupby("dim"):
                for lo in range(0, len(g), 1024):
                    part = g.iloc[lo: lo + 1024]
                    x = unit_rows(part["v"])
                    for t in range(tables):
                        y = rotated(x, t)
                        probes = 1 if probed is None else max(1, round(2 * y.shape[1] * probed))
                        cell = axes(y, probes)
                        yield pd.DataFrame({"dim": np.int32(dim), "tab": np.int32(t), "cell": cell.ravel().astype(np.int32),
                                            "id": np.repeat(part["id"].to_numpy(), probes), "v": np.repeat(part["v"].to_numpy(), probes)})

    return run


def _best_of_blocks(k: int):
    """The ``k`` nearest rows of each query of a pair of blocks, by the exact cosine."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, x = unit_rows(queries["v"]), unit_rows(rows["v"])
        ids, qid, out = rows["id"].to_numpy(), queries["id"].to_numpy(), []
        top = min(k, len(x))
        for lo in range(0, len(q), 128):
            s = q[lo: lo + 128] @ x.T
            # what rounding of the product may hide is kept, then measured alone: equal vectors get equal scores
            floor = np.partition(s, len(x) - top, axis=1)[:, len(x) - top] - 1e-9
            a, b = np.nonzero(s >= floor[:, None])
            exact = (q[lo + a] * x[b]).sum(axis=1)
            order = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < top
            out.append(pd.DataFrame({"qid": qid[lo + a[keep]], "id": ids[b[keep]], "score": exact[keep]}))
        return pd.concat(out)

    return run


def _paired(probes: DataFrame, index: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """The best ``k`` rows (qid, id, score) of each query in each pair of blocks of a cell that it looks into."""
    cell = ["dim", "tab", "cell"]
    size = (index.groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("blocks"))
            .join(probes.groupBy(*cell).agg(F.ceil(F.count("*") / query_block).alias("qblocks")), cell))
    size = staged(size, "cells")

    def dealt(df, own, others):
        part = F.pmod(F.xxhash64("id", "tab"), F.col(own)).alias(own[:-1])
        return (df.join(size, cell).select("*", part).select("*", F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[:-1]))
                .select(*cell, "block", "qblock", "id", "v"))

    group = [*cell, "block", "qblock"]
    found = (dealt(probes, "qblocks", "blocks").groupBy(*group).cogroup(dealt(index, "blocks", "qblocks").groupBy(*group))
             .applyInPandas(_best_of_blocks(k), "qid long, id long, score double"))
    return found


def _first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group (cut before the shuffle too)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", column: str = "embedding", tables: int = TABLES,
            probed: float = PROBED, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of ``queries``, itself (by id) left out."""
    def clean(df):
        v = F.col(f"`{column}`")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
                .where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).distinct())

    rows = staged(_first(clean(vectors), ["v"], [F.col("id")], k + 1), "neighbour-rows")
    asked = staged(clean(queries), "neighbour-queries")
    # equal queries are searched once, under a number fixed by writing
    single = staged(asked.select("dim", "v").distinct().withColumn("id", F.monotonically_increasing_id()), "neighbour-single")
    n = shuffle_width(vectors.sparkSession)
    cells = "dim int, tab int, cell int, id long, v " + dict(rows.dtypes)["v"]
    index = rows.select("dim", "id", "v").repartition(n, "id").mapInPandas(_cells(tables, None), cells)
    probes = single.select("dim", "id", "v").repartition(n, "id").mapInPandas(_cells(tables, probed), cells)
    by, best = ["qid"], [F.col("score").desc(), F.col("id")]
    found = staged(_first(_paired(probes, index, k + 1, block, query_block).distinct(), by, best, k + 1), "neighbour-found")
    total = rows.groupBy("dim").agg(F.count("*").alias("total"))
    got = found.groupBy(F.col("qid").alias("id")).agg(F.count("*").alias("got"))
    everywhere = [F.lit(0).alias("tab"), F.lit(0).alias("cell"), "id", "v"]
    short = staged(single.join(total, "dim").join(got, "id", "left")
                   .where(F.coalesce("got", F.lit(0)) < F.least("total", F.lit(k + 1))).select("dim", *everywhere), "neighbour-short")
    if not short.isEmpty():
        exact = _paired(short, rows.select("dim", *everywhere), k + 1, block, query_block)
        found = staged(_first(found.union(exact).distinct(), by, best, k + 1), "neighbour-found")
    theirs = asked.withColumnRenamed("id", "query_id").join(single.select("v", F.col("id").alias("qid")), "v").select("query_id", "qid")
    rank = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(*best)).alias("rank")
    return (theirs.join(found, "qid").where("id <> query_id").select("query_id", rank, F.col("id").alias("vec_id"), "score")
            .where(F.col("rank") <= k))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id 50 divides, among all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
