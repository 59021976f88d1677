"""Near-duplicate vectors: spherical k-means cells, blocked cosines inside them.

Equal vectors are one class with a count, so a vector that a third of the
rows share costs one row.  Centroids are fitted on a bounded sample (they only
divide the work); every vector is assigned.  A pair with cosine >= t that two
cells separate is not lost: if y is nearest to centroid b and x to centroid a,
the hyperplane between a and b separates them, so the angle of x to that
hyperplane is at most acos(t).  x is therefore also shown to each cell b with
(x.a - x.b) / |a - b| <= sin(acos(t)), which makes the search exact.

How far that spreads depends on the data: in vectors without clusters nearly
every cell is near, so the number of cells is the largest for which a vector
of the sample is shown to ``MAX_SHOWN`` cells on average.

The vectors of a cell are written once, in their own precision, to files of the
shared folder that workers map, and are cut into blocks; what Spark shuffles
are pairs of blocks as names and row ranges, so disk grows with the rows and
not with pairs of blocks, and no task holds more than two blocks whatever the
cell's size.  Within a pair of blocks only link counts and a spanning forest
are kept, never the pairs.

Defined results: null, empty, zero or non-finite vectors (or with null
components) link with nothing; vectors link only with vectors of their length.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from relaysync.llm.common import own_columns, posix_dir, read, shuffle_width, staged, write_atomic
from relaysync.llm.components import components

FIT_SAMPLE = 20_000
BLOCK = 8192
MAX_SHOWN = 2.5
SLACK = 1e-6
FILE_BYTES = 32 << 20
SEGMENTS_DDL = "dim int, cell int, file string, total long, start long, rows long, homes long"


def fit_centroids(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors; the start is farthest-first on a stride."""
    k = max(1, min(k, len(vectors)))
    c = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (vectors @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, cell, vectors)
        norm = np.linalg.norm(s, axis=1)
        c[norm > 0] = s[norm > 0] / norm[norm > 0, None]
    return np.unique(c, axis=0)


def _unit(column) -> np.ndarray:
    """Unit vectors; a power of two (exact) brings the largest component near 1 first, so no square overflows or vanishes."""
    x = np.array(column.tolist() if isinstance(column, pd.Series) else column, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near_cells(x: np.ndarray, centroids: np.ndarray, reach: float):
    """(home cell, mask of the cells a partner of each unit vector may live in)."""
    dot = x @ centroids.T
    home, each = dot.argmax(axis=1), np.arange(len(dot))
    gap = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-30))
    near = (dot[each, home][:, None] - dot) <= reach * gap[home] + SLACK
    near[each, home] = True
    return home, near


def choose_centroids(sample: np.ndarray, reach: float, max_shown: float = MAX_SHOWN, most: int = 256) -> np.ndarray:
    """The most cells, by powers of two, for which a vector is shown to ``max_shown`` of them on average."""
    best, k = fit_centroids(sample, 1), 2
    while k <= min(most, len(sample)):
        c = fit_centroids(sample, k)
        if _near_cells(sample, c, reach)[1].sum() > max_shown * len(sample):
            break
        best, k = c, 2 * k
    return best


def _cells_map(folder: str, centroids: dict, reach: float, dtype: str, block: int):
    """Each class in its home cell and in those a partner may live in, as files in order of cells, home rows first.

    A file holds the ids, the counts and the vectors of its rows; a segment is
    a range of at most ``block`` rows of one cell, ``homes`` of them at home.
    """
    def flush(dim: int, parts: list) -> pd.DataFrame:
        cell, away, ids, n, v = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((away, cell))
        cell, away = cell[order], away[order]
        name = f"{uuid.uuid4().hex}.bin"
        write_atomic(os.path.join(folder, name), b"".join(x[order].tobytes() for x in (ids, n, v)))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out = [(dim, int(cell[lo]), name, len(cell), k, min(block, hi - k), int((~away[k: min(hi, k + block)]).sum()))
               for lo, hi in zip(starts, np.r_[starts[1:], len(cell)]) for k in range(lo, hi, block)]
        return pd.DataFrame(out, columns=["dim", "cell", "file", "total", "start", "rows", "homes"])

    def run(frames):
        waiting: dict[int, list] = {}
        size: dict[int, int] = {}
        for f in frames:
            for dim, g in f.groupby("dim"):
                dim = int(dim)
                for lo in range(0, len(g), 2048):
                    part = g.iloc[lo: lo + 2048]
                    v = np.array(part["v"].tolist(), dtype=dtype)
                    home, near = _near_cells(_unit(v), centroids[dim], reach)
                    i, cell = np.nonzero(near)
                    waiting.setdefault(dim, []).append((cell, cell != home[i], part["id"].to_numpy(np.int64)[i], part["n"].to_numpy(np.int64)[i], v[i]))
                    size[dim] = size.get(dim, 0) + v[i].nbytes
                    if sum(size.values()) >= FILE_BYTES:
                        for d, parts in waiting.items():
                            yield flush(d, parts)
                        waiting, size = {}, {}
        for d, parts in waiting.items():
            yield flush(d, parts)

    return run


def _stars(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The components of a block of links, each as its members and the smallest of them."""
    out, open_rows = [], hit.any(axis=1)
    while open_rows.any():
        r = np.zeros(len(rows), dtype=bool)
        r[open_rows.argmax()] = True
        c = np.zeros(len(cols), dtype=bool)
        new = r
        while new.any():
            added = hit[new].any(axis=0) & ~c
            c |= added
            new = hit[:, added].any(axis=1) & ~r
            r |= new
        open_rows &= ~r
        members = np.union1d(rows[r], cols[c])
        out.append((members[1:], int(members[0])))
    return out


def _block(folder: str, dim: int, dtype: str, parts, only_home: bool):
    """(ids, counts, unit vectors) of a block's segments."""
    out = []
    for p in parts:
        total, start, rows = p["total"], p["start"], p["homes"] if only_home else p["rows"]
        if rows:
            path = os.path.join(folder, p["file"])
            ids, n = (np.memmap(path, np.int64, "r", offset=at + 8 * start, shape=(rows,)) for at in (0, 8 * total))
            v = np.memmap(path, dtype, "r", offset=16 * total + start * dim * np.dtype(dtype).itemsize, shape=(rows, dim))
            out.append((np.array(ids), np.array(n), _unit(v)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pairs_map(folder: str, threshold: float, dtype: str):
    """(query block, other block) pairs of cells: link counts and a spanning forest.

    Single precision finds the pairs near the threshold, with a slack above its
    rounding error, which grows with the dimension; double precision decides.
    """
    def pair(q, d) -> pd.DataFrame:
        (qi_all, _, own_all), (di, dn, other) = q, d
        found, other32 = [], other.astype(np.float32)
        slack = max(1e-5, (other.shape[1] + 4) * float(np.finfo(np.float32).eps))
        for lo in range(0, len(qi_all), 1024):
            own, qi = own_all[lo: lo + 1024], qi_all[lo: lo + 1024]
            a, b = np.nonzero(own.astype(np.float32) @ other32.T >= threshold - slack)
            a, b = a[qi[a] != di[b]], b[qi[a] != di[b]]
            keep = np.concatenate([np.einsum("ij,ij->i", own[a[k: k + 65536]], other[b[k: k + 65536]]) >= threshold
                                   for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            links = np.bincount(a, dn[b], minlength=len(qi)).astype(np.int64)
            rows, cols = np.unique(a), np.unique(b)
            hit = np.zeros((len(rows), len(cols)), dtype=bool)
            hit[np.searchsorted(rows, a), np.searchsorted(cols, b)] = True
            found += [(m, np.full(len(m), r), np.zeros(len(m), np.int64)) for m, r in _stars(hit, qi[rows], di[cols])]
            found.append((qi[rows], qi[rows], links[rows]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("u", "v", "links"), cols))).astype("int64")

    def run(frames):
        for f in frames:
            for dim, q, d in zip(f["dim"], f["q"], f["d"]):
                yield pair(_block(folder, int(dim), dtype, q, True), _block(folder, int(dim), dtype, d, False))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", column: str = "embedding",
                    fit_sample: int = FIT_SAMPLE, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    ``fit_sample`` bounds the vectors the centroids are fitted on.  Ids are
    longs; null ids stay as rows that link with nothing.
    """
    spark = vectors.sparkSession
    rows = own_columns(vectors, id_col, column).toDF("id", "v")
    good = (F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("v", lambda x: x != 0))
    # single-precision vectors stay so, every other type is read as double; adding zero makes -0 a zero
    kind = "float" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "double"
    dtype = "f4" if kind == "float" else "f8"
    flat = F.transform("v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = rows.withColumn("v", F.when(good, flat))
    # equal vectors are known by two 64-bit lanes once their classes are formed
    lanes = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    classes = staged(rows.filter("v is not null").groupBy("v")
                     .agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("v")), "vec-classes")
    reach, centroids = math.sin(math.acos(threshold)), {}
    for r in classes.select("dim").distinct().toLocalIterator():
        sample = _unit(classes.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id")).limit(fit_sample).select("v").toPandas()["v"])
        centroids[r["dim"]] = fit_centroids(sample, cells) if cells else choose_centroids(sample, reach)
    folder = posix_dir(spark, "vec-cells")
    segments = staged(classes.mapInPandas(_cells_map(folder, centroids, reach, dtype, block), SEGMENTS_DDL), "vec-segments")
    # blocks are runs of segments: their number follows each cell's rows
    before = F.sum("rows").over(Window.partitionBy("dim", "cell").orderBy("file", "start")) - F.col("rows")
    blocks = (segments.withColumn("b", F.floor(before / block)).groupBy("dim", "cell", "b")
              .agg(F.collect_list(F.struct("file", "total", "start", "rows", "homes")).alias("d"), F.sum("homes").alias("homes")))
    pairs = (blocks.filter("homes > 0").select("dim", "cell", F.col("d").alias("q"))
             .join(blocks.select("dim", "cell", "d"), ["dim", "cell"]).select("dim", "q", "d").repartition(shuffle_width(spark)))
    found = staged(pairs.mapInPandas(_pairs_map(folder, threshold, dtype), "u long, v long, links long"), "vec-links")
    group = components(found.filter("u <> v").select("u", "v"), "vec-components")
    links = found.filter("links > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    known = (classes.select(F.col("id").alias("cid"), "n", *lanes).join(links, "cid", "left")
             .join(group.withColumnRenamed("node", "cid"), "cid", "left")
             .select("k1", "k2", F.coalesce("component", "cid").alias("component"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    lone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.filter("v is not null").select("id", *lanes).join(known, ["k1", "k2"]).select("id", "n_links", F.col("component").alias("component_id"))
    return (joined.union(lone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
            .withColumnRenamed("id", id_col))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at cosine 0.95."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)
