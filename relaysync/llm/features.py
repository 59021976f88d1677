"""Sampling labelled rows, and the pieces both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.common import fold


def marked_rows(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of all labelled ids outside fold 0 of 5."""
    return (labels.select(id_col, F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(id_col, 5) != 0))
            .groupBy(id_col).agg(F.max("y").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", column: str = "text"):
    """(texts, labels, langs) of at most ``per_class`` rows of each label, outside fold 0 of 5.

    Rows are taken in the order of a hash of their id, so the sample is the
    same in every run and blind to where rows stand.  This bounded sample is
    all that reaches the driver.
    """
    langs = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    marked = marked_rows(labels, label, id_col)
    taken = None
    for y in (0, 1):
        some = marked.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        taken = some if taken is None else taken.union(some)
    # at most 2 * per_class ids: a proven bound
    table = (docs.select(id_col, F.coalesce(F.col(column), F.lit("")).alias("text"), langs)
             .join(F.broadcast(taken), id_col).select("text", "y", "lang").toArrow())
    table = table.sort_by([("text", "ascending"), ("y", "ascending")])
    return table.column("text"), np.array(table.column("y").to_pylist(), dtype=np.int64), table.column("lang").to_pylist()


def label_shares(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """Share of label 1 among the labelled rows outside fold 0 of 5 (0.5 without any)."""
    r = (labels.filter(F.col(label).isin(0, 1) & (fold(id_col, 5) != 0)).agg(F.avg(F.col(label).cast("double")))).first()[0]
    return 0.5 if r is None else float(r)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam's update for a dict of parameter arrays."""

    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)
