"""Outputs of micro-batches as logs that readers can trust.

A batch writes its outputs into a folder of its own and then one small
manifest.  Readers go by manifests only: a batch that is being written, or one
that died half way, is not there, all outputs of a batch appear together, and
a batch that is replayed after its manifest was written is not written again.

So that neither readers nor folders grow with the batches, every ``every``-th
batch puts the last ``every`` batches together into one segment, every
``every ** 2``-th that many, and so on: a reader opens less than ``every``
segments of each size, and a row is rewritten once for each size.  A segment
may be reduced (``folds``: rows and last batch -> rows) or just concatenated.
Segments that a larger one replaces stay until the next time, for readers
that have listed them, and are removed then, with what dead attempts left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from relaysync import storage

EVERY = 32


class BatchLog:
    """``{root}/data/<lo>-<hi>-<id>/<output>`` and ``{root}/commits/<lo>-<hi>-<id>.json``."""

    def __init__(self, spark: SparkSession, root: str, folds: dict[str, Callable[[DataFrame, int], DataFrame]] | None = None,
                 every: int = EVERY):
        self.spark, self.root, self.folds, self.every = spark, root.rstrip("/"), folds or {}, every

    def _segments(self) -> list[tuple[int, int, str]]:
        """(lo, hi, name) of every committed segment."""
        found = []
        for name in storage.names(f"{self.root}/commits"):
            name = name.removesuffix(".json")
            lo, hi, _ = name.split("-")
            found.append((int(lo), int(hi), name))
        return found

    def live(self, before: int | None = None, since: int = 0) -> list[tuple[int, int, str]]:
        """The segments that hold each committed batch below ``before`` once, the largest where several do;
        of them those that reach to ``since`` or beyond (a segment may begin earlier)."""
        chosen, at = [], 0
        for lo, hi, name in sorted(self._segments(), key=lambda s: (s[0], -s[1], s[2])):
            if lo >= at and (before is None or hi < before):
                chosen.append((lo, hi, name))
                at = hi + 1
        return [s for s in chosen if s[1] >= since]

    def last(self) -> int:
        """The last committed batch; -1 if there is none."""
        return max((hi for _, hi, _ in self._segments()), default=-1)

    def committed(self, batch_id: int) -> bool:
        return any(lo <= batch_id <= hi for lo, hi, _ in self._segments())

    def paths(self, output: str, before: int | None = None, since: int = 0) -> list[str]:
        manifests = [storage.get(f"{self.root}/commits/{name}.json") for _, _, name in self.live(before, since)]
        return [f"{self.root}/data/{m['folder']}/{output}" for m in manifests if output in m["outputs"]]

    def read(self, output: str, ddl: str | None = None, before: int | None = None, since: int = 0) -> DataFrame | None:
        """Committed rows of an output; without any, an empty table of ``ddl`` (None where that is not given)."""
        paths = self.paths(output, before, since)
        if not paths:
            return None if ddl is None else self.spark.createDataFrame([], ddl)
        reader = self.spark.read if ddl is None else self.spark.read.schema(ddl)
        return reader.parquet(*paths)

    @contextmanager
    def _segment(self, lo: int, hi: int):
        folder, outputs = f"{lo:012d}-{hi:012d}-{uuid.uuid4().hex}", []

        def write(output: str, rows: DataFrame) -> DataFrame:
            """Write an output of the batch; returns it as written."""
            path = f"{self.root}/data/{folder}/{output}"
            rows.write.parquet(path)
            outputs.append(output)
            return rows.sparkSession.read.schema(rows.schema).parquet(path)

        yield write
        storage.put(f"{self.root}/commits/{folder}.json", {"folder": folder, "outputs": outputs})

    @contextmanager
    def batch(self, batch_id: int):
        """``with log.batch(n) as write: write("name", rows)``; committed on leaving without an error."""
        with self._segment(batch_id, batch_id) as write:
            yield write
        size = self.every
        while (batch_id + 1) % (size * self.every) == 0:
            size *= self.every
        if (batch_id + 1) % size == 0:
            self._compact(batch_id + 1 - size, batch_id)

    def _compact(self, lo: int, hi: int) -> None:
        old = self._segments()
        manifests = [storage.get(f"{self.root}/commits/{name}.json") for _, _, name in self.live(hi + 1, lo)]
        by_output: dict[str, list[str]] = {}
        for m in manifests:
            for output in m["outputs"]:
                by_output.setdefault(output, []).append(f"{self.root}/data/{m['folder']}/{output}")
        with self._segment(lo, hi) as write:
            for output, paths in by_output.items():
                rows = self.spark.read.parquet(*paths)
                write(output, self.folds.get(output, lambda df, last: df)(rows, hi))
        # what an earlier compaction replaced, and folders of attempts that never committed
        for a, b, name in old:
            if any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in old):
                storage.remove(f"{self.root}/commits/{name}.json")
        kept = {name for _, _, name in self._segments()}
        for folder in storage.names(f"{self.root}/data"):
            if folder not in kept and int(folder.split("-")[1]) < hi:
                storage.remove(f"{self.root}/data/{folder}")


def log_writer(log: BatchLog, output: str = "rows") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one committed segment for each batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not log.committed(batch_id):
            with log.batch(batch_id) as put:
                put(output, batch)

    return write
