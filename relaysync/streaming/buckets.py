"""A table in hash buckets of one key, replaced bucket by bucket (A7, E2, E3 on a stream).

A version of the table is a manifest: for each bucket the folders that hold
its rows.  A change writes new folders for the buckets it touches and then the
next version's manifest; all other buckets keep their folders unread.  Readers
take the highest version, so they see the table before a change or after it,
never between.  The versions before the last two, and what no kept version
names, are removed.

Inside a bucket nothing depends on one task: rows are rebalanced by size when
written, so a bucket that one hot key fills becomes several files, and reading
it for a join is split by adaptive execution like any table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaysync import storage

KEEP = 2
FOLDERS = 16
BUCKET = "_bucket"


class BucketTable:
    """``{root}/data/<id>/_bucket=<b>`` and ``{root}/versions/<version>.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, buckets: int) -> "BucketTable":
        """A new table of ``rows``; an existing one is left as it is."""
        table = cls(rows.sparkSession, root)
        if not storage.names(f"{table.root}/versions"):
            first = {"version": 0, "batch": -1, "key": key, "buckets": buckets, "schema": rows.schema.json(), "paths": {}}
            table._commit({**first, "paths": table._write(rows, first)})
        return table

    def _names(self) -> list[str]:
        return storage.names(f"{self.root}/versions")

    def current(self) -> dict:
        return storage.get(f"{self.root}/versions/{self._names()[-1]}")

    @staticmethod
    def _schema(now: dict) -> StructType:
        return StructType.fromJson(json.loads(now["schema"]))

    def bucket(self, key: Column | None = None, now: dict | None = None) -> Column:
        now = now or self.current()
        return F.pmod(F.xxhash64(F.col(now["key"]) if key is None else key), F.lit(now["buckets"])).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of the keys (first column of each table): at most as many numbers as the table has buckets."""
        now, found = self.current(), None
        for k in keys:
            b = k.select(self.bucket(F.col(f"`{k.columns[0]}`"), now).alias("b")).distinct()
            found = b if found is None else found.union(b)
        return sorted({r.b for r in found.distinct().toLocalIterator()})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it: other buckets' files are not opened."""
        now = self.current()
        wanted = now["paths"] if buckets is None else {str(b) for b in buckets}
        paths = [p for b, folders in now["paths"].items() if b in wanted for p in folders]
        schema = self._schema(now)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, now: dict) -> dict[str, list[str]]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        marked = rows.select(*[f.name for f in self._schema(now)], self.bucket(now=now).alias(BUCKET))
        even = rows.sparkSession.sql(f"SELECT /*+ REBALANCE({BUCKET}) */ * FROM {{t}}", t=marked)
        even.sortWithinPartitions(BUCKET, now["key"]).write.partitionBy(BUCKET).parquet(path)
        found = [n for n in storage.names(path) if n.startswith(f"{BUCKET}=")]
        return {n.split("=")[1]: [f"{path}/{n}"] for n in found}

    def _commit(self, now: dict) -> None:
        storage.put(f"{self.root}/versions/{now['version']:012d}.json", now)
        old, kept = self._names()[:-KEEP], self._names()[-KEEP:]
        used = {p for n in kept for ps in storage.get(f"{self.root}/versions/{n}")["paths"].values() for p in ps}
        for n in old:
            gone = [p for ps in storage.get(f"{self.root}/versions/{n}")["paths"].values() for p in ps if p not in used]
            storage.remove(f"{self.root}/versions/{n}")
            for p in gone:
                storage.remove(p)
        # one query writes the table: a folder that no kept version names was left by an attempt that died, or is empty
        folders = {p.rsplit("/", 2)[1] for p in used}
        for name in storage.names(f"{self.root}/data"):
            if name not in folders:
                storage.remove(f"{self.root}/data/{name}")

    def done(self, batch_id: int) -> bool:
        """Whether a change of this batch, or a later one, is in the table."""
        return self.current()["batch"] >= batch_id

    def replace(self, rows: DataFrame, buckets: list[int], batch_id: int) -> None:
        """The given buckets become ``rows`` (which hold keys of these buckets only); a batch that is done is left out."""
        now = self.current()
        if now["batch"] < batch_id:
            paths = {b: p for b, p in now["paths"].items() if int(b) not in set(buckets)}
            self._commit({**now, "version": now["version"] + 1, "batch": batch_id, "paths": {**paths, **self._write(rows, now)}})

    def append(self, rows: DataFrame, batch_id: int, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Add rows; a bucket that would have more than ``FOLDERS`` folders is put together, reduced by ``fold``."""
        now = self.current()
        if now["batch"] < batch_id:
            new = self._write(rows, now)
            paths = {b: now["paths"].get(b, []) + new.get(b, []) for b in {*now["paths"], *new}}
            many = [b for b, p in paths.items() if len(p) > FOLDERS]
            if many:
                together = self.spark.read.schema(self._schema(now)).parquet(*[p for b in many for p in paths[b]])
                paths = {b: p for b, p in paths.items() if b not in many} | self._write(fold(together), now)
            self._commit({**now, "version": now["version"] + 1, "batch": batch_id, "paths": paths})
