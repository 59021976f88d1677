"""Packed columns for shuffles, and sorted hash arrays in mapped files.

A set or table of 64-bit hashes that grows with the corpus is cut into
buckets, which are ranges of the hash.  A bucket is reduced by one task and
written as one file of sorted arrays in the shared folder; workers map the
files read-only, so a lookup touches pages, not a copy in memory.

The driver writes a list of a level's buckets once all are written.  A worker
that does not find the list, or a file of it, raises: a folder that is not
mounted there is never taken for an empty level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.common import write_atomic
from relaysync.llm.tokens import join_hash, mix

BLOB = "bucket int, blob binary"


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
                           names=["bucket", "blob"])


def held_blobs(batches) -> dict[int, list[bytes]]:
    """All packed rows of a partition by bucket (a partition is one bucket)."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(b, []).append(x)
    return held


def _set_parts(buckets: int):
    def run(batches):
        for batch in batches:
            keys = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if len(keys):
                yield blob_batch(list(by_bucket([keys], [np.ones(len(keys), dtype=np.uint64)], buckets)))

    return run


def _set_files(path: str):
    def run(batches):
        held = held_blobs(batches)
        for b in list(held):
            save_arrays(f"{path}/1-{b}", [np.unique(np.concatenate([unpack(x)[0] for x in held.pop(b)]))])
            yield blob_batch([(b, b"")])

    return run


def write_set(longs: DataFrame, path: str, buckets: int) -> None:
    """A one-column table of longs without nulls as sorted arrays of ``mix(value)``, level 1 of ``path``."""
    write_level(longs.mapInArrow(_set_parts(buckets), BLOB).repartitionById(buckets, F.col("bucket"))
                .mapInArrow(_set_files(path), BLOB), path, 1)


def write_level(written: DataFrame, path: str, level: int) -> None:
    """Run the tasks that write a level's files (one row a bucket), then list its buckets."""
    list_buckets(path, level, [r.bucket for r in written.select("bucket").collect()])


def list_buckets(path: str, level: int, buckets: list[int]) -> None:
    write_atomic(f"{path}/{level}.list", np.unique(np.array(buckets, dtype=np.int64)).tobytes())


def pack(cols: list[np.ndarray]) -> bytes:
    """Columns of equal length, each in the smallest unsigned type that holds it."""
    out = [np.array([len(cols[0]), len(cols)], dtype=np.uint64).tobytes()]
    for c in cols:
        t = np.min_scalar_type(int(c.max()) if len(c) else 0)
        out += [t.char.encode(), c.astype(t).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(data, dtype=np.uint64, count=2))
    at, cols = 16, []
    for _ in range(k):
        t = np.dtype(chr(data[at]))
        cols.append(np.frombuffer(data, dtype=t, count=n, offset=at + 1).astype(np.uint64))
        at += 1 + n * t.itemsize
    return cols


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash: monotone, so sorted keys are sorted buckets."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    h = words[0]
    for w in words[1:]:
        h = join_hash(h, w)
    return h


def summed(words: list[np.ndarray], values: list[np.ndarray]):
    """Rows of equal words added up, in key order: (key, words, values)."""
    key = gram_key(words)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], [w[order][first] for w in words],
            [np.add.reduceat(v[order], first) if len(first) else v for v in values])


def by_bucket(words, values, buckets: int):
    """(bucket, packed rows) of equal words added up."""
    key, words, values = summed(words, values)
    b = bucket_of(key, buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cut, [*cut[1:], len(b)]):
        yield int(b[lo]), pack([c[lo:hi] for c in (*words, *values)])


def grouped(batches, keys: int):
    """(key, rows) of equal leading columns in a sorted partition; rows are lists of the other values."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield now, rows


def save_arrays(path: str, cols: list[np.ndarray]) -> None:
    """Length, column count, then per column its type and aligned data; the first is sorted."""
    out = [np.array([len(cols[0]), len(cols)], dtype=np.uint64).tobytes()]
    for c in cols:
        t = np.min_scalar_type(int(c.max()) if len(c) else 0) if out[1:] else np.dtype(np.uint64)
        data = c.astype(t).tobytes()
        out += [t.char.encode().ljust(8), data, b"\0" * (-len(data) % 8)]
    write_atomic(path, b"".join(out))


def map_arrays(path: str) -> list[np.ndarray]:
    """Columns of a file as read-only views of mapped pages."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    n, k = (int(x) for x in raw[:16].view(np.uint64))
    at, cols = 16, []
    for _ in range(k):
        t = np.dtype(chr(raw[at]))
        cols.append(raw[at + 8: at + 8 + n * t.itemsize].view(t))
        at += 8 + n * t.itemsize + (-n * t.itemsize) % 8
    return cols


class Level:
    """The mapped files of one order; raises where the listed files are not there."""

    def __init__(self, path: str, level: int, buckets: int):
        self.path, self.level, self.buckets, self.files = path, level, buckets, {}
        with open(f"{path}/{level}.list", "rb") as f:
            self.listed = frozenset(np.frombuffer(f.read(), dtype=np.int64).tolist())

    def _open(self, bucket: int) -> list[np.ndarray]:
        return map_arrays(f"{self.path}/{self.level}-{bucket}") if bucket in self.listed else []

    def _find(self, keys: np.ndarray, ascending: bool = False):
        """Per bucket that holds any of the keys: (positions in keys, its columns, positions in them)."""
        order = np.arange(len(keys)) if ascending else np.argsort(keys)
        q = keys[order]
        b = bucket_of(q, self.buckets)
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        for lo, hi in zip(cut, [*cut[1:], len(b)]):
            n = int(b[lo])
            if n not in self.files:
                self.files[n] = self._open(n)
            cols = self.files[n]
            if cols and len(cols[0]):
                at, hit = self._at(n, cols, q[lo:hi])
                yield order[lo:hi][hit], cols, at[hit]

    def _at(self, bucket: int, cols: list[np.ndarray], keys: np.ndarray):
        """(row of each sorted key in a bucket's columns, whether it is there)."""
        at = np.minimum(np.searchsorted(cols[0], keys), len(cols[0]) - 1)
        return at, cols[0][at] == keys

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are in the first column."""
        out = np.zeros(len(keys), dtype=bool)
        for where, _, _ in self._find(keys):
            out[where] = True
        return out

    def values(self, keys: np.ndarray, column: int = 1) -> np.ndarray:
        """A column, as 64-bit unsigned integers, at each key; 0 where the key is unknown."""
        out = np.zeros(len(keys), dtype=np.uint64)
        for where, cols, at in self._find(keys):
            out[where] = cols[column][at]
        return out

    def holds(self, keys: np.ndarray, values: np.ndarray, column: int = 1) -> np.ndarray:
        """Whether a row of each key has the given value in a column; a key may have several rows."""
        out = np.zeros(len(keys), dtype=bool)
        for where, cols, at in self._find(keys):
            while len(where):
                out[where] |= cols[column][at] == values[where]
                at = at + 1
                more = at < len(cols[0])
                where, at = where[more], at[more]
                more = cols[0][at] == keys[where]
                where, at = where[more], at[more]
        return out

    def look_up(self, keys: np.ndarray, columns: list[int]) -> list[np.ndarray]:
        """The given columns, as doubles, at each key; 0 where the key is unknown."""
        q, back = np.unique(keys, return_inverse=True)
        found = [np.zeros(len(q), dtype=np.float64) for _ in columns]
        for where, cols, at in self._find(q):
            for f, c in zip(found, columns):
                f[where] = cols[c][at]
        return [f[back] for f in found]
