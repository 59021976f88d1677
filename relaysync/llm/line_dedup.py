"""Removal of passages that repeat anywhere in the corpus, by content-defined chunks.

Units.  A rolling hash over pairs of line hashes cuts every text into chunks:
a chunk starts after two lines whose hash is 0 modulo ``divisor``, so equal
passages are cut alike wherever they stand.  A passage's first and last chunk
reach past its ends, and a short passage may hold no cut at all; so each
rolling window (two lines) is a unit as well, and a line of ``min_words``
words or more is one by itself.  Together, every repeated run of two lines is
found.

Passes.  (1) Count unit hashes, summed per task and per bucket; hashes that
occur twice go to sorted arrays in the shared folder.  (2) Scan again, emit
the lines of units that may repeat (equal ones of a task once) and compare
them per hash; of each distinct unit the first occurrence by (doc_id, text
hash, line) is kept.
(3) Scan again and drop lines that a repeated unit covers, unless it is the
kept one, wherever the dropped run has ``min_words`` words or more.  No text
is shuffled but that of repeated units, and a unit that a third of the
documents share is one row per task.

Defined results: null and empty texts stay as they are; empty lines belong to
the line before them, and units that differ in empty lines only are equal;
rows equal in id and text are one document; a null id orders first; different
units that share a hash keep one place each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaysync.llm.arrays import BLOB, Level, blob_batch, bucket_of, by_bucket, held_blobs, save_arrays, summed, unpack, write_level
from relaysync.llm.common import own_columns, posix_dir, read, shuffle_width, slices, staged, text_buffer
from relaysync.llm.tokens import SPACE_WORDS, join_hash, mix, span_hashes, word_spans

MIN_WORDS = 50
DIVISOR = 4
SLICE_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
HELD_BYTES = 32 << 20
_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False
_EMPTY_LINES = re.compile(rb"\n\n+")


def units(buf, off, min_words: int, divisor: int):
    """Lines (start, end, row, words) and units (hash, first line, line count)."""
    s, e, row = word_spans(buf, off, _LINES)
    h = span_hashes(buf, s, e, lower=False)
    begins = word_spans(buf, off, SPACE_WORDS)[0]
    words = np.searchsorted(begins, e) - np.searchsorted(begins, s)
    n = len(s)
    pair = np.flatnonzero(row[1:] == row[:-1]) if n else np.zeros(0, np.int64)
    roll = join_hash(h[pair], h[pair + 1])
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = row[1:] != row[:-1]
    cut = start.copy()
    cut[pair[roll % np.uint64(divisor) == 0] + 2] = True
    first = np.flatnonzero(cut[:n])
    size = np.diff(np.append(first, n))
    first, size = first[size > 2], size[size > 2]
    # a chunk's hash: position-weighted sum of its lines' hashes
    weight = mix(np.arange(1, (int(size.max()) if len(size) else 0) + 1, dtype=np.uint64))
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    chunk = (np.add.reduceat(mix(h[at] + weight[inside]), np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64))
    long = np.flatnonzero(words >= min_words)
    keys = np.concatenate([mix(chunk + size.astype(np.uint64)), mix(roll ^ np.uint64(0x2)), mix(h[long] ^ np.uint64(0x1))])
    at = np.concatenate([first, pair, long])
    count = np.concatenate([size, np.full(len(pair), 2), np.ones(len(long), dtype=np.int64)])
    return (s, e, row, words), (keys, at, count)


def _each_slice(batch, column: int, min_words: int, divisor: int):
    buf, off = text_buffer(batch.column(column))
    for lo, hi in slices(off, SLICE_BYTES):
        yield lo, hi, buf, off, *units(buf, off[lo: hi + 1], min_words, divisor)


def _count_map(buckets, min_words, divisor):
    def run(batches):
        held, n = [], 0

        def flush():
            keys = np.concatenate(held)
            return blob_batch(list(by_bucket([keys], [np.ones(len(keys), dtype=np.uint64)], buckets)))

        for batch in batches:
            for *_, (keys, _, _) in _each_slice(batch, 0, min_words, divisor):
                held.append(keys)
                n += len(keys)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _repeated_map(path):
    def run(batches):
        held = held_blobs(batches)
        for b in list(held):
            parts = [unpack(x) for x in held.pop(b)]
            key, _, (count,) = summed([np.concatenate([p[0] for p in parts])], [np.concatenate([p[1] for p in parts])])
            save_arrays(f"{path}/1-{b}", [key[count > 1]])
            yield blob_batch([(b, b"")])

    return run


_UNIT = "bucket int, h long, doc_id long, dk long, line int, unit binary"


def _doc_ids(column) -> np.ndarray:
    """Ids as longs; null orders first."""
    return np.array([-(1 << 63) if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _first_lines(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Line numbers within their rows of the lines ``at``."""
    return at - np.searchsorted(row, row[at])


def _text_units_map(path, buckets, min_words, divisor):
    """Lines (without empty ones) of the units that may repeat, equal ones of a task once, with their first place."""
    def run(batches):
        known, held, size = Level(path, 1, buckets), {}, 0

        def flush():
            rows = [(int(bucket_of(np.array([h], dtype=np.uint64), buckets)[0]), int(np.uint64(h).view(np.int64)), *place, unit)
                    for (h, unit), place in held.items()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=_names(_UNIT))

        for batch in batches:
            ids = _doc_ids(batch.column(0))
            for lo, hi, buf, off, (s, e, row, _), (keys, at, count) in _each_slice(batch, 1, min_words, divisor):
                hit = np.flatnonzero(known.contains(keys))
                if not len(hit):
                    continue
                docs = np.unique(row[at[hit]])
                dk = dict(zip(docs.tolist(), span_hashes(buf, off[lo + docs], off[lo + docs + 1], lower=False).view(np.int64).tolist()))
                for k, a, c, r, line in zip(keys[hit].tolist(), at[hit].tolist(), count[hit].tolist(), row[at[hit]].tolist(),
                                            _first_lines(row, at[hit]).tolist()):
                    unit = (k, _EMPTY_LINES.sub(b"\n", buf[s[a]: e[a + c - 1]].tobytes()))
                    place = (int(ids[lo + r]), dk[r], line)
                    if (old := held.get(unit)) is None:
                        held[unit], size = place, size + len(unit[1]) + 200
                    elif place < old:
                        held[unit] = place
                    else:
                        continue
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _place_hash(doc_id: np.ndarray, dk: np.ndarray, line: np.ndarray) -> np.ndarray:
    return join_hash(join_hash(doc_id.astype(np.int64).view(np.uint64), dk.astype(np.int64).view(np.uint64)), line.astype(np.uint64))


def _compare_map(path):
    """Rows come in order of hash: the least place of each distinct unit is kept."""
    def run(batches):
        out: dict[int, list[tuple[int, int]]] = {}
        now, least = None, {}  # (bucket, hash); place by bytes

        def close():
            if least:
                key = int(np.int64(now[1]).view(np.uint64))
                places = _place_hash(*(np.array(c, dtype=np.int64) for c in zip(*least.values())))
                out.setdefault(now[0], []).extend((key, p) for p in places.tolist())

        for batch in batches:
            for b, h, doc_id, dk, line, unit in zip(*(c.to_pylist() for c in batch.columns)):
                place = (doc_id, dk, line)
                if (b, h) != now:
                    close()
                    now, least = (b, h), {unit: place}
                elif (old := least.get(unit)) is None or place < old:
                    least[unit] = place
        close()
        for b, rows in out.items():
            rows.sort()
            keys = np.array([k for k, _ in rows], dtype=np.uint64)
            save_arrays(f"{path}/2-{b}", [keys, np.array([p for _, p in rows], dtype=np.uint64)])
            yield blob_batch([(b, b"")])

    return run


@dataclass(frozen=True)
class Repeats:
    """Where the repeated units are, and the parameters they were cut by."""

    path: str
    buckets: int
    min_words: int
    divisor: int


def find_repeats(docs: DataFrame, id_col: str = "doc_id", column: str = "text", min_words: int = MIN_WORDS,
                 divisor: int = DIVISOR) -> Repeats:
    """Passes 1 and 2: the repeated units of all texts, each with its kept place."""
    spark = docs.sparkSession
    texts = own_columns(docs, id_col, column).withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    found = Repeats(posix_dir(spark, "lines"), max(shuffle_width(spark), math.ceil(size / BUCKET_BYTES)), min_words, divisor)
    write_level(texts.select(column).mapInArrow(_count_map(found.buckets, min_words, divisor), BLOB)
                .repartitionById(found.buckets, F.col("bucket")).mapInArrow(_repeated_map(found.path), BLOB), found.path, 1)
    write_level(texts.mapInArrow(_text_units_map(found.path, found.buckets, min_words, divisor), _UNIT)
                .repartitionById(found.buckets, F.col("bucket")).sortWithinPartitions("bucket", "h")
                .mapInArrow(_compare_map(found.path), BLOB), found.path, 2)
    return found


def _drop_map(found: Repeats, id_at: int, text_at: int, names: list[str], info: bool):
    def run(batches):
        known = Level(found.path, 2, found.buckets)
        for batch in batches:
            ids = _doc_ids(batch.column(id_at))
            texts, lines, gone_lines, gone_words, spans = [], [], [], [], []
            for lo, hi, buf, off, (s, e, row, words), (keys, at, count) in _each_slice(batch, text_at, found.min_words, found.divisor):
                n = hi - lo
                hit = np.flatnonzero(known.contains(keys))
                if len(hit):
                    r = row[at[hit]]
                    docs, which = np.unique(r, return_inverse=True)
                    dk = span_hashes(buf, off[lo + docs], off[lo + docs + 1], lower=False).view(np.int64)[which]
                    hit = hit[~known.holds(keys[hit], _place_hash(ids[lo + r], dk, _first_lines(row, at[hit])))]
                mark = np.zeros(len(s) + 1, dtype=np.int64)
                np.add.at(mark, at[hit], 1)
                np.add.at(mark, at[hit] + count[hit], -1)
                gone = np.cumsum(mark[:-1]) > 0
                # runs of marked lines in a row
                edge = np.ones(len(s) + 1, dtype=bool)
                edge[1:-1] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(edge[:-1]) if len(s) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(s)) if len(first) else first
                total = np.concatenate([[0], np.cumsum(words)])
                take = gone[first] & (total[last] - total[first] >= found.min_words)
                cut = [[] for _ in range(n)]
                n_gone, w_gone = [0] * n, [0] * n
                for a, b in zip(first[take].tolist(), last[take].tolist()):
                    r = int(row[a])
                    stop = int(s[b]) if b < len(s) and row[b] == r else int(off[lo + r + 1])
                    cut[r].append((int(s[a] - off[lo + r]), stop - int(off[lo + r])))
                    n_gone[r] += b - a
                    w_gone[r] += int(total[b] - total[a])
                lines += np.bincount(row, minlength=n).tolist()
                gone_lines += n_gone
                gone_words += w_gone
                for r in range(n):
                    spans.append([{"start": a, "end": b} for a, b in cut[r]])
                    if not cut[r]:
                        texts.append(None)
                        continue
                    raw, parts, p = buf[off[lo + r]: off[lo + r + 1]].tobytes(), [], 0
                    for a, b in cut[r]:
                        parts.append(raw[p:a])
                        p = b
                    texts.append(b"".join([*parts, raw[p:]]).decode())
            if not batch.num_rows:
                continue
            old = batch.column(text_at)
            new = pa.array([o if not c else t for o, t, c in zip(old.to_pylist(), texts, spans)], pa.string()) if any(spans) else old
            cols = [new if k == text_at else c for k, c in enumerate(batch.columns)]
            if info:
                cols += [pa.array(lines, pa.int32()), pa.array(gone_lines, pa.int32()), pa.array(gone_words, pa.int32()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.record_batch(cols, names=names)

    return run


_INFO = "n_lines int, n_removed int, words_removed int, removed array<struct<start:long,end:long>>"


def drop_repeats(docs: DataFrame, found: Repeats, id_col: str = "doc_id", column: str = "text", info: bool = False) -> DataFrame:
    """Pass 3: ``docs`` with repeated passages cut from ``column``; all other columns as they were.

    ``info`` adds n_lines, n_removed, words_removed and removed (byte spans).
    """
    schema = T.StructType(docs.schema.fields + (T.StructType.fromDDL(_INFO).fields if info else []))
    names = schema.names
    return docs.mapInArrow(_drop_map(found, docs.columns.index(id_col), docs.columns.index(column), names, info), schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", column: str = "text", min_words: int = MIN_WORDS,
                divisor: int = DIVISOR, info: bool = False) -> DataFrame:
    """All passes over ``docs`` (``id_col`` a long column)."""
    return drop_repeats(docs, find_repeats(docs, id_col, column, min_words, divisor), id_col, column, info)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines that repeat in passages of 50 words or more, for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return (dedup_lines(docs, info=True)
            .select("doc_id", "n_lines", "n_removed", "words_removed",
                    F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")))
