"""Interpolated modified Kneser-Ney n-gram model, counted in Spark.

Vocabulary.  A first pass sums word hashes and writes them as sorted hash
arrays with an id each: ranked by count in its bucket (a range of the hash),
so frequent words have small ids and no task or driver sees all words.

Counting.  Every task turns whole texts into word ids, sums equal n-grams
of a few million tokens with one sort, and emits them packed, one binary row
per hash bucket: rows in order of their ids, the leading ids as differences,
cut into byte planes, each compressed.
One shuffle brings a bucket's rows together; the reducing
task sums them, writes the bucket as a file of sorted hash arrays in the
shared folder, and emits what the next lower order needs: continuation counts
of suffixes and follower statistics of contexts.  Orders follow each other in
one job, nothing but the files is written.  Buckets are ranges of the
n-gram's own hash, so a very common word or word pair makes no large bucket,
and their number follows the input's bytes.  Where the ids of an n-gram fit in
64 bits its hash is a bijection of them, as short as they are.  An n-gram that
begins a text has no left neighbour to count, its adjusted count is the raw one.

Scoring.  Workers map the files (shared, read-only pages) and look up the
distinct n-grams of a batch in sorted order.  Nothing of the model passes the
driver but counts of counts.  The counts of an n-gram are a code into the
frequent ones of its file; the rest lie whole in sorted arrays of their own.

Defined results: null or empty text is one end token; a model of no training
text gives every token the uniform probability; a repeated row counts twice;
ties of words by count go to the smaller hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.arrays import (BLOB, Level, blob_batch, bucket_of, by_bucket, gram_key, held_blobs, list_buckets,
                                  save_arrays, summed, unpack)
from relaysync.llm.common import fold, own_columns, posix_dir, read, shuffle_width, slices, text_buffer, write_atomic
from relaysync.llm.tokens import SPACE_WORDS, mix, span_hashes, word_spans

UNKNOWN, START, END = (np.uint64(k) for k in range(3))
WORD_IDS = 3
VOCABULARY = 0
FLUSH_TOKENS = 2_000_000
FLUSH_WORDS = 1_000_000
SLICE_BYTES = 4 << 20
EMIT_ROWS = 1_000_000
BUCKET_BYTES = 8 << 20
PLANE_ROWS = 4096
BOOK_BITS = 20


# -- token sequences --------------------------------------------------------

def sequences(buf: np.ndarray, off: np.ndarray, order: int, vocabulary: Level):
    """Padded token ids, the positions of real tokens, and their rows.

    Each row is order-1 start marks (never counted as tokens), its words, an
    end mark.
    """
    s, e, row = word_spans(buf, off, SPACE_WORDS)
    n = len(off) - 1
    words = np.bincount(row, minlength=n)
    seq = np.full(len(s) + n * order, START, dtype=np.uint64)
    seq[np.arange(len(s)) + row * order + order - 1] = vocabulary.values(span_hashes(buf, s, e))
    ends = np.cumsum(words) + np.arange(n) * order + order - 1
    seq[ends] = END
    real = np.ones(len(seq), dtype=bool)
    begins = ends - words - (order - 1)
    for k in range(order - 1):
        real[begins + k] = False
    at = np.flatnonzero(real)
    return seq, at, np.repeat(np.arange(n), words + 1)


# -- the vocabulary -----------------------------------------------------------

def _words_map(buckets: int):
    def run(batches):
        held, n = [], 0

        def flush():
            words = np.concatenate([h for h, _ in held])
            return blob_batch(list(by_bucket([words], [np.concatenate([c for _, c in held]).astype(np.uint64)], buckets)))

        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for lo, hi in slices(off, SLICE_BYTES):
                s, e, _ = word_spans(buf, off[lo: hi + 1], SPACE_WORDS)
                held.append(np.unique(span_hashes(buf, s, e), return_counts=True))
                n += len(held[-1][0])
                if n >= FLUSH_WORDS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _ids_map(buckets: int, path: str):
    """Word hashes of a bucket with their ids: rank by count * buckets + bucket, above the marks; emits the largest."""
    def run(batches):
        held = held_blobs(batches)
        for b in list(held):
            parts = [unpack(x) for x in held.pop(b)]
            key, _, (count,) = summed([np.concatenate([p[0] for p in parts])], [np.concatenate([p[1] for p in parts])])
            rank = np.empty(len(key), dtype=np.uint64)
            rank[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(len(key), dtype=np.uint64)
            save_arrays(f"{path}/{VOCABULARY}-{b}", [key, rank * np.uint64(buckets) + np.uint64(b + WORD_IDS)])
            yield blob_batch([(b, np.uint64((len(key) - 1) * buckets + b + WORD_IDS).tobytes())])

    return run


# -- packed rows of ids ---------------------------------------------------------

def ids_order(ids: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their ids; one sort of 64-bit numbers where the ids fit in these."""
    bits = [int(c.max(initial=0)).bit_length() for c in ids]
    if sum(bits) > 64:
        return np.lexsort(ids[::-1])
    x = ids[0]
    for c, b in zip(ids[1:], bits[1:]):
        x = x << np.uint64(b) | c
    return np.argsort(x)


def squeeze(ids: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows in order of their ids, as byte planes, compressed one by one (few rows: together).

    The first id is a difference, the second one too where the first is the same.
    """
    order = ids_order(ids)
    cols = [c[order] for c in (*ids, *values)]
    n, near = len(order), min(len(ids), 2)
    if near == 2:
        same = np.concatenate([[False], cols[0][1:] == cols[0][:-1]]) if n else np.zeros(0, dtype=bool)
        cols[1] = np.where(same, np.diff(cols[1], prepend=np.uint64(0)), cols[1])
    cols[0] = np.diff(cols[0], prepend=np.uint64(0))
    planes, widths = [], []
    for c in cols:
        t = np.min_scalar_type(int(c.max()) if n else 0)
        widths.append(t.itemsize)
        planes += [p.tobytes() for p in c.astype(t).view(np.uint8).reshape(n, t.itemsize).T]
    if n < PLANE_ROWS:
        planes = [b"".join(planes)]
    packed = [pa.compress(p, codec="zstd", asbytes=True) for p in planes]
    head = np.array([n, len(cols), near, len(packed), *widths, *map(len, packed)], dtype=np.uint32)
    return b"".join([head.tobytes(), *packed])


def expand(data: bytes) -> list[np.ndarray]:
    n, k, near, frames = (int(x) for x in np.frombuffer(data, dtype=np.uint32, count=4))
    widths, sizes = np.split(np.frombuffer(data, dtype=np.uint32, count=k + frames, offset=16).astype(int), [k])
    size = n if n >= PLANE_ROWS else n * int(widths.sum())
    at, planes = 16 + 4 * (k + frames), []
    for x in sizes.tolist():
        planes.append(pa.decompress(data[at: at + x], decompressed_size=size, codec="zstd", asbytes=True))
        at += x
    raw, at, cols = np.frombuffer(b"".join(planes), dtype=np.uint8), 0, []
    for width in widths.tolist():
        plane = raw[at: at + n * width].reshape(width, n)
        cols.append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel().astype(np.uint64))
        at += n * width
    if near == 2 and n:
        first = np.concatenate([[True], cols[0][1:] != 0])
        total = np.cumsum(cols[1], dtype=np.uint64)
        cols[1] = total - (total - cols[1])[first][np.cumsum(first) - 1]
    cols[0] = np.cumsum(cols[0], dtype=np.uint64)
    return cols


def key_bits(n: int, width: int) -> int:
    """Leading bits that the keys of n ids of ``width`` bits take; the others are 0."""
    return max(32, n * width) if n * width <= 64 else 64


def ids_key(ids: list[np.ndarray], width: int) -> np.ndarray:
    """Keys of n-grams: their ids shuffled by a bijection where these fit, a hash of them elsewhere."""
    if len(ids) * width > 64:
        return gram_key([mix(c) for c in ids])
    bits = key_bits(len(ids), width)
    x = ids[0]
    for c in ids[1:]:
        x = x << np.uint64(width) | c
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        x = (x ^ x >> half) * np.uint64(odd) & mask
    return (x ^ x >> half) << np.uint64(64 - bits)


def summed_ids(ids: list[np.ndarray], values: list[np.ndarray], width: int):
    """Rows of equal ids added up, in order of their hash: (key, ids, values)."""
    key = ids_key(ids, width)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    some = order[first]
    return (key[first], [c[some] for c in ids],
            [np.add.reduceat(v[order], first) if len(first) else v for v in values])


def ids_by_bucket(ids, values, buckets: int, width: int):
    """(bucket, packed rows) of equal ids added up."""
    key, ids, values = summed_ids(ids, values, width)
    b = bucket_of(key, buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cut, [*cut[1:], len(b)]):
        yield int(b[lo]), squeeze([c[lo:hi] for c in ids], [c[lo:hi] for c in values])


# -- files of counts --------------------------------------------------------------

def bucket_start(bucket: int, buckets: int) -> int:
    """The least hash of a bucket (see ``bucket_of``)."""
    return -(-(bucket << 32) // buckets) << 32


def coded(table: np.ndarray, free: int):
    """Each row of counts as a code: (codes, their rows, whether a code has the ``free`` bits or eight).

    The frequent rows of small counts have codes; the code above them, a row
    of zeros, stands for all others.
    """
    n, k = table.shape
    per = BOOK_BITS // k
    small = np.flatnonzero((table < 1 << per).all(axis=1))
    packed = np.zeros(len(small), dtype=np.int64)
    for j in range(k):
        packed |= table[small, j].astype(np.int64) << (per * j)
    count = np.bincount(packed, minlength=1)
    rows = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    whole = 4 + sum(np.min_scalar_type(int(c)).itemsize for c in table.max(axis=0, initial=0))
    cost = {bits: (n - int(count[rows[: (1 << bits) - 1]].sum())) * whole + n * (bits == 8) for bits in (free, 8)}
    bits = min(cost, key=cost.get)
    rows = rows[: (1 << bits) - 1]
    code_of = np.full(len(count), len(rows), dtype=np.uint8)
    code_of[rows] = np.arange(len(rows))
    codes = np.full(n, len(rows), dtype=np.uint8)
    codes[small] = code_of[packed]
    book = np.array([[r >> (per * j) & (1 << per) - 1 for j in range(k)] for r in rows.tolist()] + [[0] * k])
    return codes, book, bits == free


def save_counts(path: str, bucket: int, buckets: int, key: np.ndarray, values: list[np.ndarray], bits: int = 64) -> None:
    """Sorted hashes of ``bits`` leading bits, and the code of each one's values (see ``coded``).

    A hash is kept whole, in fewer bytes: what its bucket and the place in a
    directory of leading bits say is left out.  The code takes the bits left
    over in its last byte, or a byte of its own.  Values without a code stand
    in a list sorted by row.
    """
    start, low = bucket_start(bucket, buckets), 64 - bits
    span = bucket_start(bucket + 1, buckets) - start >> low
    lead = min(max(len(key).bit_length() - 5, 0), (span - 1).bit_length())
    shift = (span - 1).bit_length() - lead
    rest = key - np.uint64(start) >> np.uint64(low)
    directory = np.searchsorted(rest >> np.uint64(shift), np.arange((1 << lead) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = rest & np.uint64((1 << shift) - 1)
    table = np.stack(values, axis=1)
    codes, book, inside = coded(table, -shift % 8)
    inner = -shift % 8 if inside else 0
    if inside:
        rest = rest << np.uint64(inner) | codes
    place = np.flatnonzero(codes == len(book) - 1)
    parts, at = [], 0
    for size in number_parts(shift + inner):
        parts.append((rest >> np.uint64(at)).astype(f"<u{size}"))
        at += 8 * size
    smallest = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in (place.astype(np.uint64), *table[place].T)]
    cols = [parts[0], directory, np.array([start, low, shift, inner], dtype=np.uint64), book.astype(np.uint32).ravel(),
            codes[:0] if inside else codes, *smallest, *parts[1:]]
    head = np.array([[len(c), ord(c.dtype.char)] for c in cols], dtype=np.uint64)
    write_atomic(path, b"".join([np.uint64(len(cols)).tobytes(), head.tobytes(),
                                 *(c.tobytes() + b"\0" * (-c.nbytes % 8) for c in cols)]))


def number_parts(bits: int) -> list[int]:
    """Bytes of the columns that hold a number of so many bits, low ones first."""
    n = max(1, -(-bits // 8))
    return [4] * (n // 4) + [2] * (n // 2 % 2) + [1] * (n % 2)


def map_counts(path: str) -> list[np.ndarray]:
    """The columns of ``save_counts`` as read-only views of mapped pages."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    k = int(raw[:8].view(np.uint64)[0])
    at, cols = 8 + 16 * k, []
    for n, char in raw[8:at].view(np.uint64).reshape(k, 2).tolist():
        t = np.dtype(chr(char))
        cols.append(raw[at: at + n * t.itemsize].view(t))
        at += n * t.itemsize + (-n * t.itemsize) % 8
    return cols


class CountLevel(Level):
    """The mapped counts of one order."""

    def _open(self, bucket: int) -> list[np.ndarray]:
        return map_counts(f"{self.path}/{self.level}-{bucket}") if bucket in self.listed else []

    def _number(self, cols: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """The numbers at the given rows: a hash's rest, above its code if that is inside."""
        _, _, shift, inner = cols[2].tolist()
        sizes = number_parts(shift + inner)
        x, up = cols[0][at].astype(np.uint64), 8 * sizes[0]
        for size, part in zip(sizes[1:], cols[len(cols) - len(sizes) + 1:]):
            x |= part[at].astype(np.uint64) << np.uint64(up)
            up += 8 * size
        return x

    def _at(self, bucket: int, cols: list[np.ndarray], keys: np.ndarray):
        """Binary search between two entries of the directory, for all keys at once."""
        start, low, shift, inner = cols[2].tolist()
        want = keys - np.uint64(start) >> np.uint64(low)
        lead = (want >> np.uint64(shift)).astype(np.int64)
        want = want & np.uint64((1 << shift) - 1)
        lo, hi = cols[1][lead].astype(np.int64), cols[1][lead + 1].astype(np.int64)
        last = len(cols[0]) - 1

        def rest(at):
            return self._number(cols, at) >> np.uint64(inner)

        end = hi
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, last)
            less = rest(mid) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, last)
        return at, (lo < end) & (rest(at) == want)

    def look_up(self, keys: np.ndarray, columns: list[int]) -> list[np.ndarray]:
        """The given columns (from 1), as doubles, at each key; 0 where the key is unknown."""
        q, back = np.unique(keys, return_inverse=True)
        found = [np.zeros(len(q), dtype=np.float64) for _ in columns]
        for where, cols, at in self._find(q, ascending=True):
            _, _, shift, inner = cols[2].tolist()
            width = len(cols) - 5 - len(number_parts(shift + inner))
            book = cols[3].reshape(-1, width).astype(np.float64)
            code = cols[4][at] if len(cols[4]) else (self._number(cols, at) & np.uint64((1 << inner) - 1)).astype(np.uint8)
            over = np.flatnonzero(code == len(book) - 1)
            place = np.searchsorted(cols[5], at[over])
            for f, c in zip(found, columns):
                v = book[code, c - 1]
                v[over] = cols[5 + c][place]
                f[where] = v
        return [f[back] for f in found]


# -- counting ---------------------------------------------------------------

_ROWS = "bucket int, level int, blob binary"
_ADJ, _TOT, _RAW = 1, 2, 6  # columns of a file; the last is there at order 1 only


def _rows_batch(level: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([level] * len(rows), pa.int32()),
                            pa.array([x for _, x in rows], pa.binary())], names=["bucket", "level", "blob"])


def _count_map(order: int, buckets: int, path: str, width: int):
    def run(batches):
        vocabulary = Level(path, VOCABULARY, buckets)
        held, n = [], 0

        def flush():
            ids = [np.concatenate([h[k] for h in held]) for k in range(order)]
            return _rows_batch(order, list(ids_by_bucket(ids, [np.ones(len(ids[0]), dtype=np.uint64)], buckets, width)))

        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for lo, hi in slices(off, SLICE_BYTES):
                seq, at, _ = sequences(buf, off[lo: hi + 1], order, vocabulary)
                held.append([seq[at - (order - 1 - k)] for k in range(order)])
                n += len(at)
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _reduce_map(level: int, top: bool, buckets: int, path: str, width: int):
    """Sum a bucket, write its sorted arrays, emit the next order's rows.

    Rows of level -k pass through: counts of counts of a bucket of order k.
    Emitted values are mostly 0: the raw count beyond the left neighbours,
    these, the followers' counts beyond 1, 2 and 3 each, and how many
    followers have 1, 2, 3 and more.
    """
    def reduce(bucket: int, blobs: list[bytes]):
        parts = [expand(b) for b in blobs]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]
        parts.clear()
        key, ids, values = summed_ids(cols[:level], cols[level:], width)
        cols.clear()
        raw = values[0]
        if top:
            adj, follow = raw, [np.zeros(len(raw), np.uint64)] * 4
        else:
            raw = raw + values[1]
            adj = np.where(ids[0] == START, raw, values[1])
            follow = [values[2] + values[3] + values[4] * np.uint64(2) + values[5] * np.uint64(3), *values[3:]]
        keep = [adj]
        if not top or level == 1:
            keep += follow
        save_counts(f"{path}/{level}-{bucket}", bucket, buckets, key, keep + [raw] * (level == 1), key_bits(level, width))
        del key, values, follow, keep
        cc = np.bincount(np.minimum(adj, 5).astype(np.int64), minlength=6)
        yield -level, [(bucket, np.array([*cc[1:6], adj.sum(), raw.sum(), (raw > 0).sum()], dtype=np.int64).tobytes())]
        if level == 1:
            return
        known = adj > 0
        if not known.all():
            ids, raw, adj = [c[known] for c in ids], raw[known], adj[known]
        for lo in range(0, len(adj), EMIT_ROWS):
            some, c, a = [x[lo: lo + EMIT_ROWS] for x in ids], raw[lo: lo + EMIT_ROWS], adj[lo: lo + EMIT_ROWS]
            zero, one = np.zeros(len(a), np.uint64), np.ones(len(a), np.uint64)
            context = [zero, zero, a - np.minimum(a, np.uint64(3)), *(x.astype(np.uint64) for x in (a == 1, a == 2, a >= 3))]
            suffix = [c - one, one, zero, zero, zero, zero]
            yield level - 1, list(ids_by_bucket([np.concatenate(x) for x in zip(some[:-1], some[1:])],
                                                [np.concatenate(x) for x in zip(context, suffix)], buckets, width))

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, k, x in zip(*(c.to_pylist() for c in batch.columns)):
                if k < 0:
                    yield _rows_batch(k, [(b, x)])
                else:
                    held.setdefault(b, []).append(x)
        for b in list(held):
            for k, rows in reduce(b, held.pop(b)):
                if rows:
                    yield _rows_batch(k, rows)

    return run


# -- the model ----------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Where the sorted arrays are, and what scoring needs besides them."""

    path: str
    order: int
    buckets: int
    width: int  # bits of a word id
    counts: tuple  # per level: counts of counts 1, 2, 3, 4, 5+; sum of adjusted counts; tokens; types

    @property
    def tokens(self) -> int:
        return self.counts[0][6]

    @property
    def types(self) -> int:
        return self.counts[0][7]

    def discounts(self, level: int) -> np.ndarray:
        """D for adjusted counts 0, 1, 2, 3 and more (closed form; in 0..count)."""
        n1, n2, n3, n4 = self.counts[level - 1][:4]
        if not (n1 and n2):
            return np.array([0.0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 1.5]
        return np.array([0.0, *(min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d))])


def train(texts: DataFrame, column: str = "text", order: int = 2) -> Model:
    """Count a model of the given order over a column of whole texts."""
    spark = texts.sparkSession
    texts = own_columns(texts, column)
    size = texts.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    buckets = max(shuffle_width(spark), math.ceil(size / BUCKET_BYTES))
    path = posix_dir(spark, "lm")
    words = (texts.mapInArrow(_words_map(buckets), BLOB).repartitionById(buckets, F.col("bucket"))
             .mapInArrow(_ids_map(buckets, path), BLOB).collect())
    list_buckets(path, VOCABULARY, [r.bucket for r in words])
    width = max([int(np.frombuffer(r.blob, dtype=np.uint64)[0]) for r in words], default=WORD_IDS).bit_length()
    rows = texts.mapInArrow(_count_map(order, buckets, path, width), _ROWS)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(_reduce_map(level, level == order, buckets, path, width), _ROWS)
    counts, written = np.zeros((order, 8), dtype=np.int64), [[] for _ in range(order)]
    for r in rows.collect():  # one row a bucket and order: all buckets are reduced at once
        counts[-r.level - 1] += np.frombuffer(r.blob, dtype=np.int64)
        written[-r.level - 1].append(r.bucket)
    for k, found in enumerate(written):
        list_buckets(path, k + 1, found)
    return Model(path, order, buckets, width, tuple(tuple(int(x) for x in c) for c in counts))


def _score_map(model: Model, keep: int):
    """Adds n_tokens, n_known, base_score, score to the first ``keep`` columns; the text comes last."""
    def run(batches):
        vocabulary = Level(model.path, VOCABULARY, model.buckets)
        levels = [CountLevel(model.path, k, model.buckets) for k in range(1, model.order + 1)]
        known = [[_ADJ, _TOT, _TOT + 1, _TOT + 2, _TOT + 3] for _ in levels[1:]] + [[_ADJ]]  # columns to look up
        known[0] = known[0] + [_RAW]
        disc = [model.discounts(k) for k in range(1, model.order + 1)]
        c1 = model.counts[0]
        base_den = math.log10(model.tokens + model.types + 1)

        def discounted(adj, k):
            return np.maximum(adj - disc[k - 1][np.minimum(adj, 3).astype(np.int64)], 0.0)

        for batch in batches:
            buf, off = text_buffer(batch.column(keep))
            out = [[], [], [], []]
            for lo, hi in slices(off, SLICE_BYTES):
                seq, at, row = sequences(buf, off[lo: hi + 1], model.order, vocabulary)
                n = hi - lo
                back = [np.concatenate([np.full(k, START), seq[: len(seq) - k]]) for k in range(model.order)]
                # an n-gram is looked up once, also as the context of the next token
                found = [level.look_up(ids_key(back[k:: -1], model.width), columns)
                         for k, (level, columns) in enumerate(zip(levels, known))]
                adj, raw = [f[0][at] for f in found], found[0][-1][at]
                p = np.full(len(at), 1.0 / (model.types + 1))
                if c1[5]:
                    gamma = (disc[0][1:] * (c1[0], c1[1], c1[2] + c1[3] + c1[4])).sum() / c1[5]
                    p = discounted(adj[0], 1) / c1[5] + gamma * p
                for k in range(2, model.order + 1):
                    tot, n1, n2, n3 = (x[at - 1] for x in found[k - 2][1:5])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        q = (discounted(adj[k - 1], k)
                             + (disc[k - 1][1] * n1 + disc[k - 1][2] * n2 + disc[k - 1][3] * n3) * p) / tot
                    p = np.where(tot > 0, q, p)
                for o, x in zip(out, (np.bincount(row, minlength=n), np.bincount(row, weights=raw > 0, minlength=n),
                                      np.bincount(row, weights=np.log10(raw + 1) - base_den, minlength=n),
                                      np.bincount(row, weights=np.log10(p), minlength=n))):
                    o.append(x)
            if batch.num_rows:
                a, b, c, d = (np.concatenate(o) for o in out)
                yield pa.record_batch([*batch.columns[:keep], pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)),
                                       pa.array(c), pa.array(d)],
                                      names=[*batch.schema.names[:keep], "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], column: str = "text") -> DataFrame:
    """log10 probability of each whole text under ``model`` and under an add-one unigram base.

    Returns the columns ``keep`` and n_tokens, n_known, base_score, score,
    perplexity.
    """
    rows = own_columns(docs, *keep, column)
    schema = own_columns(docs, *keep).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return (rows.mapInArrow(_score_map(model, len(keep)), schema)
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Trigram Kneser-Ney scores of every document, learned outside fold 2 of 7."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(fold("doc_id", 7) != 2), order=3)
    return (score(docs.withColumn("held_out", fold("doc_id", 7) == 2), model, ["doc_id", "held_out"])
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                    "base_score", "score", "perplexity"))
