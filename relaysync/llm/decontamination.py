"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a run of documents of one partition with a bounded number of words
(a longer document is a shard by itself).  A task turns its texts into words,
indexes them, searches all benchmark windows backwards at once, locates the
occurrences and merges them into spans of words.  No text is shuffled.

Only words that some benchmark window holds have a symbol of their own; every
other word ends a segment, and segments shorter than the shortest window
cannot hold an occurrence and are left out of the index.

The benchmark is the query set: it is read in blocks of ``BLOCK_WORDS`` words,
each block a file in the shared folder, and a task searches one block after
another, so neither the driver nor a worker holds more than one block.

Defined results: null or wordless texts have no hits; an item with no words
has no window; equal items all count; an empty benchmark leaves every
document clean.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaysync.llm.common import own_columns, posix_dir, read, slices, text_buffer, write_atomic
from relaysync.llm.fm_index import FMIndex
from relaysync.llm.tokens import ALNUM_WORDS, span_hashes, word_spans

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_WORDS = 1_000_000
SLICE_BYTES = 4 << 20


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)], dtype=np.int64), ALNUM_WORDS)
    return span_hashes(raw, s, e)


def write_queries(items: DataFrame, id_col: str, column: str, window: int, block_words: int) -> str:
    """The windows of all items as block files: (word, length, item) arrays."""
    path = posix_dir(items.sparkSession, "benchmark")
    held: list[tuple[str, np.ndarray]] = []

    def flush(name: str):
        wins, ids = [], []
        for item, w in held:
            for i in range(max(1, len(w) - window + 1)):
                wins.append(w[i: i + window])
                ids.append(item)
        words = np.zeros((len(wins), window), dtype=np.uint64)
        for k, w in enumerate(wins):
            words[k, window - len(w):] = w
        lengths = np.array([len(w) for w in wins], dtype=np.int64)
        write_atomic(f"{path}/{name}", pickle.dumps((words, lengths, ids), protocol=5))
        held.clear()

    size, blocks = 0, 0
    for r in own_columns(items, id_col, column).toLocalIterator():
        w = _words(r[1])
        if len(w):
            held.append(("" if r[0] is None else str(r[0]), w))
            size += len(w)
        if size >= block_words:
            flush(f"{blocks:06d}")
            size, blocks = 0, blocks + 1
    if held:
        flush(f"{blocks:06d}")
        blocks += 1
    write_atomic(f"{path}/blocks", str(blocks).encode())
    return path


def block_files(path: str) -> list[str]:
    """The block files of a folder; raises where the folder is not mounted."""
    with open(f"{path}/blocks", "rb") as f:
        return [f"{path}/{k:06d}" for k in range(int(f.read()))]


class Queries:
    """One block: distinct patterns over its own vocabulary, and the items of each."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            words, lengths, ids = pickle.load(f)
        used = np.arange(words.shape[1])[None, :] >= (words.shape[1] - lengths)[:, None]
        self.vocabulary = np.unique(words[used])
        coded = np.where(used, np.searchsorted(self.vocabulary, words) + 1, 0)
        self.patterns, which = np.unique(coded, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.items = [[] for _ in self.patterns]
        for p, item in zip(which.ravel().tolist(), ids):
            self.items[p].append(item)
        self.shortest = int(self.lengths.min())

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def search_shard(queries: Queries, hashes: np.ndarray, row: np.ndarray, n_rows: int):
    """(word mask, item sets by row) for a shard's words and their rows."""
    hit = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: dict[int, set] = {}
    sym = queries.symbols(hashes)
    edge = np.ones(len(sym) + 1, dtype=bool)
    edge[1:-1] = row[1:] != row[:-1]
    known = sym > 0
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    wide = ends - starts >= queries.shortest
    starts, size = starts[wide], (ends - starts)[wide]
    if len(starts):
        # segments one after another, each followed by a separator
        total = int(size.sum()) + len(size)
        place = np.repeat(starts - np.cumsum(size + 1) + size + 1, size + 1) + np.arange(total)
        text = sym[np.minimum(place, len(sym) - 1)]
        text[np.cumsum(size + 1) - 1] = 0
        index = FMIndex(text, len(queries.vocabulary) + 1)
        lo, hi = index.search(queries.patterns, queries.lengths)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        rows = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        at = place[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + queries.lengths[which], -1)
        pairs = np.unique(row[at] * len(queries.patterns) + which)
        for r, p in zip((pairs // len(queries.patterns)).tolist(), (pairs % len(queries.patterns)).tolist()):
            items.setdefault(r, set()).update(queries.items[p])
    return np.cumsum(hit[:-1]) > 0, items


def _search_map(path: str, text_at: int, shard_words: int, names: list[str]):
    def shard(batches, held):
        """Results of whole batches that one shard holds."""
        hashes = np.concatenate([h for _, h, *_ in held])
        base = np.cumsum([0, *(b.num_rows for b in batches)])
        row = np.concatenate([r + base[k] for k, _, r, *_ in held])
        n = int(base[-1])
        hit = np.zeros(len(hashes), dtype=bool)
        items: list[set] = [set() for _ in range(n)]
        for f in block_files(path):
            mask, found = search_shard(Queries(f), hashes, row, n)
            hit |= mask
            for r, ids in found.items():
                items[r] |= ids
        n_words, n_hit = np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n)
        spans = [[] for _ in range(n)]
        if hit.any():
            s, e = np.concatenate([x for *_, x, _ in held]), np.concatenate([x for *_, x in held])
            edge = np.ones(len(hit) + 1, dtype=bool)
            edge[1:-1] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(edge[:-1])
            last = np.append(first[1:], len(hit)) - 1
            for a, b in zip(first[hit[first]].tolist(), last[hit[first]].tolist()):
                spans[int(row[a])].append({"start": int(s[a]), "end": int(e[b])})
        ids = [sorted(x) for x in items]
        for k, b in enumerate(batches):
            lo, hi = int(base[k]), int(base[k + 1])
            if lo == hi:
                continue
            w, h = n_words[lo:hi], n_hit[lo:hi]
            yield pa.record_batch([*b.columns, pa.array(w.astype(np.int64)), pa.array(h.astype(np.int64)), pa.array(ids[lo:hi], pa.list_(pa.string())),
                                   pa.array((h > 0) & (20 * h >= w)),
                                   pa.array(spans[lo:hi], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=names)

    def run(batches):
        rows, held, size = [], [], 0
        for batch in batches:
            buf, off = text_buffer(batch.column(text_at))
            for lo, hi in slices(off, SLICE_BYTES):
                s, e, r = word_spans(buf, off[lo: hi + 1], ALNUM_WORDS)
                begin = off[lo + r]
                held.append((len(rows), span_hashes(buf, s, e), r, s - begin, e - begin))
                rows.append(batch.slice(lo, hi - lo))
                size += len(s)
                if size >= shard_words:
                    yield from shard(rows, held)
                    rows, held, size = [], [], 0
        if rows:
            yield from shard(rows, held)

    return run


_OUT = "n_words long, n_hit long, items array<string>, contaminated boolean, spans array<struct<start:long,end:long>>"


def find_contamination(docs: DataFrame, items: DataFrame, column: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids with an occurring window), contaminated, spans (bytes to remove).

    The added columns come last; a column of ``docs`` with one of these names is left out.
    """
    added = T.StructType.fromDDL(_OUT)
    docs = docs.drop(*added.names)
    schema = T.StructType(docs.schema.fields + added.fields)
    path = write_queries(items, item_id, item_text, window, block_words)
    return docs.mapInArrow(_search_map(path, docs.columns.index(column), shard_words, schema.names), schema)


def remove_spans(text, spans):
    """The text column without the byte spans (a column expression)."""
    raw = text.cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out"))
    cut = F.aggregate(spans, start, lambda a, s: F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), F.octet_length(text))))
    return F.decode(cut, "UTF-8")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that 13-word windows of the benchmark cover."""
    docs = own_columns(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
