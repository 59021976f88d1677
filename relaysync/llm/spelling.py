"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Words that may be one edit apart share their letters before and after it.  For
a pair whose shorter word has m letters, the edit is put at the length i of
the pair's common prefix, 0 <= i <= m.  A shard is a window [s, e) of places
i: words of m or m + 1 letters that agree in the s letters before the window
and in the m - e letters after it.  Each word first goes to the shards of two
half windows; a shard of more than ``cells`` letters is cut into the halves of
its window, down to windows of one place, where only the alphabet limits a
shard.  So each near pair meets in exactly one shard, and no shard is large
however many words share a beginning.

In a shard the words' middles are a sorted list.  All its words look for their
near ones in one scan by depth: a range of the list that shares a prefix (its
inner LCPs are longer) shares one row of the edit matrix, of which only the
band of three values around the diagonal is kept; a range goes on into the
ranges of its next letter as long as its row holds a value of at most one, and
is skipped as a whole beyond that.

Only counts and the best near word leave a shard, no pairs.

Defined results: null text has no words; a null id is the empty text in the
hash; repeated rows count as often as they stand; extra columns are ignored;
no words give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.llm.arrays import grouped
from relaysync.llm.common import read, shuffle_width, staged

MIN_LETTERS = 5
MIN_COUNT = 3
CELLS = 1 << 14
BATCH_CELLS = 1 << 18
QUERIES = 1024
FLUSH = 200_000
TYPO_MOD = 97
_FAR = 9


def _count_words(shortest: int, typo: int | None):
    # folded UTF-8: a-z, or U+00C0 to U+00FF as C3 80 to C3 BF; shorter runs cannot give a word
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % shortest)

    def emit(held: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                if not text:
                    continue
                seed = crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                for w, k in Counter(runs.findall(text.encode().lower())).items():
                    if typo and not (h := crc32(w, seed)) % typo:
                        s = w.decode()
                        at = h % len(s)
                        w = (s[:at] + s[at + 1:]).encode()
                        if len(s) <= shortest:
                            continue
                    held[w] = held.get(w, 0) + k
                if len(held) > FLUSH:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    return run


def vocabulary(docs: DataFrame, shortest: int = MIN_LETTERS, least: int = MIN_COUNT, typo: int | None = None,
               id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z folded, of at least ``shortest`` code points and ``least`` occurrences.

    With ``typo``, a run whose crc32 of ``<id>:<run>`` it divides loses one letter, the same in all of a document.
    """
    counts = docs.select(F.col(f"`{id_col}`"), F.col(f"`{column}`")).mapInArrow(_count_words(shortest, typo), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _near(codes: np.ndarray, lens: np.ndarray, lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(query, row) of rows one edit apart, each in its list ``lo:hi``; ``lcp`` with the row before, -1 at a list's start."""
    rows, width = codes.shape
    levels = []
    for d in range(width):
        opens = lcp <= d
        levels.append((np.cumsum(opens) - 1, np.flatnonzero(opens)))
    for first in range(0, rows, QUERIES):
        q = np.arange(first, min(first + QUERIES, rows))
        at, end = lo[q], hi[q]
        a, b, c = np.full(len(q), _FAR, np.int8), np.zeros(len(q), np.int8), np.where(lens[q] > 0, 1, _FAR).astype(np.int8)
        for d in range(width + 1):
            ended = lens[at] == d
            k = lens[q] - d
            final = np.select([k == -1, k == 0, k == 1], [a, b, c], _FAR)
            hit = ended & (final == 1)
            yield q[hit], at[hit]
            at = at + ended
            go = np.flatnonzero(at < end)
            if d == width or not len(go):
                break
            node, opens = levels[d]
            f = node[at[go]]
            many = node[end[go] - 1] - f + 1
            src = np.repeat(go, many)
            child = np.repeat(f, many) + np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
            q, x = q[src], codes[opens[child], d]
            n = lens[q]
            row = codes[q[:, None], np.clip(np.arange(d - 1, d + 2), 0, width - 1)]
            other = [np.where((0 < j) & (j <= n), (row[:, i] != x).astype(np.int8), _FAR) for i, j in enumerate((d, d + 1, d + 2))]
            inside = [np.where(j <= n, 0, _FAR).astype(np.int8) for j in (d, d + 1, d + 2)]
            a, b, c = a[src], b[src], c[src]
            na = np.minimum(b + 1, a + other[0]) + inside[0]
            nb = np.minimum(np.minimum(c + 1, na + 1), b + other[1]) + inside[1]
            nc = np.minimum(nb + 1, c + other[2]) + inside[2]
            a, b, c = (np.minimum(v, _FAR).astype(np.int8) for v in (na, nb, nc))
            keep = (a <= 1) | (b <= 1) | (c <= 1)
            q, a, b, c = q[keep], a[keep], b[keep], c[keep]
            at = opens[child[keep]]
            end = np.append(opens[1:], rows)[child[keep]]


def _best(lists: list) -> list[tuple]:
    """(word, near words, n of the best, best) of sorted lists ((m, s, e, prefix, suffix), [(middle, n)])."""
    size = [len(x) for _, x in lists]
    middles = [w for _, x in lists for w, _ in x]
    width = max(map(len, middles))
    codes = np.array(middles, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(middles), -1)
    lens = np.array([len(w) for w in middles])
    hi = np.repeat(np.cumsum(size), size)
    lo = hi - np.repeat(size, size)
    same = np.zeros((len(middles), codes.shape[1] + 1), dtype=bool)
    same[1:, :-1] = codes[1:] == codes[:-1]
    lcp = same.argmin(axis=1)
    lcp[lo] = -1
    shorter, window = (np.repeat(x, size) for x in zip(*[(k[0] - k[1] - len(k[4]), k[2] - k[1]) for k, _ in lists]))
    found = [x for x in _near(codes, lens, lcp, lo, hi) if len(x[0])]
    if not found:
        return []
    q, t = (np.concatenate(x) for x in zip(*found))
    common = np.concatenate([codes[q] == codes[t], np.zeros((len(q), 1), bool)], axis=1).argmin(axis=1)
    ok = (np.minimum(lens[q], lens[t]) == shorter[q]) & (common < window[q])
    q, t = q[ok], t[ok]
    n = np.array([k for _, x in lists for _, k in x])
    words = [p + w + r for (_, _, _, p, r), x in lists for w, _ in x]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[t], -n[t], q))
    q, t = q[order], t[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
    return [(words[i], int(k), int(n[j]), words[j]) for i, k, j in zip(q[head], np.diff(np.append(head, len(q))), t[head])]


def _shards(batches):
    def emit(lists):
        cols = list(zip(*_best(lists))) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                               names=["word", "near", "best_n", "best"])

    held, rows, width = [], 0, 0
    for key, words in grouped(batches, 5):
        if len(words) < 2:
            continue
        w = max(len(x[0]) for x in words)
        if held and (rows + len(words)) * max(width, w) > BATCH_CELLS:
            yield emit(held)
            held, rows, width = [], 0, 0
        held.append((key, words))
        rows, width = rows + len(words), max(width, w)
    if held:
        yield emit(held)


_KEY = ["m", "s", "e", "prefix", "suffix"]


def _windowed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, s, e) with what they share outside the window, and the middle."""
    after = F.greatest(F.col("m") - F.col("e"), F.lit(0))
    return rows.select("word", "n", "m", "s", "e", F.expr("substring(word, 1, s)").alias("prefix"),
                       F.when(after > 0, F.expr("substring(word, length(word) - greatest(m - e, 0) + 1, m)")).otherwise(F.lit("")).alias("suffix"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    w = F.explode(F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))).alias("w")
    return _windowed(rows.select("word", "n", "m", w).select("word", "n", "m", "w.s", "w.e"))


def near_words(words: DataFrame, shortest: int = MIN_LETTERS, cells: int = CELLS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have one at exactly one edit; best: largest n, then least."""
    size = F.length("word")
    m = F.explode(F.when(size > shortest, F.array(size, size - 1)).otherwise(F.array(size))).alias("m")
    rows = staged(_halved(words.select("word", "n", m).select("*", F.lit(0).alias("s"), (F.col("m") + 1).alias("e"))), "spelling")
    ready = None
    while True:
        large = (rows.where("e - s > 1").groupBy(*_KEY).agg(F.count("*").alias("k"))
                 .where(F.col("k") * (F.col("e") - F.col("s") + 1) > cells).drop("k"))
        rows = staged(rows.join(large.withColumn("large", F.lit(True)), _KEY, "left"), "spelling")
        small = rows.where("large is null").drop("large")
        ready = small if ready is None else ready.union(small)
        rows = rows.where("large").drop("large")
        if rows.isEmpty():
            break
        rows = staged(_halved(rows), "spelling")
    n = shuffle_width(words.sparkSession)
    middle = F.expr("substring(word, s + 1, length(word) - s - length(suffix))").alias("middle")
    best = (ready.select(*_KEY, middle, "n").repartition(n, *_KEY).sortWithinPartitions(*_KEY, "middle")
            .mapInArrow(_shards, "word string, near long, best_n long, best string"))
    return (best.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best")))


def variants(words: DataFrame, ratio: int = 2, shortest: int = MIN_LETTERS, cells: int = CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words (word, n)``.

    ``form``: the best near word, if its n is at least ``ratio`` times the word's; ``root``: the end of
    the chain of forms.  A form's n grows by ``ratio`` at each step, so a chain is short, and jumping to
    the root of the root halves what is left of it in every round.
    """
    words = staged(words, "spelling-words")
    near = near_words(words, shortest, cells)
    all_words = staged(words.join(near, "word", "left").withColumn("good", F.col("best_n") >= ratio * F.col("n"))
                       .select("word", F.when(F.col("good"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(F.col("good"), F.col("best_n")).alias("form_n")), "spelling-forms")
    links = all_words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = staged(links.join(on, "root", "left"), "spelling-roots")
        links = jumped.select("word", F.coalesce("further", "root").alias("root"))
        if jumped.where("further is not null").isEmpty():
            break
    return (all_words.join(links, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every word of all documents, with the contract's deletions."""
    return variants(vocabulary(read(spark, sf_dir, "documents"), typo=TYPO_MOD))
