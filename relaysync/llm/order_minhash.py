"""Near duplicates by order MinHash, verified by banded alignment.

Shingles are ``K`` lower-cased words, labelled with their occurrence number in
the text, so a text is a sequence of distinct symbols.  A sketch holds the
``PICK`` shingles of least hash under one of ``SKETCHES`` orders, joined in
text order: two texts share it only if both the shingles and their order
agree, which follows edit similarity.  Texts that share a sketch are
candidates.

The similarity of a pair is L / (n1 + n2 - L), with L the longest common
subsequence of the labelled shingles: Jaccard similarity that respects order.
Any alignment that reaches ``THRESHOLD`` keeps matched positions within a band
around the diagonal, so only matches inside it are aligned.

Equal texts are one class by SHA-256; a class is known by a number of its own, so two texts of one id stay apart.  (1) Every class of a sketch
bucket is aligned with the bucket's leader (a star, no pairs), the member that
shares most buckets with others, in groups of at most ``GROUP`` members,
whatever the bucket's size; the links' components join most of each bucket.  (2) Buckets whose members are then still in several
components are compared in full, block by block, the classes outside the
bucket's largest component against all: pairs with enough shingles in common
are aligned, and only a spanning forest of what links is kept.  So no bucket
has a cap.  What sketches can miss are pairs that share none of them: of those at the threshold 5e-8
in long texts (each sketch is shared with chance 0.8 ** 4), 2e-6 where they have ten shingles together.
Texts of at most ``SHORT`` shingles, of which one is the other and one more, are found for certain: such texts also
bear a hash of their whole sequence and of it with each one shingle left out.  Four picks, since texts that only share a common passage must not meet: where
it is a share f of both, f ** 4 of them are in one bucket.

Defined results: texts without words (null or empty too) and rows without id
link with nothing; texts of fewer words than ``K`` are one shingle; a class's
id is its least doc_id; repeated rows are copies.  Rows of one id with different texts are documents of
their own; a class keeps the row of least id, of several texts that of least SHA-256 (two classes may then bear one id).
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.arrays import Level, grouped, write_set
from relaysync.llm.common import own_columns, posix_dir, read, shuffle_width, slices, staged, text_buffer
from relaysync.llm.components import components
from relaysync.llm.tokens import ALNUM_WORDS, join_hash, mix, span_hashes, word_spans

K = 5
SKETCHES = 32
PICK = 4
THRESHOLD = 0.8
SHORT = 9
GROUP = 128
BLOCK = 512
SLICE_BYTES = 2 << 20
_TIE = 1e-12
_ORDERS = mix(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)


def labelled_shingles(buf, off, k: int = K):
    """(hash of shingle and occurrence, row) in text order for all rows."""
    s, e, row = word_spans(buf, off, ALNUM_WORDS)
    h, n = span_hashes(buf, s, e), len(off) - 1
    words = np.bincount(row, minlength=n)
    begin = np.cumsum(words) - words
    size = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    out_row = np.repeat(np.arange(n), size)
    at = np.arange(len(out_row)) - np.repeat(np.cumsum(size) - size, size) + begin[out_row]
    key = h[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, k):
        more = at + j < begin[out_row] + words[out_row]
        nxt = h[np.minimum(at + j, len(h) - 1)] if len(h) else key
        key = np.where(more, join_hash(key, nxt), key)
    # occurrence number among equal shingles of a row, in text order
    order = np.argsort(join_hash(key, out_row.astype(np.uint64)), kind="stable")
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (out_row[order][1:] == out_row[order][:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = (np.arange(len(order)) - start).astype(np.uint64)
    return join_hash(key, label), out_row


def sketches(keys: np.ndarray, row: np.ndarray, n: int, count: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """(n, count) sketch hashes of rows of labelled shingles (rows without any hold 0).

    Per order, shingles below a limit that leaves about ``8 * pick`` a row are
    sorted; a row that the limit leaves too few is sorted whole.
    """
    out = np.zeros((n, count), dtype=np.uint64)
    if not len(keys):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, len(row)))
    rows, group = row[first], np.repeat(np.arange(len(first)), size)
    share = np.minimum(8 * pick / size, 0.999999)
    limit = np.where(size <= 8 * pick, np.uint64(0xFFFFFFFFFFFFFFFF), (share * 2.0**64).astype(np.uint64))[group]
    need = np.minimum(size, pick)
    for i in range(count):
        v = keys * _ORDERS[i]
        at = np.flatnonzero(v <= limit)
        few = np.flatnonzero(np.bincount(group[at], minlength=len(first)) < need)
        if len(few):
            at = np.union1d(at, np.flatnonzero(np.isin(group, few)))
        at = at[np.lexsort((v[at], group[at]))]
        left = np.bincount(group[at], minlength=len(first))
        least = at[(np.cumsum(left) - left)[:, None] + np.minimum(np.arange(pick), need[:, None] - 1)]
        least.sort(axis=1)
        h = np.full(len(first), i, dtype=np.uint64)
        for k in range(pick):
            h = join_hash(h, keys[least[:, k]])
        out[rows, i] = h
    return out


def short_keys(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the sequences of 4 to ``SHORT`` shingles: whole, and with each one left out."""
    size = np.bincount(row, minlength=n)
    begin = np.cumsum(size) - size
    rows, hashes = [], []
    for m in range(4, SHORT + 1):
        of = np.flatnonzero(size == m)
        seq = keys[begin[of][:, None] + np.arange(m)] if len(of) else np.zeros((0, m), np.uint64)
        for out in range(m + 1):  # m leaves out nothing
            h = np.full(len(of), 0x5107, dtype=np.uint64)
            for k in range(m):
                if k != out:
                    h = join_hash(h, seq[:, k])
            rows.append(of)
            hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Order-respecting Jaccard similarity of two labelled sequences; 0.0 where it is below ``threshold``."""
    return _aligned(a, np.argsort(b), b, threshold)


def _aligned(a, order_b, b, threshold) -> float:
    n1, n2 = len(a), len(b)
    if min(n1, n2) < threshold * max(n1, n2):
        return 0.0
    need = threshold * (n1 + n2) / (1 + threshold)
    at = order_b[np.minimum(np.searchsorted(b, a, sorter=order_b), n2 - 1)]
    i = np.flatnonzero(b[at] == a)
    j = at[i]
    inside = np.abs(i - j) <= n1 + n2 - 2 * need + 1
    j = j[inside]
    if len(j) < need - 1e-9:
        return 0.0
    if (j[1:] > j[:-1]).all():
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect.bisect_left(tails, x)
            tails[k: k + 1] = [x]
        length = len(tails)
    sim = length / (n1 + n2 - length)
    return sim if sim >= threshold - _TIE else 0.0


# -- passes over the texts ----------------------------------------------------

def _sketch_map(k: int, count: int):
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                n = hi - lo
                keys, row = labelled_shingles(buf, off[lo: hi + 1], k)
                more, extra = short_keys(keys, row, n)
                of = np.concatenate([np.repeat(np.arange(n), count), more])
                flat = np.concatenate([sketches(keys, row, n, count).ravel(), extra])[np.argsort(of, kind="stable")]
                cut = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                size = np.bincount(row, minlength=n)
                yield pa.record_batch([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(size.astype(np.int32)),
                                       pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.view(np.int64)))],
                                      names=["id", "digest", "n", "sk"])

    return run


def _sequence_map(path: str, buckets: int, k: int):
    """(id, digest, labelled shingles) of the texts whose id is wanted."""
    def run(batches):
        wanted = Level(path, 1, buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mask = wanted.contains(mix(ids.view(np.uint64)))
            if not mask.any():
                continue
            part = batch.filter(pa.array(mask))
            buf, off = text_buffer(part.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                keys, row = labelled_shingles(buf, off[lo: hi + 1], k)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.record_batch([part.column(0).slice(lo, hi - lo), part.column(2).slice(lo, hi - lo),
                                       pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                                      names=["id", "digest", "seq"])

    return run


# -- comparison in groups -------------------------------------------------------

_LINKS = "u long, v long"


def _links_batch(pairs) -> pa.RecordBatch:
    return pa.record_batch([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])


def _star_map(threshold: float):
    """Rows (leader, salt, member, id, seq), the leader's own first: the members that link to it."""
    def run(batches):
        now, lead, order = None, None, None
        for batch in batches:
            out = []
            for leader, salt, member, i, seq in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.frombuffer(seq, dtype=np.uint64)
                if not member:
                    now, lead, order = (leader, salt), a, np.argsort(a)
                elif now == (leader, salt) and _aligned(a, order, lead, threshold) >= threshold - _TIE:
                    out.append((leader, i))
            if out:
                yield _links_batch(out)

    return run


def _block_links(rows, threshold: float):
    """Links between different parts of one pair of blocks: (part, id, seq, small) rows.

    Common shingles are counted against a whole block at once; only pairs that
    have enough of them for the threshold are aligned.
    """
    few, rest = [r for r in rows if r[3]], [r for r in rows if not r[3]]
    if not few or not rest:
        return []
    seqs = [np.frombuffer(s, dtype=np.uint64) for _, _, s, _ in rest]
    sizes = np.array([len(s) for s in seqs], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    symbols, codes = np.unique(np.concatenate(seqs), return_inverse=True)
    mark = np.zeros(len(symbols), dtype=np.int32)
    joined: dict[int, int] = {}

    def find(x):
        while joined.setdefault(x, x) != x:
            x = joined[x]
        return x

    out = []
    for part, i, s, _ in few:
        a = np.frombuffer(s, dtype=np.uint64)
        at = np.minimum(np.searchsorted(symbols, a), len(symbols) - 1)
        own = at[symbols[at] == a]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], first)
        mark[own] = 0
        near = common >= threshold * (len(a) + sizes) / (1 + threshold) - 1e-9
        for k in np.flatnonzero(near).tolist():
            x, y = find(part), find(rest[k][0])
            if x != y and similarity(a, seqs[k], threshold) >= threshold - _TIE:
                joined[max(x, y)] = min(x, y)
                out.append((i, rest[k][1]))
    return out


def _block_map(threshold: float):
    def run(batches):
        for _, rows in grouped(batches, 3):
            if out := _block_links(rows, threshold):
                yield _links_batch(out)

    return run


def _unresolved(member: DataFrame, links: DataFrame, threshold: float, seqs: DataFrame, block: int) -> DataFrame:
    """Links inside buckets whose members (but the leader) are in several components."""
    parts = components(links, "omh-parts")
    placed = staged(member.filter("id <> leader").join(parts.withColumnRenamed("node", "id"), "id", "left")
                    .select("bucket", "id", F.coalesce("component", "id").alias("part")), "omh-placed")
    per = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    open_ = (per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most"),
                                       F.max_by("part", F.struct("n", "part")).alias("big")).filter("parts > 1")
             .select("bucket", "big", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("ni"),
                     F.ceil(F.col("all") / block).cast("int").alias("nj")))
    cut = placed.join(open_, "bucket").withColumn("h", F.xxhash64("id"))
    small = (cut.filter("part <> big").withColumn("i", F.pmod("h", "ni").cast("int"))
             .select("bucket", "i", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "part", "id", F.lit(True).alias("small")))
    rest = (cut.withColumn("j", F.pmod("h", "nj").cast("int"))
            .select("bucket", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), "j", "part", "id", F.lit(False).alias("small")))
    # by name: the two generators put i and j in different places
    rows = small.unionByName(rest).join(seqs, "id").select("bucket", "i", "j", "part", "id", "seq", "small")
    return (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(_block_map(threshold), _LINKS))


def _digest(column: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{column}`"), F.lit("")), 256))


def _classified(docs: DataFrame, id_col: str, column: str, threshold: float, k: int, count: int, group: int, block: int) -> DataFrame:
    """(id, digest, class_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = own_columns(docs, id_col, column).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").alias("text"),
                                                    _digest(column).alias("digest"))
    signed = staged(rows.mapInArrow(_sketch_map(k, count), "id long, digest binary, n int, sk array<long>"), "omh-sketches")
    usable = signed.filter("id is not null and n > 0")
    classes = staged(usable.groupBy("digest").agg(F.min("id").alias("cid"), F.first("sk").alias("sk"))
                     .withColumn("node", F.monotonically_increasing_id()), "omh-classes")
    entries = staged(classes.select(F.col("node").alias("id"), F.explode("sk").alias("bucket")).distinct(), "omh-entries")
    # buckets of two or more classes; those of the same members are one
    buckets = (entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least"),
                                             F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"))
               .filter("size > 1").groupBy("size", "least", "members").agg(F.min("bucket").alias("bucket"), F.count("*").alias("same"))
               .select("bucket", (F.col("size") * F.col("same")).alias("company")))
    shared = staged(entries.join(buckets, "bucket"), "omh-shared")
    # a bucket's leader is its member with the most company in all buckets: an original rather than one of its variants
    weight = shared.groupBy("id").agg(F.sum("company").alias("weight"))
    heads = (shared.join(weight, "id").groupBy("bucket")
             .agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("leader")))
    member = staged(shared.select("bucket", "id").join(heads, "bucket"), "omh-members")

    # whole sequences of the classes that have a candidate, read once more from the table
    wanted = classes.join(member.select(F.col("id").alias("node")).distinct(), "node").select("cid", "digest", "node")
    files = max(shuffle_width(spark), classes.count() // 2_000_000)
    path = posix_dir(spark, "omh-ids")
    write_set(wanted.select("cid").distinct(), path, files)
    seqs = staged(rows.filter("id is not null").mapInArrow(_sequence_map(path, files, k), "id long, digest binary, seq binary")
                  .filter("octet_length(seq) > 0").dropDuplicates(["id", "digest"])
                  .join(wanted.withColumnRenamed("cid", "id"), ["id", "digest"]).select(F.col("node").alias("id"), "seq"), "omh-sequences")

    star = member.filter("id <> leader").select("leader", "id").distinct()
    salts = star.groupBy("leader").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    edges = (star.join(salts, "leader")
             .select("leader", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "id"))
    lead = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"),
                         F.col("leader").alias("id"))
    links = staged(edges.union(lead).join(seqs, "id").select("leader", "salt", "member", "id", "seq")
                   .repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
                   .mapInArrow(_star_map(threshold), _LINKS), "omh-links")
    more = staged(_unresolved(member, links, threshold, seqs, block), "omh-more-links")
    found = components(links.union(more), "omh-components")

    named = (classes.select("digest", "cid", "node").join(found, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    first = named.groupBy("component").agg(F.min(F.struct("cid", "digest")).alias("first"))
    named = named.join(first, "component").select("digest", "first")
    linked = (usable.select("id", "digest").join(named, "digest")
              .select("id", "digest", F.col("first.cid").alias("class_id"),
                      ((F.col("id") == F.col("first.cid")) & (F.col("digest") == F.col("first.digest"))).alias("kept")))
    alone = signed.filter("id is null or n = 0").select("id", "digest", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def find_classes(docs: DataFrame, id_col: str = "doc_id", column: str = "text", threshold: float = THRESHOLD, k: int = K,
                 count: int = SKETCHES, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id (the class's least id), kept (whether it is the row, or a copy
    of its id, that stands for the class)."""
    return (_classified(docs, id_col, column, threshold, k, count, group, block)
            .select(F.col("id").alias(id_col), "class_id", "kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", column: str = "text", threshold: float = THRESHOLD, k: int = K,
                         count: int = SKETCHES, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (of repeated rows, one); all columns as they were."""
    found = _classified(docs, id_col, column, threshold, k, count, group, block)
    key, digest = (next(f"_{n}{i}" for i in range(len(docs.columns) + 1) if f"_{n}{i}" not in docs.columns) for n in ("id", "digest"))
    kept = (found.filter("kept and id is not null").select(F.col("id").alias(key), F.col("digest").alias(digest)).distinct())
    known = (docs.withColumns({key: F.col(f"`{id_col}`").cast("long"), digest: _digest(column)})
             .join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return known.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.8."""
    return find_classes(read(spark, sf_dir, "documents"))
