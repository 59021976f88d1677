"""Prefix tree of conversations by burst tries.

The tree starts as one container of all conversations under the root.  A
container whose suffixes hold more than ``capacity`` turns bursts: its top
becomes a head, and its members go on by their next turn id into containers of
their own.  Whether a container bursts depends on its size alone, so all
bursts are decided by one count: the turns below each prefix.  What remains
are containers of at most ``capacity`` turns; each is sorted by its suffixes
and swept once, adjacent suffixes closing and opening nodes where they part.

Heads may be as large as the table (the root is a member list of everything, a
much copied conversation is a chain of heads), so nothing of a head is ever
gathered: its counts are aggregates, and the sums over its subtree run along
the turns of the conversations that name nodes below it.  Conversations of any
length stay rows of one turn each; ``ordered`` cuts long ones into segments.

A prefix is known by two 64-bit lanes, each the xor over its turns of a hash
of (SHA-256 of role and text, position).

Defined results: null role or text is empty; rows without conv_id belong to
no conversation; turns that tie in ``turn`` are ordered by their digest (equal
rows stay repeated turns); an empty table has no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.llm.arrays import grouped
from relaysync.llm.common import read, shuffle_width, staged
from relaysync.operators.ordered import running, segmented

CAPACITY = 4096
PIECE_IDS = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, tid, words): the turns of each conversation in order, texts as digests."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256), 1, 32)).alias("tid"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"))  # splits equal rows, which are interchangeable
    order = [F.col("turn").asc_nulls_first(), F.col("tid"), F.col("row")]
    # written first: cutting ranges reads its input twice, and texts should be read once
    seg = segmented(staged(rows, "trie-digests"), ["conv_id"], order, "trie-turns")
    return running(seg, ["conv_id"], order, {"pos": ("sum", F.lit(1).cast("long"))}).select("conv_id", "pos", "tid", "words")


def _element(lane: int):
    """Hash of a turn at its place; 0 for the root."""
    parts = ["tid", "pos"] if lane == 1 else [F.lit("second lane"), "pos", "tid"]
    return F.when(F.col("pos") > 0, F.xxhash64(*parts)).otherwise(F.lit(0).cast("long"))


def _prefixes(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of conversations by (conv_id, ``order``), the root's first: with pos, both lanes and the turns that are left."""
    order, key, one = [F.col(c) for c in order], ["conv_id"], F.lit(1).cast("long")
    seg = segmented(rows, key, order, "trie-rows")
    r = running(seg, key, order, {"pos": ("sum", one)}).withColumn("pos", F.col("pos") - 1)
    r = running(r, key, order, {"p1": ("xor", _element(1)), "p2": ("xor", _element(2))})
    r = running(r, key, order, {"left": ("sum", one)}, backward=True)
    return r.select("conv_id", "pos", "tid", "words", "p1", "p2", "left")


def _sweep(members: list, depth: int):
    """Nodes of a container: rows of NODE, the top first; ``members``: (turn ids, conv_id, words)."""
    members.sort(key=lambda m: (m[0], m[1]))
    done, stack, before = [], [], ()

    def close():
        node = stack.pop()
        conv, n, children, leaves, saved, words, ends, at = node
        saved += (n - 1) * words
        leaves = leaves if children else 1
        ends.sort()
        for k in children:
            done[k][2] = conv
        done.append([conv, at, None, n, len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()])
        if stack:
            up = stack[-1]
            up[0], up[1], up[3], up[4] = min(up[0], conv), up[1] + n, up[3] + leaves, up[4] + saved
            up[2].append(len(done) - 1)

    for ids, conv, words in members:
        same = 0
        for a, b in zip(ids, before):
            if a != b:
                break
            same += 1
        while len(stack) > same:
            close()
        for k in range(same, len(ids)):
            stack.append([conv, 0, [], 0, 0, words[k], [], depth + k])
        # members are counted where they end and passed up on closing
        last = stack[-1]
        last[0], last[1] = min(last[0], conv), last[1] + 1
        last[6].append(conv)
        before = ids
    while stack:
        close()
    return done[::-1]


def _sweeps(batches):
    """Container rows (p1, p2, q1, q2, conv_id, pos, tids, words) in order of container: its nodes."""
    out = []

    def emit():
        cols = list(zip(*out))
        types = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)],
                               names=[*(f.split()[0] for f in NODE.split(", ")), "q1", "q2"])

    for _, rows in grouped(batches, 2):
        nodes = _sweep([(tuple(r[4]), r[2], r[5]) for r in rows], rows[0][3])
        out += [(*n, *(rows[0][:2] if k == 0 else (None, None))) for k, n in enumerate(nodes)]
        if len(out) >= 8192:
            yield emit()
            out.clear()
    if out:
        yield emit()


def _pieces(most: int):
    def run(batches):
        for batch in batches:
            runs, now = [], None
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (a, b) != now or len(runs[-1][3]) >= most:
                    now = (a, b)
                    runs.append((a, b, c, []))
                runs[-1][3].append(str(c))
            if runs:
                cols = list(zip(*runs))
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array([",".join(x) for x in cols[3]], pa.string())],
                                      names=["p1", "p2", "at", "ids"])

    return run


def _digests(batches):
    """Sorted (p1, p2, at, ids) rows: SHA-256 of all ids of a prefix, fed piece by piece."""
    now, h, out = None, None, []
    for batch in batches:
        for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b) != now:
                if now:
                    out.append((*now, h.hexdigest()))
                now, h = (a, b), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    if now:
        out.append((*now, h.hexdigest()))
    cols = list(zip(*out)) if out else [(), (), ()]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["p1", "p2", "ends_sha256"])


def _end_digests(rows: DataFrame, n: int, most: int = PIECE_IDS) -> DataFrame:
    """(p1, p2, ends_sha256): ids of a much shared end are joined to pieces by many tasks, one task hashes the pieces."""
    pieces = (rows.select("p1", "p2", "conv_id").repartitionByRange(n, "p1", "p2", "conv_id")
              .sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(_pieces(most), "p1 long, p2 long, at long, ids string"))
    return (pieces.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "at")
            .mapInArrow(_digests, "p1 long, p2 long, ends_sha256 string"))


def build_trie(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The nodes (columns NODE) of conversations given as turns (conv_id, tid, words) by (conv_id, ``order``).

    Each conversation begins with one row for the root (its tid and words are
    not read), so that conversations without turns are members of the root.
    """
    n = shuffle_width(rows.sparkSession)
    r = staged(_prefixes(rows, order), "trie-prefixes")
    # every burst at once: a prefix with more than ``capacity`` turns below it is a head
    heads = staged(r.groupBy("p1", "p2").agg(F.sum("left").alias("size"), F.max("pos").alias("depth"))
                   .where((F.col("size") > capacity) | (F.col("depth") == 0)).select("p1", "p2", F.lit(True).alias("head")), "trie-heads")
    q = [F.col(f"p{k}").bitwiseXOR(_element(k)).alias(f"q{k}") for k in (1, 2)]
    r = staged(r.join(heads, ["p1", "p2"], "left").select("*", *q), "trie-marked")

    # containers: a member's suffix is no longer than its container, so at most ``capacity`` turns
    suffix = (r.where("head is null").groupBy("conv_id")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "p1", "p2", "q1", "q2", "tid", "words"))).alias("s"))
              .select(*[F.col("s")[0][c].alias(c) for c in ("p1", "p2", "q1", "q2")], "conv_id", F.col("s")[0]["pos"].alias("pos"),
                      F.col("s.tid").alias("tids"), F.col("s.words").alias("words")))
    swept = staged(suffix.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2")
                   .mapInArrow(_sweeps, NODE + ", q1 long, q2 long"), "trie-swept")
    tops = swept.where("q1 is not null")

    on_heads = r.where("head")
    head = staged(on_heads.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2")), "trie-head-nodes")
    children = (head.where("depth > 0").select("q1", "q2").union(tops.select("q1", "q2")).groupBy("q1", "q2").agg(F.count("*").alias("n_children"))
                .withColumnsRenamed({"q1": "p1", "q2": "p2"}))
    head = head.join(children, ["p1", "p2"], "left").fillna(0, ["n_children"])
    # each node's own share stands at the conversation that names it, and runs up that conversation's heads
    shares = (head.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                          (F.col("n_children") == 0).cast("long").alias("leaves"))
              .union(tops.select("conv_id", "depth", "saved_tokens", "n_leaves")))
    zero = F.lit(0).cast("long")
    line = (on_heads.join(shares.select("conv_id").distinct(), "conv_id", "left_semi")
            .select("conv_id", "pos", F.lit(0).alias("kind"), "p1", "p2", zero.alias("saved"), zero.alias("leaves"))
            .union(shares.groupBy("conv_id", "depth").agg(F.sum("saved"), F.sum("leaves"))
                   .select("conv_id", "depth", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long"), "sum(saved)", "sum(leaves)")))
    by = [F.col("pos"), F.col("kind")]
    sums = (running(segmented(line, ["conv_id"], by, "trie-shares"), ["conv_id"], by,
                    {"saved_tokens": ("sum", F.col("saved")), "n_leaves": ("sum", F.col("leaves"))}, backward=True)
            .where("kind = 0").groupBy("p1", "p2").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")))
    ends = _end_digests(on_heads.where("left = 1"), n)
    names = head.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    head = (head.join(sums, ["p1", "p2"]).join(ends, ["p1", "p2"], "left")
            .join(names.withColumn("_up", F.lit(1)), (head["q1"] == names["q1"]) & (head["q2"] == names["q2"]) & (head["depth"] > 0), "left"))
    cols = [f.split()[0] for f in NODE.split(", ")]
    return (head.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*cols)
            .union(swept.where("q1 is null").select(*cols))
            .union(tops.drop("parent_conv_id").join(names, ["q1", "q2"]).select(*cols)))


def prefix_trie(conversations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the conversations as they are (conv_id, turn, role, text)."""
    t = staged(turns(conversations), "trie-input")
    root = t.where("pos = 1").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("words"))
    return build_trie(root.unionByName(t).withColumnRenamed("pos", "place"), ["place"], capacity)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, part, place, tid, words): h turns of conversation c - c % 20, then c's own after its first h; a root row each."""
    t = staged(turns(conversations), "trie-input")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    # one row for each conversation, and at most three turns of each tenth part: no long conversation is copied
    convs = t.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    base = t.where((F.col("pos") <= 3) & (F.col("conv_id") % 20 == 0)).select(F.col("conv_id").alias("base"), "pos", "tid", "words")
    zero = F.lit(0).cast("long")
    return (convs.select("conv_id", F.lit(0).alias("part"), zero.alias("place"), F.lit(None).cast("binary").alias("tid"), zero.alias("words"))
            .union(convs.join(base, "base").where("pos <= h").select("conv_id", F.lit(1), "pos", "tid", "words"))
            .union(t.where(F.col("pos") > h).select("conv_id", F.lit(2), "pos", "tid", "words")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations."""
    return build_trie(rebuilt(read(spark, sf_dir, "conversations")), ["part", "place"])
