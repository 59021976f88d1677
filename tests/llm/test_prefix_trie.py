"""Burst tries against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from relaysync.llm import prefix_trie
from relaysync.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in convs.items()}


def naive_trie(convs):
    members = defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = set()

    def sums(p):
        own = (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        below = [sums(k) for k in kids[p]]
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        sums(())
    return out


def naive_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op11_matches_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert nodes(QUERIES["op11_prefix_trie"](spark, sf)) == naive_trie(naive_rebuilt(ordered(rows)))


def test_bursts_hot_copies_and_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        hot = c % 3 == 0
        rows += [(c, t, "user", f"turn {t}" if hot or rng.random() < 0.6 else f"w{rng.randrange(4)} x") for t in range(30 if hot else rng.randrange(1, 6))]
    rows += [(500, t, "user", f"turn {t}") for t in range(400)]
    rows += [(601, None, None, None), (601, 2, "user", ""), (602, None, "", ""), (None, 1, "user", "lost"), (603, 1, "a", "b"), (603, 1, "a", "b"), (603, 1, "a", "c"),
             (604, 0, "a:b", "c"), (605, 0, "a", "b:c"), (606, 0, "user", "long " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, words string").repartition(5)
    convs = ordered(rows)
    want = naive_trie(convs)
    for capacity in (1, 40, 10 ** 6):
        assert nodes(prefix_trie.prefix_trie(df, capacity)) == want
    assert nodes(prefix_trie.build_trie(prefix_trie.rebuilt(df), ["part", "place"], 60)) == naive_trie(naive_rebuilt(convs))


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).count() == 0
    rows = [(c, 0, "user", "same") for c in range(20, 60) if c % 20]  # their first conversations are absent
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.build_trie(prefix_trie.rebuilt(df), ["part", "place"], 4)) == naive_trie(naive_rebuilt(ordered(rows)))


def test_ends_are_hashed_in_pieces(spark):
    rows = [(k, -k, i * 7 % 1000) for k in (1, 2) for i in range(1000 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "p1 long, p2 long, conv_id long").repartition(4)
    got = {r.p1: r.ends_sha256 for r in prefix_trie._end_digests(df, 4, 9).collect()}
    want = {k: hashlib.sha256(",".join(map(str, sorted(r[2] for r in rows if r[0] == k))).encode()).hexdigest() for k in (1, 2)}
    assert got == want
