"""Operators on documents against brute force over whole small tables."""

import bisect
import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaysync.llm import decontamination, line_dedup, lm_scoring, order_minhash, packing, pii, sharding
from relaysync.llm.arrays import Level, list_buckets, save_arrays
from relaysync.llm.queries import QUERIES

END = "\n</s>"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), s or "")


def tokens(s):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(s)), END]


def kneser_ney(train, texts, order):
    """Dictionary version of the interpolated modified model."""
    start = ["<s>"] * (order - 1)
    top = collections.Counter()
    for t in train:
        seq = start + tokens(t)
        for i in range(order - 1, len(seq)):
            top[tuple(seq[i - order + 1: i + 1])] += 1
    adj = {order: top}
    for k in range(order - 1, 0, -1):
        adj[k] = collections.Counter(g[1:] for g in adj[k + 1])
        for g in adj[k]:  # an n-gram that begins a text has no left neighbours: its raw count
            if g[0] == "<s>":
                adj[k][g] = sum(c for h, c in top.items() if h[-k:] == g)
    raw = collections.Counter()
    for g, c in top.items():
        raw[g[-1]] += c
    types = len(raw)
    disc, ctx = {}, {}
    for k in adj:
        n = collections.Counter(adj[k].values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            disc[k] = [0, *(min(max(x, 0.05), j) for x, j in zip(d, (1, 2, 3)))]
        else:
            disc[k] = [0, 0.5, 1.0, 1.5]
        ctx[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in adj[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][min(c, 3)] += 1
    out = []
    for t in texts:
        seq, total, base = start + tokens(t), 0.0, 0.0
        for i in range(order - 1, len(seq)):
            p = 1 / (types + 1)
            for k in range(1, order + 1):
                g = tuple(seq[i - k + 1: i + 1])
                tot, *n = ctx[k].get(g[:-1], (0, 0, 0, 0))
                if tot:
                    c = adj[k][g]
                    p = max(c - disc[k][min(c, 3)], 0) / tot + sum(a * b for a, b in zip(disc[k][1:], n)) / tot * p
            total += math.log10(p)
            base += math.log10((raw[seq[i]] + 1) / (sum(raw.values()) + types + 1))
        n_tokens = len(seq) - order + 1
        out.append((n_tokens, sum(raw[w] > 0 for w in seq[order - 1:]), base, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_matches_dictionary_model(spark, documents, order):
    docs = documents.filter("length(text) < 1500").select("doc_id", "text").orderBy("doc_id").limit(150)
    rows = docs.collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 for r in rows}
    train = docs.filter(lm_scoring.fold("doc_id", 7) != 2)
    model = lm_scoring.train(train, order=order)
    got = {r.doc_id: r for r in lm_scoring.score(docs, model, ["doc_id"]).collect()}
    want = kneser_ney([r.text for r in rows if fold[r.doc_id] != 2], [r.text for r in rows], order)
    assert model.tokens == sum(len(tokens(r.text)) for r in rows if fold[r.doc_id] != 2)
    for r, (n, known, base, score) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known) == (n, known)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score == pytest.approx(score, rel=1e-9)


def test_lm_query_scores_by_two_words_of_context(spark, documents, sf):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    some = [r for r in rows if r.text and len(r.text) < 1500][:8]
    got = {r.doc_id: r.score for r in QUERIES["op1_lm_scoring"](spark, sf).collect()}
    want = kneser_ney([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2], [r.text for r in some], 3)
    assert [got[r.doc_id] for r in some] == pytest.approx([w[3] for w in want], rel=1e-9)


@pytest.mark.parametrize(("n", "buckets"), [(1, 1), (3, 7), (5000, 1), (5000, 5000), (200_000, 8)])
def test_lm_count_files(tmp_path, n, buckets):
    """Every hash is found with its counts, large ones too; hashes one off are not."""
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    values = [rng.integers(0, 300, len(key)).astype(np.uint64), np.arange(len(key), dtype=np.uint64) ** np.uint64(2)]
    where = lm_scoring.bucket_of(key, buckets).astype(int)
    for b in np.unique(where).tolist():
        own = where == b
        lm_scoring.save_counts(f"{tmp_path}/1-{b}", b, buckets, key[own], [v[own] for v in values])
    list_buckets(str(tmp_path), 1, where.tolist())
    level = lm_scoring.CountLevel(str(tmp_path), 1, buckets)
    for got, v in zip(level.look_up(key[::-1], [1, 2]), values):
        assert np.array_equal(got, v[::-1])
    off = np.setdiff1d(np.concatenate([key + np.uint64(1), key - np.uint64(1)]), key)
    assert not level.look_up(off, [2])[0].any()


def test_lm_packed_rows():
    rng = np.random.default_rng(7)
    ids = [rng.integers(0, top, 4000).astype(np.uint64) for top in (300, 1 << 40, 70_000)]
    back = lm_scoring.expand(lm_scoring.squeeze(ids, [ids[0] * np.uint64(3)]))
    order = np.lexsort(ids[::-1])
    assert all(np.array_equal(b, c[order]) for b, c in zip(back, [*ids, ids[0] * np.uint64(3)]))


@pytest.mark.parametrize(("n", "width"), [(1, 3), (1, 21), (2, 20), (3, 21), (3, 30)])
def test_lm_keys_of_ids(tmp_path, n, width):
    """Keys differ, fill the buckets evenly, and their files give every count back."""
    rng = np.random.default_rng(n * width)
    packed = np.unique(rng.integers(0, 1 << min(n * width, 62), 100_000, dtype=np.uint64))
    ids = [packed >> np.uint64(k * width) & np.uint64((1 << width) - 1) for k in range(n)]
    key, bits = lm_scoring.ids_key(ids, width), lm_scoring.key_bits(n, width)
    assert len(np.unique(key)) == len(packed) and not (key & np.uint64((1 << 64 - bits) - 1)).any()
    where = lm_scoring.bucket_of(key, 8).astype(int)
    if len(packed) > 1000:
        assert np.bincount(where, minlength=8).max() < 1.1 * len(packed) / 8
    key, where = np.sort(key), np.sort(where)
    values = [np.minimum(rng.zipf(2.0, len(key)), 1 << 40).astype(np.uint64) for _ in range(5)]
    for b in np.unique(where).tolist():
        own = where == b
        lm_scoring.save_counts(f"{tmp_path}/1-{b}", b, 8, key[own], [v[own] for v in values], bits)
    list_buckets(str(tmp_path), 1, where.tolist())
    level = lm_scoring.CountLevel(str(tmp_path), 1, 8)
    for got, v in zip(level.look_up(key[::-1], [1, 2, 3, 4, 5]), values):
        assert np.array_equal(got, v[::-1])


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
def test_lm_packed_pairs(n):
    """Rows come back; ids that follow each other and values that are mostly 0 take few bytes."""
    rng = np.random.default_rng(n)
    ids = list(np.unique([rng.zipf(1.3, n).clip(0, 50_000), rng.permutation(n)], axis=1)[:, ::-1].astype(np.uint64))
    values = [(rng.random(n) < 0.01).astype(np.uint64) for _ in range(6)]
    data = lm_scoring.squeeze(ids, values)
    order = np.lexsort(ids[::-1])
    assert all(np.array_equal(b, c[order]) for b, c in zip(lm_scoring.expand(data), [*ids, *values]))
    if n > 10_000:
        assert len(data) < 3 * n


def test_lm_files_are_small(spark):
    """Pairs of ids and their five counts take less than 8 bytes a pair, triples less than 8."""
    rng = np.random.default_rng(3)
    words = rng.zipf(1.2, (400, 300)).clip(0, 20_000)
    model = lm_scoring.train(spark.createDataFrame([(" ".join(map(str, w)),) for w in words.tolist()], "text string"), order=3)
    for level in (2, 3):
        files = [f for f in os.listdir(model.path) if f.startswith(f"{level}-")]
        assert sum(os.path.getsize(f"{model.path}/{f}") for f in files) < 8 * model.counts[level - 1][7]


def test_lm_odd_rows(spark, odd):
    model = lm_scoring.train(odd)
    rows = lm_scoring.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(r.n_tokens >= 1 and r.score <= 0 for r in rows)
    empty = lm_scoring.train(odd.limit(0))
    assert (empty.tokens, empty.types) == (0, 0)
    assert all(r.score == 0.0 for r in lm_scoring.score(odd, empty, ["doc_id"]).collect())


# -- personal data ------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


HARD = ["a@b.c_d@e.f x@y.z.", "..@a.b a@-.- %+@1.2.3", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.004 0255.0.0.1 9999999999.1.1.1", "1.2 3.4.5.6",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110", "+1 (555) 010-9999 +44.20.7946.0958. +1+2+3456789012", "+12345678",
        "é@x.y 😀 mail a.b@c.d 😀 +49 30 1234567890 4111111111111111", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE00370400440532013000",
        "1" * 3000, "a" * 3000, "1." * 2000, "a@" * 500 + "b.c", "+" + "1 " * 4000, "1-" * 6000 + "1"]


def test_pii_matches_regular_expressions(spark, documents):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*HARD, None, ""])], "doc_id long, text string"))
    found = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.kind in PATTERNS] for r in pii.find_pii(docs).collect()}
    some = 0
    for r in docs.collect():
        want = base_spans(r.text)
        some += len(want)
        assert found[r.doc_id] == want, r.text[:200]
    assert some > 50


def test_pii_iban_context_and_mask(spark):
    text = "my iban DE89370400440532013000, not DE00370400440532013000 or GB82 WEST 1234 5698 7654 32"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "pii long, text string").withColumnRenamed("pii", "id")).first()
    ibans = [s for s in r.pii if s.kind == "iban"]
    assert [text[s.start: s.end] for s in ibans] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert ibans[0].score > 0.9
    masked = pii.find_pii(spark.createDataFrame([("x a@b.c y é +4930123456789 z",)], "text string")).select(pii.mask(F.col("text"), F.col("pii"))).first()[0]
    assert masked == "x <email> y é <phone> z"


def test_pii_iban_before_words_and_numbers(spark):
    """What follows an account number, or fails before it, does not hide it."""
    short, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    cases = [(f"{short} Please pay", [short]), (f"{spaced} BIC COBADEFFXXX", [spaced]), (f"{spaced} BIC X", [spaced]),
             (f"{short} 2024-01-02", [short]), (f"é {spaced} 7", [spaced]), (f"{spaced} {short} NO93 8601 1117 947 NO", [spaced, short, "NO93 8601 1117 947"]),
             (f"AT12 {spaced}", [spaced]), ("MT84MALT011000012345MTLCAST001S X", ["MT84MALT011000012345MTLCAST001S"]),
             (f"{short}0", []), (f"X{short}", []), ("DE00370400440532013000 X", []), (short[:-1], [])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [r.text[s.start: s.end] for s in r.pii if s.kind == "iban"] for r in pii.find_pii(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_pii_many_spans_in_one_text(spark):
    """More matches than one run holds: places and digests as if found one after another."""
    text = " ".join(f"é{i}@host{i}.org 10.0.{i % 300}.{i % 7} +1 (555) {1000000 + i}" for i in range(700))
    got = [(x.kind, x.start, x.end) for x in pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii]
    mails = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
           if max(map(int, m[0].split("."))) <= 255]
    assert len(mails) == 700 and len(ips) < 700
    assert [x for x in got if x[0] == "email"] == mails
    assert [x for x in got if x[0] == "ip"] == ips


def test_pii_digest(spark, sf, documents):
    rows = {r.doc_id: r for r in QUERIES["op5_pii"](spark, sf).collect()}
    for r in documents.collect():
        want = base_spans(r.text)
        g = rows[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]


# -- decontamination ------------------------------------------------------------

def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def naive_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - window + 1) if x else 0):
            p = x[i: i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j: j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_naive_search(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(900, "The of and"), (901, "the"), (902, None), (903, "!!"), (904, "the"), (None, "of the")], "item_id long, text string")
    for queries in (items, items.unionByName(extra)):
        known = [tuple(r) for r in queries.select("item_id", "text").collect()]
        got = {r.doc_id: r for r in decontamination.find_contamination(docs, queries, shard_words=5000, block_words=400).collect()}
        for r in docs.collect():
            n, h, ids = naive_hits(r.text[:4000], known)
            g = got[r.doc_id]
            if len(r.text) <= 4000:
                assert (g.n_words, g.n_hit, g["items"]) == (n, h, ids)
                assert g.contaminated == (h > 0 and 20 * h >= n)
    assert sum(r.n_hit > 0 for r in got.values()) > 5


def test_decontamination_odd_rows_and_removal(spark, odd):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(100, 140))), (2, "漢字 \U0001F600")], "item_id long, text string")
    rows = decontamination.find_contamination(odd, items).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[5].n_hit, by[5].contaminated, by[1].n_words, by[8].n_hit) == (40, False, 0, 2)
    cut = decontamination.find_contamination(odd, items).withColumn("text", decontamination.remove_spans(F.col("text"), F.col("spans")))
    r = cut.filter("doc_id = 6").first()
    assert "w99  w140" in r.text and cut.filter("doc_id = 8").first().text.startswith("é ü ")
    assert all(not r.contaminated for r in decontamination.find_contamination(odd, items.limit(0)).collect())


# -- line dedup -------------------------------------------------------------------

def line(i, n=20):
    return " ".join(f"l{i}x{k}" for k in range(n))


def test_line_dedup_keeps_first_and_clean(spark):
    a, b, passage = [line(i) for i in range(8)], [line(i) for i in range(20, 27)], [line(i) for i in range(50, 54)]
    rows = [(1, "\n".join([*a[:3], *passage, *a[3:]])), (2, "\n".join([*b[:2], *passage, *b[2:]])), (3, "\n".join(passage)),
            (4, "\n".join([line(90), line(91), passage[0], line(92)])), (5, line(60, 80)), (6, "x\n" + line(60, 80) + "\ny"),
            (7, None), (8, ""), (9, "short\nlines"), (10, "short\nlines"), (11, "\n".join(passage[1:3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == rows[0][1] and got[2] == "\n".join(b) and got[3] == ""
    assert got[4] == rows[3][1] and got[5] == rows[4][1] and got[6] == "x\ny"
    assert got[7] is None and got[8] == "" and got[10] == "short\nlines"
    assert got[11] == rows[10][1]  # 40 words: fewer than the least passage


def naive_line_dedup(rows, min_words=50):
    """Every repeated pair of lines, and long line; all but the first place go, in runs of min_words."""
    seen, docs = collections.defaultdict(set), {}
    for i, t in rows:
        docs[i] = [x for x in (t or "").split("\n") if x]
        for k, x in enumerate(docs[i]):
            if k + 1 < len(docs[i]):
                seen[(x, docs[i][k + 1])].add((i, k))
            if len(x.split()) >= min_words:
                seen[x].add((i, k))
    gone = collections.defaultdict(set)
    for unit, places in seen.items():
        for i, k in places - {min(places)}:
            gone[i] |= {k, k + 1} if isinstance(unit, tuple) else {k}
    out = {}
    for i, lines in docs.items():
        n = 0
        for flag, run in itertools.groupby(range(len(lines)), key=lambda k, i=i: k in gone[i]):
            run = list(run)
            n += len(run) if flag and sum(len(lines[k].split()) for k in run) >= min_words else 0
        out[i] = n
    return out


def test_line_dedup_matches_naive(spark, documents, sf):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = naive_line_dedup(rows)
    got = {r.doc_id: r.n_removed for r in QUERIES["op10_line_dedup"](spark, sf).collect()}
    assert sum(want.values()) > 100
    assert got == want


def test_line_dedup_one_copy_with_empty_lines(spark):
    """A copy that differs in empty lines only is a copy, and hides no other."""
    passage = [line(i) for i in range(4)]
    rows = [(i, "\n".join([line(100 + i), *passage, line(200 + i)])) for i in range(1, 7)]
    rows += [(7, "\n\n".join([line(107), *passage, line(207)])), (8, "\n\n\n".join(passage[:2]) + "\n" + "\n".join(passage[2:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, info=True).collect()}
    assert {i: r.n_removed for i, r in got.items()} == naive_line_dedup(rows) == {1: 0, **dict.fromkeys(range(2, 9), 4)}
    assert got[2].text == f"{line(102)}\n{line(202)}" and got[7].text == f"{line(107)}\n\n{line(207)}" and got[8].text == ""


def test_line_dedup_units_that_share_a_hash(tmp_path):
    """Each of them keeps its own least place."""
    rows = [(0, 5, 3, 30, 1, b"a"), (0, 5, 1, 10, 2, b"b"), (0, 5, 2, 20, 0, b"a"), (0, 5, 4, 40, 0, b"b"), (0, 9, 1, 10, 7, b"c")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=line_dedup._names(line_dedup._UNIT))
    list_buckets(str(tmp_path), 2, [b for out in line_dedup._compare_map(str(tmp_path))([batch]) for b in out.column(0).to_pylist()])
    keys, ids, dk, lines = (np.array(c, dtype=np.int64) for c in zip(*(r[1:5] for r in rows)))
    held = Level(str(tmp_path), 2, 1).holds(keys.view(np.uint64), line_dedup._place_hash(ids, dk, lines))
    assert held.tolist() == [False, True, True, False, True]


def test_near_dedup_rows_of_one_id(spark):
    """Two texts of one id are two documents: neither is classed with the other's copies nor dropped for them."""
    a, b = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    rows = [(4, a), (4, b), (5, a + " more"), (4, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in order_minhash.drop_near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(4, a), (4, b)]
    assert {(r.doc_id, r.class_id, r.kept) for r in order_minhash.find_classes(docs).collect()} == {
        (4, 4, True), (5, 4, False), (None, None, True)}


def test_near_dedup_short_texts_lose_no_link(spark):
    """Eight words against the same and a ninth: similarity 0.8 exactly, at either end."""
    rows = []
    for i in range(1500):
        words = [f"w{i}x{k}" for k in range(9)]
        rows += [(3 * i, " ".join(words[:8])), (3 * i + 1, " ".join(words))]
    got = order_minhash.find_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id - r.doc_id % 3 for r in got) and len(got) == len(rows)


def test_absent_files_are_not_empty_levels(tmp_path):
    with pytest.raises(FileNotFoundError):
        Level(str(tmp_path), 1, 4)
    with pytest.raises(FileNotFoundError):
        decontamination.block_files(str(tmp_path))
    save_arrays(f"{tmp_path}/1-0", [np.array([5], dtype=np.uint64)])
    list_buckets(str(tmp_path), 1, [0, 3])
    level = Level(str(tmp_path), 1, 4)
    assert level.contains(np.array([5, 6, 1 << 62], dtype=np.uint64)).tolist() == [True, False, False]  # bucket 1 holds nothing
    with pytest.raises(FileNotFoundError):  # bucket 3 is listed
        level.contains(np.array([(1 << 64) - 1], dtype=np.uint64))


def test_line_dedup_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    by = {r.bucket: r for r in out.collect()}
    assert by[6].text == by[7].text and by[5].text is None  # repeated rows are one document
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# -- near duplicates ----------------------------------------------------------------

def labelled(text, k=5):
    w, seen, out = words(text), collections.Counter(), []
    for g in ([tuple(w[i: i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []):
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def naive_similarity(a, b):
    at = {x: j for j, x in enumerate(b)}
    tails = []
    for j in (at[x] for x in a if x in at):
        k = bisect.bisect_left(tails, j)
        tails[k: k + 1] = [j]
    return len(tails) / (len(a) + len(b) - len(tails)) if a and b else 0.0


def naive_classes(rows, threshold=0.8):
    seqs = {i: labelled(t) for i, t in rows}
    sets = {i: set(s) for i, s in seqs.items()}
    parent = {i: i for i in seqs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(seqs), 2):
        small, large = sorted((len(seqs[a]), len(seqs[b])))
        if small and small >= threshold * large and len(sets[a] & sets[b]) >= threshold * large:
            if naive_similarity(seqs[a], seqs[b]) >= threshold and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in seqs}


def test_near_duplicates_match_brute_force(spark, documents, sf):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = naive_classes(rows)
    got = {r.doc_id: r.class_id for r in QUERIES["op8_near_dedup"](spark, sf).collect()}
    assert len(set(want.values())) < len(want) - 20
    assert got == want


def test_chain_of_variants_and_small_groups(spark):
    """A hot bucket whose members link only along a chain; groups far smaller than it."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(0, 2 * i, 2):
            w[k % 120] = f"v{i // 3}_{k}"
        rows.append((i * 7 + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.find_classes(docs, group=4, block=8).collect()}
    assert got == naive_classes(rows)


def test_near_duplicates_odd_rows(spark, odd):
    rows = order_minhash.find_classes(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.kept))
    assert by[4] == {(3, False)} and by[6] == {(5, False)} and by[None] == {(None, True)} and by[1] == {(1, True)}
    kept = order_minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 7, 8, 9, 10]
    assert order_minhash.find_classes(odd.limit(0)).count() == 0


# -- packing --------------------------------------------------------------------------

def test_packing_is_whole_and_tight(spark, documents, sf):
    rows = QUERIES["op7_packing"](spark, sf).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in itertools.pairwise(pieces)) and pieces[0].bin_offset == 0
        used = sum(r.n_tokens for r in pieces)
        assert pieces[0].bin_length == min(c for c in packing.LENGTHS if c >= used)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == {r.doc_id: len(tokens(r.text)) for r in documents.collect()}
    assert sum(r.n_tokens for r in rows) / sum(b[0].bin_length for b in bins.values()) > 0.95


def naive_best_fit(sizes, lengths, overhead):
    left, bins, where = sum(sizes), [], []
    for s in sizes:
        fits = [(b[0] - b[1], -k) for k, b in enumerate(bins) if b[0] - b[1] >= s]
        if fits:
            k = -min(fits)[1]
        else:
            c = min((c for c in lengths if c >= s), key=lambda c: ((c + overhead) / min(c, max(s, left)), c))
            bins.append([c, 0])
            k = len(bins) - 1
        bins[k][1] += s
        left -= s
        where.append(k)
    return [min(c for c in lengths if c >= u) for _, u in bins]


def test_best_fit_against_naive(documents):
    sizes = sorted([len(tokens(r.text)) for r in documents.select("text").limit(400).collect() if r.text], reverse=True)
    sizes = [min(s, 8192) for s in sizes]
    got = packing.best_fit(sizes, packing.LENGTHS)
    assert sorted(got[2]) == sorted(naive_best_fit(sizes, packing.LENGTHS, packing.OVERHEAD))


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, (16, 64)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(tokens(r.text)) for r in odd.collect())
    assert packing.pack(odd.limit(0)).count() == 0


# -- sharding --------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark, documents, sf):
    rows = QUERIES["op9_sharding"](spark, sf).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) == set(range(24))
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    share = sum(size.values()) / 24
    largest = max(len(t) for t in texts.values()) + 8
    assert all(abs(s - share) <= largest + 0.002 * share for s in size.values())


def test_splitters_match_a_full_sort(spark):
    keys = [(int(x), 1 + x % 7) for x in ((i * 2654435761) % (1 << 60) for i in range(5000))] + [(77, 3)] * 2000
    df = spark.createDataFrame(keys, "key long, size long")
    cuts = sharding.find_splitters(df, 6, tolerance=0.0)
    total = sum(s for _, s in keys)
    below = [sum(s for k, s in keys if k < c) for c in cuts]
    assert cuts == sorted(cuts)
    for i, b in enumerate(below):
        goal = total * (i + 1) / 6
        steps = sorted({0, *itertools.accumulate(s for _, s in sorted(collections.Counter({k: 0 for k, _ in keys}).items()))})
        assert abs(b - goal) <= 6000 if goal < 6200 else abs(b - goal) <= 7, (i, b, goal, len(steps))


def test_sharding_odd_rows(spark, odd, tmp_path):
    rows = sharding.assign(odd, 4).collect()
    assert len(rows) == odd.count()
    assert sharding.assign(odd.limit(0), 4).count() == 0
    sharding.write_shards(odd, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards")).drop("shard")
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
