"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from relaysync.llm import spelling
from relaysync.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_words(docs, typo=97):
    count = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def naive_variants(words, near):
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def all_near(words):
    near = {w: set() for w in words}
    by_gap = {}
    for w in words:  # two words are near only if they agree after one deletion each, or one of them is the other's deletion
        for v in {w[:i] + w[i + 1:] for i in range(len(w))} | {w}:
            by_gap.setdefault(v, []).append(w)
    for group in by_gap.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def rows(df):
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    return found


def test_op13_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = naive_words(docs)
    assert len(words) > 1000
    assert rows(QUERIES["op13_spelling"](spark, sf)) == naive_variants(words, all_near(words))


def test_near_words_of_every_shard_size(spark):
    rng = random.Random(8)
    letters = "abÀÿ"
    words = {}
    for _ in range(1500):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 9)))
        words[w] = rng.choice([3, 4, 6, 9, 40])
    words.update({"hotstart" + "".join(rng.choice("xyz") for _ in range(rng.randrange(3, 7))): rng.randrange(3, 90) for _ in range(400)})
    words.update({"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "z" * 900: 5, "z" * 899 + "y": 11, "z" * 901: 50})
    near = {w: {v for v in words if one_edit(w, v)} for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for cells in (8, 1 << 14):
        assert rows(spelling.variants(df, cells=cells)) == naive_variants(words, near)


def test_odd_documents(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    docs += [(1, "École ÉCOLE école x7wort Wort-wort éé" * 40), (None, "straße Straße STRASSE × ÷÷÷÷÷÷ " * 9), (2, "abcdefgh " * 30)]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    for typo in (97, 2, 1):
        got = {r.word: r.n for r in spelling.vocabulary(df, typo=typo).collect()}
        assert got == naive_words(docs, typo)
    words = naive_words(docs, 2)
    assert rows(spelling.variants(spelling.vocabulary(df, typo=2))) == naive_variants(words, all_near(words))
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
