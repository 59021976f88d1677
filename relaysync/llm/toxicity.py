"""Toxicity: a convolutional text classifier in numpy, scored over whole texts.

Words and their beginnings of ``PREFIXES`` bytes are hashed, and a word's
embedding is the sum of the rows of its hashes, so that inflected and joined
forms share a stem's row; hashes that fewer than ``MIN_DOCS`` training texts
hold have the zero row.  Filters of widths 1 to 3 slide over the embeddings,
each filter's response is rectified and max-pooled over the whole text, and a
logistic unit reads the pooled values.  Both labels weigh the same in
training, whatever their numbers.

Trained on the driver on a bounded sample: ``PER_CLASS`` texts of each label.
Thresholds by language come from all labelled rows of a fifth of the ids, which
a first network never saw: it scores them in Spark, and each language's cut is
the one of best F1 over ``BINS`` bins of the score (that of all languages
together where one has fewer than ``LEAST`` rows of a label).  Then the network
is trained again on the whole sample.  The language column serves the
thresholds only; scores come from the text.

Defined results: null and empty texts are scored as texts without a known
word; without labelled rows of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaysync.llm.common import fold, own_columns, read, slices, staged, text_buffer
from relaysync.llm.features import Adam, label_shares, labelled_sample, marked_rows, sigmoid
from relaysync.llm.tokens import ALNUM_WORDS, mix, span_hashes, word_spans

PER_CLASS = 3000
DIMS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
BATCH = 64
MIN_DOCS = 5
BINS = 1000
LEAST = 20
EPOCHS = 6
SLICE_BYTES = 2 << 20
PAD = max(WIDTHS) - 1


@dataclass
class Net:
    vocabulary: np.ndarray  # sorted hashes; row k + 1 of the embeddings
    params: dict
    cut: float = 0.5  # threshold of any other language
    cuts: DataFrame | None = None  # (lang, cut) of the languages with rows enough


def word_hashes(buf, off):
    """Hashes of each word and of its beginnings, one column each, and the words' rows."""
    s, e, row = word_spans(buf, off, ALNUM_WORDS)
    cols = [span_hashes(buf, s, e)]
    cols += [mix(span_hashes(buf, s, np.minimum(e, s + k)) + np.uint64(k)) for k in PREFIXES]
    return np.stack(cols, axis=1), row


def word_ids(buf, off, vocabulary):
    """Embedding rows of every text's words (0: not known), each text followed by PAD zeros; text starts."""
    h, row = word_hashes(buf, off)
    n = len(off) - 1
    ids = np.zeros((len(h) + n * PAD, h.shape[1]), dtype=np.int32)
    if len(h) and len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        ids[np.arange(len(h)) + row * PAD] = np.where(vocabulary[at] == h, at + 1, 0)
    words = np.bincount(row, minlength=n)
    return ids, np.cumsum(words) - words + np.arange(n) * PAD


def _embed(e: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = e[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += e[ids[:, k]]
    return out


def _responses(x: np.ndarray, params: dict):
    """Per width, every filter's response at each place (without the bias)."""
    for w in WIDTHS:
        y = x @ params[f"W{w}"][0]
        for j in range(1, w):
            y[:-j] += x[j:] @ params[f"W{w}"][j]
        yield w, y


def predict(net: Net, buf, off) -> np.ndarray:
    out, p = [], net.params
    e = np.vstack([np.zeros((1, DIMS), np.float32), p["E"]])
    for lo, hi in slices(off, SLICE_BYTES):
        ids, starts = word_ids(buf, off[lo: hi + 1], net.vocabulary)
        pooled = [np.maximum.reduceat(y, starts, axis=0) + p[f"b{w}"] for w, y in _responses(_embed(e, ids), p)]
        out.append(sigmoid(np.maximum(np.hstack(pooled), 0.0) @ p["u"] + p["c"]))
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def _train(docs: list[np.ndarray], y: np.ndarray, n_rows: int, epochs: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.05, (n_rows, DIMS)).astype(np.float32), "u": np.full(FILTERS * len(WIDTHS), 0.5, np.float32),
         "c": np.full(1, -1.0, np.float32)}
    p["u"][::2] = -0.5
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    adam = Adam(p, 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            batch = order[lo: lo + BATCH]
            e = np.vstack([np.zeros((1, DIMS), np.float32), p["E"]])
            size = np.array([len(docs[i]) for i in batch])
            ids, starts = np.concatenate([docs[i] for i in batch]), np.cumsum(size) - size
            x = _embed(e, ids)
            pooled, places = [], []
            for w, r in _responses(x, p):
                at = np.stack([r[a: a + n].argmax(axis=0) + a for a, n in zip(starts, size)])
                places.append(at)
                pooled.append(np.take_along_axis(r, at, axis=0) + p[f"b{w}"])
            z = np.hstack(pooled)
            f = np.maximum(z, 0)
            d = (weight[batch] * (sigmoid(f @ p["u"] + p["c"]) - y[batch]) / len(batch)).astype(np.float32)
            grads = {"u": f.T @ d + 1e-4 * p["u"], "c": d.sum(keepdims=True)}
            de, dz = np.zeros_like(e), np.outer(d, p["u"]) * (z > 0)
            for k, w in enumerate(WIDTHS):
                g = dz[:, k * FILTERS: (k + 1) * FILTERS]
                grads[f"b{w}"] = g.sum(axis=0)
                grads[f"W{w}"] = np.zeros_like(p[f"W{w}"])
                for j in range(w):
                    at = np.minimum(places[k] + j, len(ids) - 1)  # (texts, filters)
                    grads[f"W{w}"][j] = np.einsum("tfd,tf->df", x[at], g)
                    step = g[:, :, None] * p[f"W{w}"][j].T[None]
                    for c in range(ids.shape[1]):
                        np.add.at(de, ids[at, c], step)
            grads["E"] = de[1:] + 1e-5 * p["E"]
            adam.step(grads)
    return p


def _cuts(scored: DataFrame, by: list[str]) -> DataFrame:
    """The cut of best F1 of counted rows (bin, y, k, ``by``); at equal F1 the highest."""
    bins = scored.groupBy(*by, "bin").agg(F.sum(F.col("y") * F.col("k")).alias("hits"), F.sum("k").alias("n"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.col("bin").desc())
    toxic, rows = F.sum("hits").over(w), F.sum("n").over(w)
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.greatest(toxic, F.lit(1)))
    return (bins.select(*by, "bin", f1.alias("f1"), toxic.alias("toxic"), rows.alias("rows"))
            .where((F.col("toxic") >= LEAST) & (F.col("rows") - F.col("toxic") >= LEAST))
            .groupBy(*by).agg((F.max_by("bin", F.struct("f1", "bin")) / BINS).alias("cut")))


def calibrate(net: Net, docs: DataFrame, marked: DataFrame, id_col: str, column: str) -> None:
    """Set the thresholds from all rows of ``marked`` (id, y)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"), F.col(f"`{column}`").alias("text"))
    scored = score(rows.join(marked.withColumnRenamed(id_col, "id"), "id"), net, ["lang", "y"], "text")
    bins = staged(scored.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin"), "y").agg(F.count("*").alias("k")), "toxic-bins")
    overall = _cuts(bins.withColumn("all", F.lit(1)), ["all"]).first()
    net.cut = 0.5 if overall is None else float(overall.cut)
    net.cuts = staged(_cuts(bins.where("lang is not null"), ["lang"]), "toxic-cuts")


def _net(texts, y: np.ndarray, epochs: int, seed: int) -> Net:
    buf, off = text_buffer(texts)
    parts = list(slices(off, SLICE_BYTES))
    found = []
    for lo, hi in parts:
        h, row = word_hashes(buf, off[lo: hi + 1])
        keys, rows = h.ravel(), np.repeat(row, h.shape[1])
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        found.append(np.unique(keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])] if len(keys) else keys,
                               return_counts=True))
    words, back = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    count = np.bincount(back, np.concatenate([c for _, c in found]), minlength=len(words))
    vocabulary = words[count >= MIN_DOCS]
    cut = []
    for lo, hi in parts:
        ids, starts = word_ids(buf, off[lo: hi + 1], vocabulary)
        cut += [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
    return Net(vocabulary, _train(cut, y, len(vocabulary), epochs, seed))


def _constant(share: float) -> Net:
    share = min(max(share, 0.01), 0.99)
    p = {"E": np.zeros((0, DIMS), np.float32), "u": np.zeros(FILTERS * len(WIDTHS), np.float32),
         "c": np.array([np.log(share / (1 - share))], np.float32)}
    p |= {f"W{w}": np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
    return Net(np.zeros(0, np.uint64), p)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, epochs: int = EPOCHS, seed: int = 7,
        id_col: str = "doc_id", column: str = "text") -> Net:
    """Train on a bounded sample of labelled texts and calibrate on all others of a fifth (see the module's text)."""
    left_out = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(5)) == 4
    texts, y, _ = labelled_sample(docs, labels.where(~left_out), label, per_class, id_col, column)
    first = _net(texts, y, epochs, seed) if len(set(y.tolist())) == 2 else None
    texts, y, _ = labelled_sample(docs, labels, label, per_class, id_col, column)
    if len(set(y.tolist())) < 2:
        return _constant(label_shares(labels, label, id_col))
    net = _net(texts, y, epochs, seed)
    if first is not None:
        calibrate(first, docs, marked_rows(labels.where(left_out), label, id_col), id_col, column)
        net.cut, net.cuts = first.cut, first.cuts
    return net


def score(docs: DataFrame, net: Net, keep: list[str], column: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` of every whole text."""
    net = Net(net.vocabulary, net.params)  # tasks need no thresholds

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                buf, off = text_buffer(batch.column(len(keep)))
                yield pa.record_batch([*batch.columns[:-1], pa.array(predict(net, buf, off))], names=[*batch.schema.names[:-1], "score"])

    rows = own_columns(docs, *keep, column)
    return rows.mapInArrow(run, own_columns(docs, *keep).schema.add("score", "double"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with each language's calibrated threshold beside it."""
    docs = read(spark, sf_dir, "documents")
    net = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", fold("doc_id", 5) == 0), net, ["doc_id", "held_out", "lang"])
    limit = F.lit(net.cut)
    if net.cuts is not None:
        scored, limit = scored.join(net.cuts, "lang", "left"), F.coalesce("cut", limit)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))
