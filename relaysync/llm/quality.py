"""Quality by Bradley-Terry pairwise ranking of document features.

Each text becomes a vector of shares and counts (character classes, word and
line shapes, repetition), spread over hinges at the sample's quantiles.  The
weights come from preference pairs, a text of label 1 against one of label 0:
the chance that the first wins is the logistic of the weighted difference of
their features, and the logistic loss over the pairs is minimised on the
driver, on a bounded sample of ``PER_CLASS`` texts of each label and
``PAIRS`` pairs.  The threshold is the exact quantile of the scores of all
labelled rows outside fold 0, scored in Spark, at their share of label 0.

``score`` is the logistic of the weighted features, shifted so that the
threshold falls on ``CUT``.

Defined results: null and empty texts have zero features and are scored as
such; without labelled rows of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.common import fold, own_columns, read, slices, staged, text_buffer
from relaysync.llm.features import Adam, label_shares, labelled_sample, marked_rows, sigmoid
from relaysync.llm.tokens import SPACE_WORDS, join_hash, span_hashes, word_spans

PER_CLASS = 4000
PAIRS = 40_000
HINGES = 8
BINS = 4096
CUT = 0.3
SLICE_BYTES = 4 << 20

# fixed values: classes of bytes
_CLASSES = ("a-z", "A-Z", "0-9", " ", "\n", ".,", "!?", "|", "#$%&*@^~+=<>", "()[]{}'\"", ":;/_-\\")
_CLASS = np.full(256, len(_CLASSES) + 1, dtype=np.int32)
_CLASS[0x80:] = len(_CLASSES)
for _k, _c in enumerate(_CLASSES):
    _span = range(ord(_c[0]), ord(_c[2]) + 1) if len(_c) == 3 and _c[1] == "-" else [ord(x) for x in _c]
    _CLASS[list(_span)] = _k
_N_CLASSES = len(_CLASSES) + 2
_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False


def _distinct(keys: np.ndarray, row: np.ndarray, n: int):
    """(distinct keys, most occurrences of one key) by row."""
    order = np.argsort(join_hash(keys, row.astype(np.uint64)))
    k, r = keys[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(k)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, r[first], size)
    return np.bincount(r[first], minlength=n), most


def features(buf, off) -> np.ndarray:
    """One row of numbers for each text."""
    n, size = len(off) - 1, np.diff(off)
    part = buf[off[0]: off[-1]]
    of = np.repeat(np.arange(n, dtype=np.int64) * _N_CLASSES, size)
    classes = np.bincount(of + _CLASS[part], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    s, e, row = word_spans(buf, off, SPACE_WORDS)
    h = span_hashes(buf, s, e)
    length = (e - s).astype(np.float64)
    words = np.bincount(row, minlength=n)
    w = np.maximum(words, 1)
    mean = np.bincount(row, length, minlength=n) / w
    var = np.bincount(row, length ** 2, minlength=n) / w - mean ** 2
    c0 = _CLASS[buf[s]] if len(s) else np.zeros(0, np.int32)
    c1 = _CLASS[buf[e - 1]] if len(s) else c0
    kinds, top = _distinct(h, row, n)
    near = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs, _ = _distinct(join_hash(h[near], h[near + 1]), row[near], n)
    ls, le, lrow = word_spans(buf, off, _LINES)
    lines, _ = _distinct(span_hashes(buf, ls, le), lrow, n)
    n_lines = np.bincount(lrow, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)

    def share(mask, rows, total):
        return np.bincount(rows[mask], minlength=n) / np.maximum(total, 1)

    out = [classes[:, k] / np.maximum(size, 1) for k in range(_N_CLASSES)]
    out += [mean, np.sqrt(np.maximum(var, 0)), np.log1p(longest), np.log1p(words), np.log1p(n_lines), np.log1p(words / np.maximum(n_lines, 1)),
            kinds / w, kinds / np.sqrt(w), top / w, pairs / w, lines / np.maximum(n_lines, 1),
            share(c0 == 1, row, words), share(c1 == 5, row, words), share(c1 == 6, row, words), share(c1 >= 7, row, words),
            share((c0 >= 5) & (c0 != len(_CLASSES)), row, words), share(length == 1, row, words), share(length > 20, row, words)]
    return np.stack(out, axis=1)


@dataclass
class Ranking:
    knots: np.ndarray  # (features, hinges)
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # threshold of the raw scores
    share: float  # of label 1; the score of everything where nothing was learned

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Hinge functions of each feature, scaled."""
        z = np.maximum(x[:, :, None] - self.knots[None], 0.0).reshape(len(x), -1)
        return np.hstack([z, x]) / self.scale

    def predict(self, buf, off) -> np.ndarray:
        out = []
        for lo, hi in slices(off, SLICE_BYTES):
            if not len(self.weights):
                out.append(np.full(hi - lo, self.share))
                continue
            out.append(sigmoid(self.raw(buf, off[lo: hi + 1]) - self.cut + np.log(CUT / (1 - CUT))))
        return np.concatenate(out) if out else np.zeros(0)

    def raw(self, buf, off) -> np.ndarray:
        return self.spread(features(buf, off)) @ self.weights


def _cut_after(scores: DataFrame, k: int) -> float:
    """Halfway between the values of ranks ``k`` and ``k + 1`` (from 0) of the column raw, exactly.

    Histograms of the values, each within the bin of the last that holds the
    rank, until that bin is one value: a driver holds ``BINS`` rows at most.
    """
    lo, hi = scores.agg(F.min("raw"), F.max("raw")).first()
    before = 0
    while lo < hi:
        place = F.least(F.floor((F.col("raw") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = (scores.filter(F.col("raw").between(lo, hi)).groupBy(place.alias("bin"))
                .agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).orderBy("bin").collect())
        for x in bins:
            if k < before + x.n:
                lo, hi = x.lo, x.hi
                break
            before += x.n
    upto, above = scores.agg(F.count_if(F.col("raw") <= lo), F.min(F.when(F.col("raw") > lo, F.col("raw")))).first()
    return lo if k + 1 < upto or above is None else (lo + above) / 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, pairs: int = PAIRS,
        epochs: int = 6, seed: int = 11) -> Ranking:
    """Learn the ranking from a bounded sample of labelled texts, its threshold from all of them."""
    texts, y, _ = labelled_sample(docs, labels, label, per_class)
    share = label_shares(labels, label)
    if len(set(y.tolist())) < 2:
        return Ranking(np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, share)
    buf, off = text_buffer(texts)
    x = np.vstack([features(buf, off[lo: hi + 1]) for lo, hi in slices(off, SLICE_BYTES)])
    knots = np.quantile(x, np.linspace(0.02, 0.98, HINGES), axis=0).T
    ranking = Ranking(knots, np.ones(1), np.zeros(0), 0.0, share)
    z = ranking.spread(x)
    ranking.scale = np.maximum(z.std(axis=0), 1e-6)
    z = z / ranking.scale
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
    p = {"w": np.zeros(z.shape[1])}
    adam = Adam(p, 0.01)
    for _ in range(epochs):
        order = rng.permutation(pairs)
        for lo in range(0, pairs, 256):
            k = order[lo: lo + 256]
            d = z[first[k]] - z[second[k]]
            miss = sigmoid(-(d @ p["w"]))
            adam.step({"w": -(miss @ d) / len(k) + 1e-3 * p["w"]})
    ranking.weights = p["w"]
    scores = staged(_raw_scores(docs.filter(fold("doc_id", 5) != 0), ranking).join(marked_rows(labels, label), "doc_id")
                    .select("raw", "y"), "quality-scores")
    ranking.cut = _cut_after(scores, scores.filter("y = 0").count() - 1)
    return ranking


def _raw_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id and the raw score of every whole text."""
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(ranking.raw(buf, off[lo: hi + 1]))], names=["doc_id", "raw"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, own_columns(docs, "doc_id").schema.add("raw", "double"))


def score(docs: DataFrame, ranking: Ranking, keep: list[str], column: str = "text", into: str = "score") -> DataFrame:
    """The columns ``keep`` and the quality of every whole text."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                buf, off = text_buffer(batch.column(len(keep)))
                yield pa.record_batch([*batch.columns[:-1], pa.array(ranking.predict(buf, off))], names=[*keep, into])

    return own_columns(docs, *keep, column).mapInArrow(run, own_columns(docs, *keep).schema.add(into, "double"))


def keep_good(docs: DataFrame, ranking: Ranking, column: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose quality reaches ``cut``; all columns as they were."""
    at = docs.columns.index(column)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(ranking.predict(*text_buffer(batch.column(at))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document by pairwise ranking."""
    docs = read(spark, sf_dir, "documents")
    ranking = fit(docs, read(spark, sf_dir, "labels"))
    return (score(docs.withColumn("held_out", fold("doc_id", 5) == 0), ranking, ["doc_id", "held_out"])
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")).select("doc_id", "held_out", "score", "predicted"))
