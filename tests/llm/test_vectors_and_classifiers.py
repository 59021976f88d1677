"""Embedding groups against brute force; classifiers by held-out accuracy; the pipeline end to end."""

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaysync.llm import embedding_dedup, line_dedup, order_minhash, quality, toxicity
from relaysync.llm.common import text_buffer
from relaysync.llm.components import components
from relaysync.llm.fm_index import FMIndex
from relaysync.llm.queries import QUERIES


def naive_groups(rows, threshold=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, parent = dict.fromkeys(good, 0), {i: i for i in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(good), 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: (links.get(i, 0), find(i) if i in good else i) for i, _ in rows}


def test_embeddings_match_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = naive_groups(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op4_embedding_dedup"](spark, sf).collect()}
    assert got == want


def test_embeddings_across_cells_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    rows = [(i, (base[i % 40] + rng.normal(scale=0.15, size=4)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, float("nan"), 0.0, 0.0]), (2004, [1.0, None, 0.0, 0.0]),
             (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, n int, cell string")
    want = naive_groups(rows)
    for cells, block in ((1, 4096), (12, 16)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept)
               for r in embedding_dedup.near_duplicates(df, block=block, cells=cells).collect()}
        assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    lone = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in lone} == {(None, 0, None, True), (1, 0, 1, True)}


def test_embeddings_of_extreme_lengths(spark):
    """Squares that overflow or vanish do not hide a cosine of 1."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1e200, -1e200]), (5, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_embedding_cells_are_files_written_once(tmp_path):
    """What pairs of blocks share is a file: every shown row stands in it once, in its own precision, home rows first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    centroids = {4: embedding_dedup.fit_centroids(embedding_dedup._unit(x), 6)}
    frame = pd.DataFrame({"v": list(x), "id": np.arange(300), "n": np.arange(300) + 1, "dim": 4})
    segments = pd.concat(embedding_dedup._cells_map(str(tmp_path), centroids, 0.3, "f4", 16)(iter([frame[:200], frame[200:]])))
    shown = int(segments["rows"].sum())
    assert segments["rows"].max() <= 16 and int(segments["homes"].sum()) == 300 < shown
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == shown * (8 + 8 + 4 * 4)
    parts = segments.to_dict("records")
    ids, n, v = embedding_dedup._block(str(tmp_path), 4, "f4", parts, True)
    assert sorted(ids.tolist()) == list(range(300)) and (n == ids + 1).all() and (v == embedding_dedup._unit(x)[ids]).all()
    assert len(embedding_dedup._block(str(tmp_path), 4, "f4", parts, False)[0]) == shown


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (8, 9), (7, 7), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 260))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8, **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 261), 200)}
    assert got == want


def test_fm_index():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, size=400)
    text = np.append(text, [1, 2, 3] * 30 + [0])
    index = FMIndex(text, 4)
    patterns = [rng.integers(1, 4, size=rng.integers(1, 6)) for _ in range(50)]
    wide = np.zeros((len(patterns), 6), dtype=np.int64)
    for k, p in enumerate(patterns):
        wide[k, 6 - len(p):] = p
    lo, hi = index.search(wide, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i: i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@pytest.mark.parametrize(("name", "label"), [("op2_toxicity", "toxic"), ("op3_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    y, p = np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])
    print(name, "accuracy", (y == p).mean(), "recall", p[y == 1].mean(), "false", p[y == 0].mean())
    assert (y == p).mean() > 0.95 and p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.2


def test_quality_threshold_covers_all_labelled_rows(spark, sf, documents):
    """The cut is the quantile of all labelled scores, however few of them were fitted on."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rank = quality.fit(documents, labels, per_class=20, pairs=500)
    rows = documents.join(labels.select("doc_id", "quality"), "doc_id").filter("quality in (0, 1)").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    raw = np.sort(rank.raw(*text_buffer(pa.array([r.text for r in rows], pa.string()))))
    k = sum(r.quality == 0 for r in rows)
    assert len(rows) > 200 and rank.cut == pytest.approx((raw[k - 1] + raw[k]) / 2, abs=1e-9)


def test_quality_cut_among_equal_scores(spark):
    for values in ([1.0, 1.0, 1.0, 2.0], [0.5], [3.0, -1.0, 1e-9, 2e-9, 7.5, 7.5]):
        x = sorted(values)
        df = spark.createDataFrame([(v,) for v in values], "raw double")
        for k in range(len(x)):
            assert quality._cut_after(df, k) == (x[k] + x[min(k + 1, len(x) - 1)]) / 2


def test_classifiers_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(11, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        net, rank = toxicity.fit(odd, labels), quality.fit(odd, labels)
        for rows in (toxicity.score(odd, net, ["doc_id", "bucket"]).collect(), quality.score(odd, rank, ["doc_id", "bucket"], into="q").collect()):
            assert len(rows) == odd.count() and all(0 <= r[-1] <= 1 for r in rows)
        assert quality.keep_good(odd, rank, cut=0.0).count() == odd.count()
        assert toxicity.score(odd.limit(0), net, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, sf, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == documents.columns
        kept[name] = out.count()
        docs = out
    assert kept["quality"] == kept["line_dedup"] < documents.count()
    assert kept["near_dedup"] < kept["line_dedup"] and kept["decontaminate"] < kept["near_dedup"]
    rows = corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_rejects_no_good_document(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.quality(spark, docs, sf).select("doc_id")
    good = docs.join(labels.filter("quality = 1"), "doc_id")
    assert good.join(out, "doc_id", "left_anti").count() <= 0.02 * good.count()
