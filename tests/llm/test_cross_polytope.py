"""Nearest neighbours against all cosines: recall, exact scores, whole rankings where every cell is probed."""

import numpy as np
import pandas as pd
import pytest

from relaysync.llm import cross_polytope
from relaysync.llm.queries import QUERIES


def naive_nearest(rows, is_query, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in {(i, tuple(v)): (i, v) for i, v in good}.values()]
    out = {}
    for i, v in good:
        if is_query(i):
            near = [((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum()), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = sorted(near, key=lambda x: (-round(x[0], 12), x[1]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.score, r.vec_id))
    return out


def recall(got, want):
    for q, near in got.items():
        assert len(near) == len(want[q]) and near == sorted(near, key=lambda x: (-x[0], x[1]))
    hits = sum(len({j for _, j in near} & {j for _, j in got[q]}) for q, near in want.items())
    return hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op12_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = naive_nearest(rows, lambda i: i % 50 == 0, k=len(rows))
    got = found(QUERIES["op12_nearest"](spark, sf))
    score = {(q, j): s for q, near in want.items() for s, j in near}
    assert all(abs(score[q, j] - s) < 1e-12 for q, near in got.items() for s, j in near)
    assert recall(got, {q: near[:5] for q, near in want.items()}) >= 0.9


def test_blocks_copies_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies, each its own row
    rows += [(2000 + 2 * i, [1e200 * x for x in rows[5][1]]) for i in range(3)]
    rows += [(10, rows[10][1])] * 4  # repeated rows
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] * 12), (3004, [None] + [1.0] * 11), (None, rows[0][1]),
             (3005, [float("inf")] * 12), (3010, [1.0, 2.0]), (3020, [2.0, 4.0]), (3030, [5.0]), (3040, [1.0] * 100)]
    df = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], "vec_id long, embedding array<double>, dim int, score double, v string").repartition(6)
    asked = df.where("vec_id % 10 = 0")
    want = naive_nearest(rows, lambda i: i % 10 == 0)
    full = found(cross_polytope.nearest(df, asked, tables=1, probed=1.0, block=40, query_block=7))
    assert {q: [j for _, j in n] for q, n in full.items()} == {q: [j for _, j in n] for q, n in want.items() if n}
    # few cells probed: what they miss is found by the search of all rows
    few = found(cross_polytope.nearest(df, asked, tables=1, probed=0.01, block=40))
    assert {q: len(n) for q, n in few.items()} == {q: len(n) for q, n in want.items() if n}
    assert cross_polytope.nearest(df.limit(0), df.limit(0)).count() == 0
    assert cross_polytope.nearest(df, df.limit(0)).count() == 0


def test_rotation_keeps_cosines():
    x = cross_polytope.unit_rows(pd.Series([np.random.default_rng(k).normal(size=20) for k in range(50)]))
    y = cross_polytope.rotated(x, 3)
    assert y.shape == (50, 32) and np.allclose(y @ y.T, x @ x.T)
    both = np.concatenate([y, -y], axis=1)
    first = cross_polytope.axes(y, 4)[:, 0]
    assert ((first // 2 + (first % 2) * 32) == both.argmax(axis=1)).all()
