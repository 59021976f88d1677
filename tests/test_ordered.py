"""Running values and lag over segments against plain Python, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from relaysync.operators.ordered import SEGMENT, lagged, running, segmented


def _rows():
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(-50, 50)) for k in range(40) for i in rng.sample(range(1000), rng.randrange(1, 6))]
    rows += [(7, 2000 + i, rng.randrange(-50, 50)) for i in range(900)]
    rng.shuffle(rows)
    return rows


def test_running_and_lag(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(3)
    order = [F.col("i")]
    seg = segmented(df, ["k"], order, "t")
    assert seg.where("k = 7").select(SEGMENT).distinct().count() > 1, "the hot key is cut"
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == k)
        total, x = 0, 0
        for at, (_, i, v) in enumerate(own):
            total, x = total + v, x ^ v
            want[k, i] = [total, x, sum(r[2] for r in own[at:]), own[at - 1][2] if at else None]
    run = running(seg, ["k"], order, {"total": ("sum", F.col("v")), "x": ("xor", F.col("v"))})
    run = running(run, ["k"], order, {"rest": ("sum", F.col("v"))}, backward=True)
    got = {(r.k, r.i): [r.total, r.x, r.rest, r.before] for r in lagged(run, ["k"], order, {"v": "before"}).collect()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "k long, i long, v long")
    seg = segmented(df, ["k"], [F.col("i")], "t")
    assert running(seg, ["k"], [F.col("i")], {"total": ("sum", F.col("v"))}).count() == 0
    assert lagged(seg, ["k"], [F.col("i")], {"v": "before"}).count() == 0


def test_transitions_of_a_hot_subject(spark):
    """One subject holds most events: they lie in several segments, and each still finds the one before it."""
    from relaysync.operators import triples
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"s{i % 40}", rng.choice(["index", "delete"])) for i in range(1200)]
    df = spark.createDataFrame([(i, None, s, k, None, None) for i, s, k in rows],
                               "seq bigint, ts timestamp, s string, kind string, url string, reason string").repartition(4)
    last, want = {}, {}
    for i, s, k in rows:
        was = last.get(s)
        want[i] = (was or "none", {("index", True): "updated", ("index", False): "created", ("delete", True): "deleted",
                                   ("delete", False): "absent"}[k, was == "index"])
        last[s] = k
    got = triples.transitions(df)
    assert {r.seq: (r.before, r.change) for r in got.collect()} == want
    plan = got._jdf.queryExecution().analyzed().toString()
    assert f"windowspecdefinition({SEGMENT}#" in plan, "windows run inside segments, not over a whole subject"
