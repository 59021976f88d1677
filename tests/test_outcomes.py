"""Error policy (parametrised) and redelivery resolution against a plain-Python model."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.operators import outcomes as O

T0 = dt.datetime(2024, 1, 1)


def model(route, statuses, n_redeliveries):
    """Reference model: 1 + N deliveries; skip statuses end at once."""
    limit = n_redeliveries + 1
    seen = statuses[:limit]
    for i, st in enumerate(seen, start=1):
        if 200 <= st <= 299:
            return "ok", f"http_{st}", i
        if st in (412, 410) or (st == 404 and route == "node_delete"):
            return "skipped", f"http_{st}", i
    if len(seen) >= limit:
        return "failed", f"http_{seen[-1]}", limit
    return "pending", (f"http_{seen[-1]}" if seen else None), len(seen)


def resolve(spark, cases, n):
    s = Settings(max_redeliveries=n)
    req = spark.createDataFrame([(i, T0, f"r{i}", route) for i, (route, _) in enumerate(cases)],
                                "seq bigint, ts timestamp, request_id string, route string")
    att = [(f"r{i}", a, st) for i, (_, sts) in enumerate(cases) for a, st in enumerate(sts, start=1)]
    random.Random(7).shuffle(att)
    att_df = spark.createDataFrame(att, "request_id string, attempt_no int, status int")
    out = O.redelivery_outcomes(req, att_df, s).collect()
    return {r.request_id: (r.outcome, r.reason, r.attempts) for r in out}


POLICY = [
    ("node_index", [412], ("skipped", "http_412", 1)),
    ("node_index", [410], ("skipped", "http_410", 1)),
    ("node_delete", [404], ("skipped", "http_404", 1)),
    ("node_index", [404, 404], ("failed", "http_404", 2)),
    ("media_index", [500, 201], ("ok", "http_201", 2)),
    ("external_index", [500, 500, 201], ("failed", "http_500", 2)),
    ("node_version", [302, 412], ("skipped", "http_412", 2)),
    ("node_index", [500], ("pending", "http_500", 1)),
    ("node_index", [], ("pending", None, 0)),
    ("triples_index", [412, 500], ("failed", "http_500", 2)),
    ("triples_delete", [404, 201], ("ok", "http_201", 2)),
    ("derivative.thumb", [410, 410], ("failed", "http_410", 2)),
]


@pytest.mark.parametrize("route, statuses, expect", POLICY)
def test_policy_table(spark, route, statuses, expect):
    assert resolve(spark, [(route, statuses)], n=1)["r0"] == expect


def test_against_model(spark):
    rnd = random.Random(42)
    routes = ["node_index", "node_version", "node_delete", "media_index", "external_index"]
    codes = [200, 201, 204, 302, 404, 410, 412, 500, 503]
    cases = [(rnd.choice(routes), [rnd.choice(codes) for _ in range(rnd.randint(0, 8))]) for _ in range(400)]
    got = resolve(spark, cases, n=5)
    for i, (route, sts) in enumerate(cases):
        assert got[f"r{i}"] == model(route, sts, 5), (route, sts)


def test_rollup_has_subtotals(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "failed"), ("b", "ok")], "route string, outcome string")
    got = {(r.route, r.outcome): r.n for r in O.outcome_rollup(df).collect()}
    assert got[(None, None)] == 3 and got[("a", None)] == 2 and got[("b", "ok")] == 1


def test_status_class(spark):
    df = spark.createDataFrame([(201, "x"), (404, "node_delete"), (404, "x"), (410, "media_index"), (410, "x"), (None, "node_index")], "s int, r string")
    got = [r[0] for r in df.select(O.status_class(F.col("s"), F.col("r"))).collect()]
    assert got == ["ok", "skip", "retry", "skip", "retry", "retry"]


def test_unknown_and_missing_status_are_retried(spark):
    got = resolve(spark, [("node_index", [1234, 201]), ("node_index", [-1, 1500]), ("node_index", [500, None]),
                          ("node_index", [None]), ("node_delete", [None, 404])], n=1)
    assert got["r0"] == ("ok", "http_201", 2)
    assert got["r1"] == ("failed", "http_1500", 2)
    assert got["r2"] == ("failed", "no_answer", 2)
    assert got["r3"] == ("pending", "no_answer", 1)
    assert got["r4"] == ("skipped", "http_404", 2)


def test_response_stream_pending_and_late(spark):
    """A request without attempts is pending once its horizon has passed; an attempt after that is kept aside."""
    from relaysync.plans.jobs import late_responses, sync_responses
    from relaysync.streaming import pipeline as P
    run = P.StreamRun(spark, "responses")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    triggers = [([("a", "node_index", day(1)), ("b", "node_delete", day(1)), ("c", "node_index", day(1))], [("a", 1, 500, day(1, 1)), ("b", 1, 404, day(1, 1))]),
                ([("d", "node_index", day(2))], [("a", 2, 201, day(1, 2)), ("d", 1, None, day(2, 1))]),
                ([(None, None, day(9))], [(None, None, None, day(9))]),
                ([], [("c", 1, 201, day(1, 3)), ("x", 1, 201, day(9))])]
    for k, (req, att) in enumerate(triggers):
        spark.createDataFrame(req, "request_id string, route string, ts timestamp").coalesce(1).write.parquet(f"{run.input}/r/{k}")
        spark.createDataFrame(att, "request_id string, attempt_no int, status int, at timestamp").coalesce(1).write.parquet(f"{run.input}/a/{k}")
    requests = P.read_stream(spark, f"{run.input}/r", "request_id string, route string, ts timestamp", 1, fmt="parquet")
    attempts = P.read_stream(spark, f"{run.input}/a", "request_id string, attempt_no int, status int, at timestamp", 1, fmt="parquet")
    for q in sync_responses(requests, attempts, run.sink, run.checkpoint):
        q.awaitTermination()
    got = P.read_sink(spark, f"{run.sink}/responses").where("request_id is not null")
    assert sorted((r.request_id, r.attempt_no or 0, r["class"]) for r in got.collect()) == [
        ("a", 1, "retry"), ("a", 2, "ok"), ("b", 1, "skip"), ("c", 0, "pending"), ("d", 1, "retry")]
    assert sorted(r.request_id for r in late_responses(spark, run.sink).collect()) == ["c", "x"]


def test_redeliver_forever(spark):
    got = resolve(spark, [("node_index", [500] * 30), ("node_index", [500] * 12 + [201]),
                          ("node_index", [404] * 3 + [412])], n=-1)
    assert got["r0"] == ("pending", "http_500", 30)
    assert got["r1"] == ("ok", "http_201", 13)
    assert got["r2"] == ("skipped", "http_412", 4)


def test_no_redelivery(spark):
    got = resolve(spark, [("node_index", [500, 201]), ("node_index", [201])], n=0)
    assert got["r0"] == ("failed", "http_500", 1)
    assert got["r1"] == ("ok", "http_201", 1)
