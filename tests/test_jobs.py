"""End-to-end jobs on the driver tables, checked against the registered queries."""

import os

import pytest

from relaysync.operators import derivatives
from relaysync.plans import jobs
from relaysync.plans import queries as Q
from relaysync.session import scratch_dir
from relaysync.sources import feed
from relaysync.streaming import pipeline as P
from relaysync.streaming.batches import BatchLog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sync_batch(spark):
    out = scratch_dir(spark, "job")
    raw = Q.raw(spark, SF)
    req = Q.requests(spark, SF)
    paths = jobs.sync_batch(spark, raw, Q.SETTINGS, out, resources=Q.resources(spark, SF),
                            prior_triples=Q.prior(spark, SF), attempts=feed.attempts_for(req),
                            registry=derivatives.routes_registry(feed.properties_frame(spark)))
    got_req = spark.read.parquet(paths["requests"]).select(*Q.ALL_REQ_COLS)
    assert _same(got_req, Q.q_all_requests(spark, SF))
    got_tr = spark.read.parquet(paths["triples"])
    assert _same(got_tr, Q.q_triples_after_delete(spark, SF))
    outc = spark.read.parquet(paths["outcomes"])
    dispatched = outc.where("reason like 'http_%'").select(*Q.REDELIVERY_COLS)
    assert _same(dispatched, Q.q_redelivery_outcomes(spark, SF))
    # every malformed event has an outcome per route family it belongs to (the
    # node and delete streams also feed the triplestore routes); the disabled
    # derivative item's stream has no route
    f = Q.fields(spark, SF)
    routed = f.where("malformed and stream <> 'queue:derivative-ocr'").count()
    triples_routed = f.where("malformed and stream in ('queue:sync-node', 'queue:sync-delete')").count()
    assert outc.where("reason = 'malformed'").count() == routed + triples_routed
    # written triplestore requests and derivative requests are part of the sent set
    assert outc.where("route like 'triples_%' and outcome = 'pending'").count() == \
        spark.read.parquet(paths["triples_requests"]).count()


def test_sync_stream(spark):
    run = P.StreamRun(spark, "job_stream")
    files = P.stage_in_order(Q.raw(spark, SF), run.input, "seq")
    q = jobs.sync_stream(P.read_raw_stream(spark, run.input, files, fmt="parquet"), Q.SETTINGS, run.sink,
                         run.checkpoint)
    q.awaitTermination()
    got = jobs.written(spark, run.sink, "requests").select(*Q.ALL_REQ_COLS)
    assert _same(got, Q.q_all_requests(spark, SF))


def test_first_run_with_copies_and_hook(spark):
    """No prior triples, every fifth message twice, a user filter on the parsed events."""
    out = scratch_dir(spark, "job_first")
    raw = feed.redelivered(Q.raw(spark, SF))
    paths = jobs.sync_batch(spark, raw, Q.SETTINGS, out, resources=Q.resources(spark, SF), dedup=True,
                            transform=lambda df: df.where("seq % 2 = 0"))
    want = Q.requests(spark, SF).where("seq % 2 = 0").select(*Q.ALL_REQ_COLS)
    assert _same(spark.read.parquet(paths["requests"]).select(*Q.ALL_REQ_COLS), want)
    triples = spark.read.parquet(paths["triples"])
    assert triples.count() > 0 and triples.where("o = 'old'").count() == 0
    outc = spark.read.parquet(paths["outcomes"])
    assert outc.where("reason = 'superseded' and outcome = 'ok'").count() > 0


def test_sync_stream_with_copies(spark):
    run = P.StreamRun(spark, "job_stream_copies")
    raw = Q.raw(spark, SF)
    again = raw.where("seq % 3 = 0")
    for k, part in enumerate((raw, again)):
        part.coalesce(1).write.parquet(f"{run.input}/chunk-{k}")
    q = jobs.sync_stream(P.read_raw_stream(spark, run.input, 1, fmt="parquet"), Q.SETTINGS, run.sink, run.checkpoint,
                         dedup=True)
    q.awaitTermination()
    assert _same(jobs.written(spark, run.sink, "requests").select(*Q.ALL_REQ_COLS), Q.q_all_requests(spark, SF))


def test_sync_attempts_late_and_folded(spark):
    run = P.StreamRun(spark, "job_attempts")
    req = Q.requests(spark, SF).select("seq", "ts", "request_id", "route")
    with BatchLog(spark, f"{run.sink}/sync").batch(0) as put:
        put("requests", req)
    att = feed.attempts_for(req)
    for k in range(5):  # the last attempts first
        att.where(f"(attempt_no + hash(request_id)) % 5 in ({k}, {k - 5})").coalesce(1).write.parquet(
            f"{run.input}/chunk-{4 - k}")
    stream = P.read_stream(spark, run.input, "request_id string, attempt_no int, status int", 1, fmt="parquet")
    jobs.sync_attempts(stream, Q.SETTINGS, run.sink, run.checkpoint, every=2).awaitTermination()
    got = jobs.resolved_outcomes(spark, Q.SETTINGS, run.sink).select(*Q.REDELIVERY_COLS)
    assert _same(got, Q.q_redelivery_outcomes(spark, SF))


def test_resolved_outcomes_with_nothing_sent(spark):
    out = scratch_dir(spark, "job_nothing")
    assert jobs.resolved_outcomes(spark, Q.SETTINGS, out).count() == 0
    with BatchLog(spark, f"{out}/sync").batch(0) as put:
        put("outcomes", spark.createDataFrame([(1, None, "1:x", "x", "failed", "malformed", "ERROR", 0)], jobs._OUTCOMES_DDL))
    assert [r.request_id for r in jobs.resolved_outcomes(spark, Q.SETTINGS, out).collect()] == ["1:x"]
