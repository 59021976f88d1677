"""Stream forms equal batch; the sink is idempotent; restart from checkpoint."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.operators import requests as R
from relaysync.streaming import pipeline as P
from tests import events as E

SETTINGS = Settings(service_base_url="http://sync.test/", node_stream="node", delete_stream="delete")
DDL = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"


def _raw(spark, start, n):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i % 60), "node" if i % 2 else "delete", {"Authorization": "B"},
             E.node_event(version="true" if i % 3 == 0 else None)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, DDL)


def test_restart_and_idempotent_sink(spark):
    run = P.StreamRun(spark, "test_restart")
    _raw(spark, 0, 30).write.json(f"{run.input}/a")
    stream = R.requests_from_raw(P.read_raw_stream(spark, run.input), SETTINGS).select("request_id", "uri")
    P.run_available_now(stream, run.sink, run.checkpoint)
    _raw(spark, 30, 30).write.json(f"{run.input}/b")
    stream2 = R.requests_from_raw(P.read_raw_stream(spark, run.input), SETTINGS).select("request_id", "uri")
    P.run_available_now(stream2, run.sink, run.checkpoint)  # resumes from the checkpoint
    got = P.read_sink(spark, run.sink).select("request_id", "uri")
    want = R.requests_from_raw(_raw(spark, 0, 60), SETTINGS).select("request_id", "uri")
    assert got.count() == want.count() == got.distinct().count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # replaying a committed batch adds nothing
    writer = P.idempotent_writer(run.sink)
    before = P.read_sink(spark, run.sink).count()
    batch0 = P.read_sink(spark, run.sink).where("batch_id = 0").drop("batch_id")
    writer(spark.createDataFrame(batch0.collect(), batch0.schema), 0)
    assert P.read_sink(spark, run.sink).count() == before


def test_dedup_keeps_late_messages(spark):
    """Distinct messages hours behind the newest one stay; copies in later triggers go."""
    from relaysync.operators.dedup import dedup_stream
    run = P.StreamRun(spark, "test_dedup_late")
    raw = spark.createDataFrame([(i, h, "node", {"message-id": f"m{i}"}, "{}") for i, h in ((1, 9), (2, 9), (3, 1))],
                                "seq bigint, h int, stream string, headers map<string,string>, body string")
    raw = raw.selectExpr("seq", "make_timestamp(2024, 1, 2, h, 0, 0) AS ts", "stream", "headers", "body")
    for k, part in enumerate((raw.where("seq = 1"), raw.where("seq = 2"), raw.where("seq <> 2"))):
        part.coalesce(1).write.json(f"{run.input}/chunk-{k}")
    out = dedup_stream(P.read_raw_stream(spark, run.input, 1), Settings()).select("message_id", "seq")
    P.run_available_now(out, run.sink, run.checkpoint)
    assert sorted(r.seq for r in P.read_sink(spark, run.sink).collect()) == [1, 2, 3]


def test_run_timeout_raises(spark):
    run = P.StreamRun(spark, "test_timeout")
    _raw(spark, 0, 20).write.json(run.input)
    with pytest.raises(TimeoutError):
        P.run_available_now(P.read_raw_stream(spark, run.input), run.sink, run.checkpoint, timeout_s=0.01)


def test_dedup_of_copies(spark):
    from relaysync.operators.dedup import dedup_stream
    run = P.StreamRun(spark, "test_dedup")
    raw = _raw(spark, 0, 20).withColumn("headers", F.create_map(F.lit("message-id"), F.col("seq").cast("string")))
    raw.unionByName(raw.where("seq % 2 = 0")).write.json(run.input)
    out = dedup_stream(P.read_raw_stream(spark, run.input), Settings()).select("message_id", "seq")
    P.run_available_now(out, run.sink, run.checkpoint)
    assert P.read_sink(spark, run.sink).count() == 20


def test_line_per_message_source(spark, tmp_path):
    from relaysync.sources.events import read_bodies
    f = tmp_path / "dump.txt"
    f.write_text("\n".join([E.node_event(), "{broken", E.node_event(version="true")]) + "\n")
    raw = read_bodies(spark, str(f), "node")
    assert raw.count() == 3 and raw.select("seq").distinct().count() == 3
    req = R.requests_from_raw(raw, SETTINGS)
    assert sorted(r.route for r in req.collect()) == ["node_index", "node_index", "node_version"]


def test_crash_mid_batch_then_restart(spark):
    """A sink that dies after a partial write: the restarted query replays the batch."""
    run = P.StreamRun(spark, "test_crash")
    _raw(spark, 0, 20).write.parquet(f"{run.input}/a")
    _raw(spark, 20, 20).write.parquet(f"{run.input}/b")
    src = P.read_stream(spark, run.input, DDL, max_files=1, fmt="parquet")
    out = R.requests_from_raw(src, SETTINGS).select("request_id", "uri")
    good = P.idempotent_writer(run.sink)

    def crashing(batch, batch_id):
        if batch_id == 1:
            batch.limit(1).write.parquet(f"{run.sink}/data/{1:012d}-{1:012d}-dead/rows")
            raise RuntimeError("executor lost")
        good(batch, batch_id)

    q = (out.writeStream.foreachBatch(crashing).option("checkpointLocation", run.checkpoint)
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001 - the query is expected to fail
        pass
    assert q.exception() is not None
    P.run_available_now(out, run.sink, run.checkpoint)  # restart from the checkpoint
    got = P.read_sink(spark, run.sink).select("request_id", "uri")
    want = R.requests_from_raw(_raw(spark, 0, 40), SETTINGS).select("request_id", "uri")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stage_in_order_keeps_null_keys(spark):
    run = P.StreamRun(spark, "test_stage_nulls")
    df = spark.createDataFrame([(None, "a"), (1, "b"), (5, "c"), (9, "d"), (None, "e")], "k bigint, v string")
    P.stage_in_order(df, run.input, "k", chunks=3)
    got = spark.read.option("recursiveFileLookup", "true").parquet(run.input)
    assert sorted(r.v for r in got.collect()) == ["a", "b", "c", "d", "e"]


def test_line_source_refuses_streaming(spark, tmp_path):
    import pytest
    from relaysync.sources.events import read_bodies
    with pytest.raises(ValueError):
        read_bodies(spark, str(tmp_path), "node", streaming=True)


def test_kafka_rows_to_raw_events(spark):
    from relaysync.sources.events import KAFKA_DDL, kafka_to_raw
    rows = [(None, bytearray(E.node_event().encode()), "node", 0, 7, dt.datetime(2024, 1, 1), 0,
             [("Authorization", bytearray(b"Bearer t")), ("x", bytearray(b"1")), ("x", bytearray(b"2"))]),
            (None, bytearray(b"{broken"), "delete", 1, 3, dt.datetime(2024, 1, 1), 0, None)]
    raw = kafka_to_raw(spark.createDataFrame(rows, KAFKA_DDL))
    got = {r.stream: r for r in raw.collect()}
    assert got["node"].headers == {"Authorization": "Bearer t", "x": "2"}
    assert got["delete"].headers == {} and got["delete"].body == "{broken"
    again = kafka_to_raw(spark.createDataFrame([(*r[:3], p, *r[4:]) for r in rows for p in (0, 1, 2)], KAFKA_DDL))
    assert again.select("stream", "seq").distinct().count() == 6  # equal offsets of different partitions
    assert sorted(r.route for r in R.requests_from_raw(raw, SETTINGS).collect()) == ["node_index"]


def test_stream_to_sink(spark):
    from relaysync.sources.sinks import stream_to
    run = P.StreamRun(spark, "test_stream_to")
    _raw(spark, 0, 10).write.json(f"{run.input}/a")
    q = stream_to(R.requests_from_raw(P.read_raw_stream(spark, run.input), SETTINGS).select("request_id"),
                  run.sink, run.checkpoint)
    q.awaitTermination()
    assert P.read_sink(spark, run.sink).count() == R.requests_from_raw(_raw(spark, 0, 10), SETTINGS).count()
