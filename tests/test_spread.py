"""The feed's input work per task: bounded rows, no bodies where only ids are asked, attempts made after the joins."""

import datetime as dt
import uuid
from collections import Counter

from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.operators import derivatives
from relaysync.operators import requests as R
from relaysync.operators.dedup import dedup_messages
from relaysync.plans import queries as Q
from relaysync.session import scratch_dir
from relaysync.sources import feed

RAW_DDL = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"
SETTINGS = Settings(message_id_header="message-id")
T0 = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_of_one_row_group_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(feed, "SPREAD_ROWS", 50, raising=False)
    root = scratch_dir(spark, f"spread-{uuid.uuid4().hex}")
    for name in ("events", "pages"):
        spark.range(1000).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    sizes = feed.read_table(spark, root, "events").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 100
    assert sorted(r.id for r in feed.read_table(spark, root, "events").collect()) == list(range(1000))
    # rows as wide as what is made of them keep to the cores
    assert feed.read_table(spark, root, "pages").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_dedup_of_ids_leaves_bodies_alone(spark):
    later = T0 + dt.timedelta(seconds=1)
    rows = [(2, T0, "a", {"message-id": "m", "x": "2"}, "b"), (1, later, "a", {"message-id": "m", "x": "late"}, "a"),
            (1, T0, "b", {"message-id": "m", "x": "b"}, "a"), (1, T0, "a", {"message-id": "m", "x": "z"}, "z"),
            (1, T0, "a", {"message-id": "m", "x": "first"}, "c"), (None, T0, "a", {"message-id": "n", "x": "n"}, None),
            (7, None, "a", None, "q"), (7, None, "a", None, "q")]
    raw = spark.createDataFrame(rows, RAW_DDL)
    kept = dedup_messages(raw, SETTINGS)
    assert kept.columns == ["seq", "ts", "stream", "headers", "body", "message_id"]
    got = {r.message_id: (r.seq, r.ts, r.stream, (r.headers or {}).get("x"), r.body) for r in kept.collect()}
    assert got == {"m": (1, T0, "a", "first", "c"), "n": (None, T0, "a", "n", None), "a:7": (7, None, "a", None, "q")}
    ids = kept.select("message_id", "seq", "stream")
    assert {tuple(r) for r in ids.collect()} == {("m", 1, "a"), ("n", None, "a"), ("a:7", 7, "a")}
    aggregate = next(ln for ln in _plan(ids).splitlines() if "Aggregate" in ln)
    assert "body" not in aggregate and "min_by" not in aggregate


def test_attempts_are_made_after_the_requests_are_joined(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), f"{i}:r", "r") for i in range(60)]
    # an id sent twice at other times, a copy of a row, and a request without an id
    rows += [(5, T0, "5:r", "r"), rows[7], (None, T0, None, "r")]
    req = spark.createDataFrame(rows, "seq bigint, ts timestamp, request_id string, route string")
    made = feed.attempts_for(Q.sent_times(req, 3), "ts", "seq")
    want = feed.attempts_for(req).join(req.select("request_id", "ts", "seq"), "request_id")
    assert Counter(map(tuple, made.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    plan = _plan(made)
    assert plan.index("Generate") < plan.index("Join")


def test_attempts_land_from_spread_requests(spark):
    rows = [(i, T0, f"{i}:r", "r") for i in range(60)] + [(7, T0, "7:r", "r"), (None, T0, None, "r"), (5, T0, None, "r")]
    req = spark.createDataFrame(rows, "seq bigint, ts timestamp, request_id string, route string")
    path = scratch_dir(spark, "attempts")
    files = Q.stage_attempts(req, path)
    got = spark.read.option("recursiveFileLookup", "true").parquet(path)
    want = feed.attempts_for(req)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    for k in range(3):
        chunk = spark.read.parquet(f"{path}/chunk-{k:04d}").select("request_id", F.input_file_name().alias("file"))
        assert 1 < chunk.select("file").distinct().count() <= files
        # the attempts of a request that come together were not shuffled apart (the id sent twice may be in two)
        assert chunk.where("request_id <> '7:r'").groupBy("request_id").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()


def test_derivative_routes_read_the_content_alone(spark):
    content = '{"attachment": {"type": "Object", "content": {"source_uri": "s", "args": "-a", "mimetype": "m"}}}'
    bodies = [content, '{"attachment": {"type": "Object"}}', '{"type": "Create"}', '{"attachment": {"content": {"args": "x"}}}', "{", None]
    raw = spark.createDataFrame([(i, T0, "in", {}, b) for i, b in enumerate(bodies)], RAW_DDL)
    reg = spark.createDataFrame([("route", "item", "in", "http://svc", True)],
                                "route string, item string, stream string, service_url string, enabled boolean")
    f = R.prepare(raw)
    narrow = derivatives.content_only(f)
    assert narrow.schema["event"].dataType.names == ["attachment"] and narrow.columns == f.columns
    for of in (lambda x: derivatives.derivative_requests(x, reg, SETTINGS), lambda x: derivatives.derivative_outcomes(x, reg)):
        got = Counter(map(tuple, of(narrow).collect()))
        assert got and got == Counter(map(tuple, of(f).collect()))
