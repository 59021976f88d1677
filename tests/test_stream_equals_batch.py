"""Batch result = available-now stream result, for every stream-capable operator."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.operators import derivatives as D
from relaysync.operators import outcomes as O
from relaysync.operators import recipients as RC
from relaysync.operators import requests as R
from relaysync.operators import triples as T
from relaysync.streaming import pipeline as P
from tests import events as E

DDL = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"
S = Settings(service_base_url="http://sync.test/", node_stream="node", delete_stream="delete",
             media_stream="media", external_stream="external", triples_index_stream="node",
             triples_delete_stream="delete")


def _rows():
    bodies = [E.node_event(), E.node_event(version="true"), E.media_event(), E.media_event(source_field=None),
              E.external_event(), "{broken", E.node_event(target=False)]
    streams = ["node", "delete", "media", "external", "derivative-a"]
    out = []
    for i in range(60):
        hdr = {"Authorization": f"Bearer {i}", "X-Recipients": "a, b,,c"} if i % 2 else {"X": "1"}
        out.append((i, dt.datetime(2024, 1, 1, 0, i), streams[i % 5], hdr, bodies[i % 7]))
    return out


def _registry(spark):
    props = spark.createDataFrame([("derivative.systems.installed", "a", 0),
                                   ("derivative.a.enabled", "true", 0),
                                   ("derivative.a.in.stream", "derivative-a", 0),
                                   ("derivative.a.service.url", "http://svc.test/a", 0)],
                                  "key string, value string, priority int")
    return D.routes_registry(props)


def _resources(spark):
    doc = json.dumps({"@graph": [{"@id": f"{E.WORK_URL}", "@type": ["t:T"], "p:x": [{"@value": 1}]}]})
    return spark.createDataFrame([(f"{E.WORK_URL}?_format=jsonld", doc)], "url string, body string")


OPS = {
    "requests": lambda spark, raw: R.requests_from_raw(raw, S).drop("headers", "ts"),
    "event_outcomes": lambda spark, raw: R.event_outcomes(R.prepare(raw), S).drop("ts"),
    "envelope": lambda spark, raw: R.flatten_envelope(R.prepare(raw)),
    "recipients": lambda spark, raw: RC.recipient_fanout(raw, S),
    "derivatives": lambda spark, raw: D.derivative_requests(R.prepare(raw), _registry(spark), S).drop("ts"),
    "subject_events": lambda spark, raw: T.subject_events(R.prepare(raw), S).drop("ts"),
    "eligible": lambda spark, raw: T.eligible(T.subject_events(R.prepare(raw), S), _resources(spark)).drop("ts"),
    "classes_of_statuses": lambda spark, raw: raw.select(
        "seq", O.status_class(F.pmod("seq", F.lit(7)) * 100 + 4, F.lit("node_delete")).alias("c")),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_stream_equals_batch(spark, name):
    raw = spark.createDataFrame(_rows(), DDL)
    batch = OPS[name](spark, raw)
    run = P.StreamRun(spark, f"twin_{name}")
    files = P.stage_in_order(raw, run.input, "seq")
    stream = OPS[name](spark, P.read_raw_stream(spark, run.input, files, fmt="parquet"))
    P.run_available_now(stream, run.sink, run.checkpoint, "append")
    got = P.read_sink(spark, run.sink).drop("batch_id").select(*batch.columns)
    assert got.exceptAll(batch).count() == 0
    assert batch.exceptAll(got).count() == 0
