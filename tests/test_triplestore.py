"""The continuous triplestore run: late documents, order, expiry, replays."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.plans import jobs
from relaysync.plans import triplestore as T
from relaysync.streaming import buckets as B
from relaysync.streaming import pipeline as P
from tests import events as E

SETTINGS = Settings(node_stream="node", delete_stream="delete", triples_index_stream="node", triples_delete_stream="delete")
RAW = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"
TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"


def url(n):
    return f"http://archive.test/{n}?_format=jsonld"


def event(seq, n, stream="node"):
    urls = [E.link(f"http://archive.test/{n}", "text/html", "canonical", "Page"), E.link(url(n), "application/ld+json", "alternate", "Graph")]
    body = E.event("Update", {"type": "Object", "id": f"urn:uuid:{n}", "url": urls})
    return (seq, dt.datetime(2024, 1, 1), stream, {}, body)


def document(n, value, other=None):
    nodes = [{"@id": f"http://archive.test/{n}", "http://x/p": [{"@value": value}, {"@value": value}]}]
    if other:
        nodes.append({"@id": f"http://archive.test/{other}", "http://x/q": [{"@value": "from " + n}]})
    return (url(n), json.dumps({"@graph": nodes}))


class Feed:
    """Batches of events and documents, landed so that trigger k reads the k-th of both."""

    def __init__(self, spark, name, batches):
        self.spark, self.run = spark, P.StreamRun(spark, name)
        for k, (evs, docs) in enumerate(batches):
            spark.createDataFrame(evs, RAW).coalesce(1).write.parquet(f"{self.run.input}/events/{k}")
            spark.createDataFrame(docs, "url string, body string").coalesce(1).write.parquet(f"{self.run.input}/docs/{k}")

    def start(self, **kw):
        ev = P.read_stream(self.spark, f"{self.run.input}/events", RAW, 1, fmt="parquet")
        docs = P.read_stream(self.spark, f"{self.run.input}/docs", "url string, body string", 1, fmt="parquet")
        prior = self.spark.createDataFrame([(f"http://archive.test/{n}", "http://x/p", "old", "literal", None, None) for n in "abcdefg"], TRIPLE)
        return T.sync_triplestore(ev, docs, SETTINGS, self.run.sink, self.run.checkpoint, prior, buckets=4, every=2, **kw)

    def triples(self):
        return sorted((r.s[-1], r.p[-1], r.o) for r in T.triples_table(self.spark, self.run.sink).collect())

    def outcomes(self):
        got = jobs.resolved_outcomes(self.spark, SETTINGS, self.run.sink)
        return sorted((r.seq, r.outcome, r.reason) for r in got.where("request_id not rlike ':[0-9]+$'").collect())


BATCHES = [
    ([event(1, "a"), event(2, "b"), event(3, "c"), event(4, "g")], [document("a", "1")]),
    ([event(5, "b", "delete"), event(6, "d")], [document("c", "3", other="f"), ("http://archive.test/none", "{}")]),
    ([event(7, "c", "delete")], [document("b", "2"), document("d", "6")]),
    ([event(8, "a")], [document("a", "8"), (url("g"), '{"message": "gone"}')]),
    ([event(9, "e")], []),
    ([event(10, "z", "delete")], []),
]
WANT = sorted([("a", "p", "8"), ("d", "p", "6"), ("e", "p", "old"), ("f", "p", "old"), ("f", "q", "from c"), ("g", "p", "old")])


def test_late_documents(spark):
    f = Feed(spark, "late", BATCHES)
    f.start(tries=3).awaitTermination()
    assert f.triples() == WANT
    # b's document came after its delete; g's is no graph; e's has not come yet
    assert f.outcomes() == [(2, "ok", "superseded"), (4, "failed", "document_rejected"), (9, "pending", "resource_missing")]
    sent = jobs.written(spark, f.run.sink, "triples_requests").where("step = 0")
    assert sorted(r.seq for r in sent.collect()) == [1, 3, 5, 6, 7, 8, 10]


def test_waiting_ends_after_some_tries(spark):
    f = Feed(spark, "expire", BATCHES)
    f.start(tries=1).awaitTermination()
    # b (2 batches late) and g (3) are given up after one more batch
    assert [o for o in f.outcomes() if o[2] == "resource_missing"] == [(2, "failed", "resource_missing"), (4, "failed", "resource_missing"),
                                                                       (9, "failed", "resource_missing")]
    assert T.waiting_events(spark, f.run.sink).count() == 0
    assert f.triples() == WANT


@pytest.mark.parametrize("where", ["replace", "commit"])
def test_replay_after_a_crash(spark, monkeypatch, where):
    """The job dies in the second batch, before or after one of its tables took it in."""
    f = Feed(spark, f"crash_{where}", BATCHES)
    calls = {"n": 0}
    real = B.BucketTable._commit

    def dying(self, now):
        if where == "commit" and now["batch"] == 1:
            calls["n"] += 1
            if calls["n"] == 3:  # documents and triples are in, winners are not
                raise RuntimeError("driver lost")
        real(self, now)
        if where == "replace" and now["batch"] == 1 and self.root.endswith("triples"):
            raise RuntimeError("driver lost")

    monkeypatch.setattr(B.BucketTable, "_commit", dying)
    with pytest.raises(Exception, match="driver lost"):
        f.start(tries=3).awaitTermination()
    monkeypatch.setattr(B.BucketTable, "_commit", real)
    f.start(tries=3).awaitTermination()
    assert f.triples() == WANT
    assert f.outcomes() == [(2, "ok", "superseded"), (4, "failed", "document_rejected"), (9, "pending", "resource_missing")]


def test_a_batch_is_made_once_and_of_its_own_streams(spark):
    made = spark.sparkContext.accumulator(0)

    def count(body):
        made.add(1)
        return body

    feed = Feed(spark, "made_once", [([event(1, "a"), event(2, "b", "media"), event(3, "c", "delete"), event(4, "d", None)], [document("a", "1")])])
    ev = P.read_stream(spark, f"{feed.run.input}/events", RAW, 1, fmt="parquet").withColumn("body", F.udf(count)("body"))
    docs = P.read_stream(spark, f"{feed.run.input}/docs", "url string, body string", 1, fmt="parquet")
    T.sync_triplestore(ev, docs, SETTINGS, feed.run.sink, feed.run.checkpoint, buckets=4).awaitTermination()
    assert feed.triples() == [("a", "p", "1")]
    assert made.value == 2  # the node and the delete event, each once
