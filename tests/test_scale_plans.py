"""Plan-shape checks for the scale features (pruning, bucketing, bounded groups)."""

import datetime as dt
import json
import uuid

from relaysync import Settings
from relaysync.operators import requests as R
from relaysync.operators import triples as T
from relaysync.session import scratch_dir
from relaysync.sources.events import land, read_raw_events
from relaysync.sources.sinks import write_triples_table
from tests import events as E

DDL = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landing_prunes_streams(spark):
    s = Settings(node_stream="node", delete_stream="delete", media_stream="media", external_stream="external")
    rows = [(i, dt.datetime(2024, 1, 1), st, {}, E.node_event())
            for i, st in enumerate(["node", "delete", "derivative-x", "node"])]
    path = scratch_dir(spark, "landed") + "/raw"
    land(spark.createDataFrame(rows, DDL), path)
    req = R.requests_from_landed(read_raw_events(spark, path), s)
    assert req.count() == 3
    plan = _plan(req)
    assert "PartitionFilters: [" in plan and "stream#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bucketed_triples_avoid_shuffle_of_table(spark):
    name = "triples_" + uuid.uuid4().hex[:8]
    prior = spark.createDataFrame([(f"s{i}", "p", "o", "literal", None, None) for i in range(200)],
                                  "s string, p string, o string, o_kind string, datatype string, lang string")
    write_triples_table(prior, name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        winners = spark.createDataFrame([("s1", 5, "delete", None), ("s7", 6, "index", "u")],
                                        "s string, seq bigint, kind string, url string")
        res = spark.createDataFrame([("u", json.dumps({"@graph": [{"@id": "s7", "p": [{"@value": "n"}]}]}))],
                                    "url string, body string")
        out = T.apply_changes(spark.table(name), winners, res)
        lines = _plan(out).splitlines()
        i = next(k for k, ln in enumerate(lines) if "LeftAnti" in ln)
        # the bucketed table side (first child) is sorted and scanned, never exchanged
        table_side = lines[i + 1:i + 4]
        assert "Sort [s#" in table_side[0]
        assert not any("Exchange" in ln for ln in table_side)
        assert any("Bucketed: true" in ln for ln in table_side)
        got = {(r.s, r.o) for r in out.collect()}
        assert ("s1", "o") not in got and ("s7", "n") in got and ("s7", "o") not in got and len(got) == 199
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_render_update_parts_bounded(spark):
    doc = {"@graph": [{"@id": "big", **{f"p:{i}": [{"@value": str(i)}] for i in range(50)}}]}
    res = spark.createDataFrame([("u", json.dumps(doc))], "url string, body string")
    winners = spark.createDataFrame([("big", 1, "index", "u")], "s string, seq bigint, kind string, url string")
    parts = T.render_update(winners, res, chunk=10).collect()
    assert len(parts) >= 3
    lines = [x for p in parts if p.step for x in p.update_text.split("INSERT DATA { ")[-1].rstrip(" }").split(" . ") if x]
    assert len(lines) == 50
    assert [p.step for p in parts if p.update_text.startswith("DELETE WHERE")] == [0]


def test_only_needed_documents_are_parsed_and_once(spark):
    path = scratch_dir(spark, "docs") + "/docs"
    rows = [(f"u{i}", json.dumps({"@graph": [{"@id": f"s{i}", "http://x/p": [{"@value": str(i)}]}]})) for i in range(40)]
    spark.createDataFrame(rows + [("u0", "[]")], "url string, body string").write.parquet(path)
    urls = spark.createDataFrame([("u0",), ("u7",), ("gone",)], "url string")
    docs = T.parsed_documents(spark.read.parquet(path), urls)
    assert sorted((r.url, r.s, r.o) for r in docs.where("p is not null").collect()) == [("u0", "s0", "0"), ("u7", "s7", "7")]
    assert {(r._have, r._usable) for r in T.fetched_documents(docs).collect()} == {("u0", True), ("u7", True)}
    plan = _plan(docs)
    scans = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert sum("body" in ln.split("ReadSchema")[1] for ln in scans) == 1, "one scan of the bodies"
    # the semi-join stands below the parse: deeper in the tree than the first explode of documents
    lines = plan.splitlines()
    semi = next(k for k, ln in enumerate(lines) if "LeftSemi" in ln)
    assert any("Generate" in ln for ln in lines[:semi])
