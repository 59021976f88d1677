"""Route goldens: the six visible indexer tests, rebuilt with invented values."""

import datetime as dt

import pytest

from relaysync import Settings
from relaysync.operators import requests as R
from tests import events as E

BASE = "http://sync.test:8000/indexer/"
SUFFIX = "?connectionClose=true&disableStreamCache=true"
HEADER = "X-Test-Base-Header"
SETTINGS = Settings(service_base_url=BASE, node_stream="node", delete_stream="delete", media_stream="media",
                    external_stream="external", max_redeliveries=1, base_url_header=HEADER)


def run(spark, stream, body, headers=None):
    headers = headers if headers is not None else {"Authorization": "Bearer secret", "X-Junk": "1"}
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), stream, headers, body)],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    return [r.asDict() for r in R.requests_from_raw(raw, SETTINGS).orderBy("route").collect()]


def test_node(spark):
    rows = run(spark, "node", E.node_event())
    assert len(rows) == 1
    r = rows[0]
    assert r["route"] == "node_index" and r["method"] == "POST"
    assert r["uri"] == f"{BASE}node/{E.UUID}{SUFFIX}"
    assert r["content_location"] == f"{E.WORK_URL}?_format=jsonld"
    assert r["headers"] == {"Authorization": "Bearer secret", HEADER: f"{E.REPO}/works"}


def test_base_url_with_query(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "node", {}, E.node_event())],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    r = R.requests_from_raw(raw, SETTINGS.with_(service_base_url="http://press.test/run?p=")).first()
    assert r.uri.count("?") == 1 and "&connectionClose=true" in r.uri


def test_node_version(spark):
    rows = run(spark, "node", E.node_event(version="true", target=False, uuid=E.SHORT_UUID))
    assert [r["route"] for r in rows] == ["node_index", "node_version"]
    v = rows[1]
    assert v["uri"] == f"{BASE}node/{E.SHORT_UUID}/version{SUFFIX}"
    assert v["content_location"] == f"{E.WORK_URL}?_format=jsonld"
    assert v["base_url"] is None


@pytest.mark.parametrize("flag, expect", [(True, 2), ("true", 2), ("TRUE", 2), ("false", 1), ("yes", 1),
                                          (None, 1)])
def test_version_flag(spark, flag, expect):
    assert len(run(spark, "node", E.node_event(version=flag))) == expect


def test_node_delete(spark):
    rows = run(spark, "delete", E.node_event())
    assert len(rows) == 1
    r = rows[0]
    assert r["method"] == "DELETE" and r["uri"] == f"{BASE}node/{E.UUID}{SUFFIX}"
    assert r["content_location"] is None
    assert r["headers"][HEADER] == f"{E.REPO}/works"


def test_external(spark):
    rows = run(spark, "external", E.external_event())
    assert len(rows) == 1
    r = rows[0]
    assert r["uri"] == f"{BASE}external/{E.FILE_UUID}{SUFFIX}"
    assert r["content_location"] == E.SCAN_URL  # a canonical link of any media type
    assert r["headers"][HEADER] == f"{E.REPO}/scans"


def test_media(spark):
    rows = run(spark, "media", E.media_event())
    assert len(rows) == 1
    r = rows[0]
    assert r["uri"] == f"{BASE}media/{E.SOURCE_FIELD}{SUFFIX}"
    assert r["content_location"] == f"{E.TAKE_URL}?_format=json"


def test_media_version(spark):
    rows = run(spark, "media", E.media_event(version="true"))
    assert [r["route"] for r in rows] == ["media_index", "media_version"]
    assert rows[1]["uri"] == f"{BASE}media/{E.SOURCE_FIELD}/version{SUFFIX}"


def test_headers_overwrite_and_strip(spark):
    rows = run(spark, "node", E.node_event(), headers={"authorization": "Bearer x", HEADER.lower(): "stale",
                                                       "Other": "y"})
    assert rows[0]["headers"] == {"authorization": "Bearer x", HEADER: f"{E.REPO}/works"}


def test_default_auth(spark):
    import datetime as dt2
    s = SETTINGS.with_(auth_token="tok")
    raw = spark.createDataFrame(
        [(1, dt2.datetime(2024, 1, 1), "delete", {"X": "1"}, E.node_event()),
         (2, dt2.datetime(2024, 1, 1), "delete", {"AUTHORIZATION": "Bearer mine"}, E.node_event())],
        "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    got = {r.seq: r.headers for r in R.requests_from_raw(raw, s).collect()}
    assert got[1]["Authorization"] == "Bearer tok"
    assert got[2] == {"AUTHORIZATION": "Bearer mine", HEADER: f"{E.REPO}/works"}


def test_missing_urls_stop_before_fanout(spark):
    import json
    ev = json.loads(E.node_event(version="true"))
    ev["object"]["url"] = ev["object"]["url"][:2]  # no JSON-LD link
    body = json.dumps(ev)
    assert run(spark, "node", body) == []
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "node", {}, body)],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    out = R.event_outcomes(R.prepare(raw), SETTINGS).collect()
    assert [(o.route, o.reason, o.outcome, o.level) for o in out] == [
        ("node_index", "missing_jsonld_url", "skipped", "WARN")]


def test_media_without_source_field_fails(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "media", {}, E.media_event(source_field=None))],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    f = R.prepare(raw)
    assert R.build_requests(f, SETTINGS).count() == 0
    o = R.event_outcomes(f, SETTINGS).first()
    assert (o.reason, o.outcome) == ("missing_source_field", "failed")


def test_one_parse_in_plan(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "node", {}, E.node_event())],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    plan = R.prepare(raw).where("not malformed and jsonld_url is not null")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert plan.count("from_json") == 1
