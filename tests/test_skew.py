"""Hot keys: one subject / one request holding a third of all rows stays correct."""

import datetime as dt
import json
import random

from relaysync import Settings
from relaysync.operators import outcomes as O
from relaysync.operators import requests as R
from relaysync.operators import triples as T
from tests import events as E

T0 = dt.datetime(2024, 1, 1)


def _event(n):
    ev = json.loads(E.node_event())
    ev["object"]["url"] = E.links(f"http://cms.test/node/{n}")
    return json.dumps(ev)


def test_hot_subject(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        rnd = random.Random(11)
        s = Settings(node_stream="idx", delete_stream="del", triples_index_stream="idx", triples_delete_stream="del")
        evs = []
        for seq in range(3000):
            n = 0 if seq % 3 == 0 else rnd.randrange(1, 300)
            evs.append((seq, rnd.choice(["idx", "idx", "del"]), n))
        raw = spark.createDataFrame([(q, T0, st, {}, _event(n)) for q, st, n in evs],
                                    "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
        docs = spark.createDataFrame(
            [(f"http://cms.test/node/{n}?_format=jsonld",
              json.dumps({"@graph": [{"@id": f"http://cms.test/node/{n}", "p:v": [{"@value": f"new{n}"}]}]}))
             for n in range(300)], "url string, body string")
        # the hot subject also holds a third of the prior triples
        prior_rows = [("http://cms.test/node/0", f"p:{i}", "old", "literal", None, None) for i in range(600)]
        prior_rows += [(f"http://cms.test/node/{n}", "p:v", "old", "literal", None, None) for n in range(1, 1200)]
        prior = spark.createDataFrame(prior_rows, "s string, p string, o string, o_kind string, datatype string, lang string")
        w = T.latest_per_subject(T.eligible(T.subject_events(R.prepare(raw), s), docs))
        got = sorted((r.s, r.p, r.o) for r in T.apply_changes(prior, w, docs).collect())
        state = {}
        for row in prior_rows:
            state.setdefault(row[0], set()).add((row[1], row[2]))
        for q, st, n in evs:
            subj = f"http://cms.test/node/{n}"
            state[subj] = set() if st == "del" else {("p:v", f"new{n}")}
        want = sorted((k, p, o) for k, v in state.items() for p, o in v)
        assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_hot_request(spark):
    s = Settings(max_redeliveries=5)
    req = spark.createDataFrame([(i, T0, f"r{i}", "node_index") for i in range(300)],
                                "seq bigint, ts timestamp, request_id string, route string")
    att = [(f"r{i}", 1, 201) for i in range(1, 300)]
    att += [("r0", 1 + (k % 9), 500) for k in range(150)]  # a third of all rows, duplicates past the limit
    out = {r.request_id: (r.outcome, r.attempts) for r in
           O.redelivery_outcomes(req, spark.createDataFrame(att, "request_id string, attempt_no int, status int"),
                                 s).collect()}
    assert out["r0"] == ("failed", 6)
    assert all(out[f"r{i}"] == ("ok", 1) for i in range(1, 300))
