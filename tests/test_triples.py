"""JSON-LD flatten and last-writer-wins replace/delete against brute force."""

import datetime as dt
import json
import random

from relaysync import Settings
from relaysync.operators import requests as R
from relaysync.operators import triples as T
from tests import events as E

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
WORK = "http://archive.test/works/tide-chart-17"
SHORE = "http://archive.test/places/shore"
TERMS = "http://terms.test/"
WORK_DOC = {"@graph": [
    {"@id": WORK, "@type": [TERMS + "Chart", TERMS + "Print"],
     TERMS + "title": [{"@value": "Tides", "@language": "en"}, {"@value": "Gezeiten", "@language": "de"}],
     TERMS + "sheets": [{"@value": 4}], TERMS + "scale": [{"@value": 2.5}], TERMS + "framed": [{"@value": True}],
     TERMS + "drawn": [{"@value": "1911", "@type": TERMS + "Year"}], TERMS + "shows": [{"@id": SHORE}]},
    {"@id": SHORE, "@type": [TERMS + "Place"]},
]}


def test_document_of_two_nodes(spark):
    df = spark.createDataFrame([("u", json.dumps(WORK_DOC))], "url string, body string")
    xsd = "http://www.w3.org/2001/XMLSchema#"
    got = {(r.s, r.p, r.o, r.o_kind, r.datatype, r.lang) for r in T.jsonld_triples(df).collect()}
    assert got == {
        (WORK, RDF_TYPE, TERMS + "Chart", "iri", None, None),
        (WORK, RDF_TYPE, TERMS + "Print", "iri", None, None),
        (WORK, TERMS + "title", "Tides", "literal", None, "en"),
        (WORK, TERMS + "title", "Gezeiten", "literal", None, "de"),
        (WORK, TERMS + "sheets", "4", "literal", xsd + "integer", None),
        (WORK, TERMS + "scale", "2.5", "literal", xsd + "double", None),
        (WORK, TERMS + "framed", "true", "literal", xsd + "boolean", None),
        (WORK, TERMS + "drawn", "1911", "literal", TERMS + "Year", None),
        (WORK, TERMS + "shows", SHORE, "iri", None, None),
        (SHORE, RDF_TYPE, TERMS + "Place", "iri", None, None),
    }


def test_rejected_documents(spark):
    bodies = {"good": json.dumps(WORK_DOC), "null": None, "cut": '{"@graph": [', "error": '{"message":"error"}',
              "number": "5", "empty": "[]", "bare": '{"@id":"s1","p:a":"x"}',
              "half": '[{"p:a":[{"@value":1}]},{"@id":"s","p:a":[{"@value":1}]}]'}
    df = spark.createDataFrame(list(bodies.items()), "url string, body string")
    got = {r.url: r.reason for r in T.rejected_documents(df).collect()}
    assert got == {"null": "not_json", "cut": "not_json", "error": "no_triples", "number": "no_triples",
                   "empty": "no_triples", "bare": "no_triples"}
    kept = {r.url for r in T.jsonld_triples(df).select("url").distinct().collect()}
    assert kept == set(bodies) - set(got)


def test_repeated_values_are_one_triple(spark):
    doc = json.dumps({"@graph": [{"@id": "s1", "p:v": [{"@value": "a"}, {"@value": "a"}]}]})
    res = spark.createDataFrame([("u", doc), ("u", doc)], "url string, body string")
    w = spark.createDataFrame([("s1", 1, "index", "u")], "s string, seq bigint, kind string, url string")
    prior = spark.createDataFrame([], "s string, p string, o string, o_kind string, datatype string, lang string")
    assert T.apply_changes(prior, w, res).count() == 1


TRIPLES = "s string, p string, o string, o_kind string, datatype string, lang string"


def test_nodes_shared_by_documents_are_stored_once(spark):
    """Other nodes of a document: equal triples of two documents, or of the store, count once."""
    def doc(s, *extra):
        return json.dumps({"@graph": [{"@id": s, "p:in": [{"@id": "x:shore"}]},
                                      {"@id": "x:shore", "p:name": [{"@value": n} for n in ("Shore", *extra)]}]})

    res = spark.createDataFrame([("u1", doc("x:a")), ("u2", doc("x:b", "Strand"))], "url string, body string")
    w = spark.createDataFrame([("x:a", 1, "index", "u1"), ("x:b", 2, "index", "u2")],
                              "s string, seq bigint, kind string, url string")
    prior = spark.createDataFrame([("x:shore", "p:name", "Shore", "literal", None, None),
                                   ("x:shore", "p:depth", "3", "literal", None, None),
                                   ("x:a", "p:in", "x:hill", "iri", None, None)], TRIPLES)
    got = sorted((r.s, r.p, r.o) for r in T.apply_changes(prior, w, res).collect())
    assert got == [("x:a", "p:in", "x:shore"), ("x:b", "p:in", "x:shore"), ("x:shore", "p:depth", "3"),
                   ("x:shore", "p:name", "Shore"), ("x:shore", "p:name", "Strand")]


def test_illegal_terms_are_rejected(spark):
    bad = [{"@id": "x:a>b", "p:v": [{"@value": 1}]}, {"@id": "_:b0", "p:v": [{"@value": 1}]},
           {"@id": "x:a", "p:v w": [{"@value": 1}]}, {"@id": "x:a", "p:v": [{"@id": "x:a b"}]},
           {"@id": "x:a", "p:v": [{"@id": "_:b1"}]}, {"@id": "x:a", "@type": ["x:{t}"]},
           {"@id": "x:a", "p:v": [{"@value": "1", "@type": "x:\"t"}]},
           {"@id": "x:a", "p:v": [{"@value": "1", "@language": "en us"}]}]
    df = spark.createDataFrame([(str(i), json.dumps([n])) for i, n in enumerate(bad)], "url string, body string")
    assert T.jsonld_triples(df).count() == 0
    assert {r.reject for r in T.jsonld_triples(df, keep_rejects=True).collect()} == {"illegal_iri_or_tag"}
    assert {r.reason for r in T.rejected_documents(df).collect()} == {"no_triples"}
    assert T.rejected_documents(df).count() == len(bad)


def test_values_and_rejects(spark):
    doc = {"@graph": [{"@id": "s1",
                       "p:num": [{"@value": 12}],
                       "p:lang": [{"@value": "chat", "@language": "fr"}],
                       "p:typed": [{"@value": "2020", "@type": "x:year"}],
                       "p:ref": [{"@id": "o1"}],
                       "p:bare": {"@value": 1},
                       "p:list": [{"@list": [{"@value": 1}]}]},
                      {"p:x": [{"@value": 1}]}]}
    df = spark.createDataFrame([("u", json.dumps(doc))], "url string, body string")
    ok = {r.p: (r.o, r.o_kind, r.datatype, r.lang) for r in T.jsonld_triples(df).collect()}
    assert ok["p:num"] == ("12", "literal", "http://www.w3.org/2001/XMLSchema#integer", None)
    assert ok["p:lang"] == ("chat", "literal", None, "fr")
    assert ok["p:typed"] == ("2020", "literal", "x:year", None)
    assert ok["p:ref"] == ("o1", "iri", None, None)
    rej = {(r.p, r.reject) for r in T.jsonld_triples(df, keep_rejects=True).collect() if r.reject}
    assert rej == {("p:bare", "not_an_array"), ("p:list", "value_without_id_or_value"),
                   ("p:x", "node_without_id")}


def _event(subject_n, with_jsonld=True):
    ev = json.loads(E.node_event())
    base = f"http://cms.test/node/{subject_n}"
    ev["object"]["url"] = E.links(base, jsonld=with_jsonld)
    return json.dumps(ev)


def test_last_writer_wins_brute_force(spark):
    rnd = random.Random(3)
    settings = Settings(node_stream="idx", delete_stream="del", triples_index_stream="idx",
                        triples_delete_stream="del")
    n_sub = 12
    have_doc = {i for i in range(n_sub) if i % 4 != 0}
    evs = []
    for seq in range(200):
        i = rnd.randrange(n_sub)
        stream = rnd.choice(["idx", "idx", "del"])
        good = rnd.random() > 0.1
        evs.append((seq, stream, i, good))
    raw = spark.createDataFrame(
        [(seq, dt.datetime(2024, 1, 1), st, {}, _event(i, good) if good else "{broken")
         for seq, st, i, good in evs],
        "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    docs = [(f"http://cms.test/node/{i}?_format=jsonld",
             json.dumps({"@graph": [{"@id": f"http://cms.test/node/{i}", "p:v": [{"@value": f"new{i}"}]}]}))
            for i in sorted(have_doc)]
    res = spark.createDataFrame(docs, "url string, body string")
    prior = spark.createDataFrame([(f"http://cms.test/node/{i}", "p:v", "old", "literal", None, None)
                                   for i in range(n_sub + 3)], T.TRIPLES_DDL if hasattr(T, "TRIPLES_DDL")
                                  else "s string, p string, o string, o_kind string, datatype string, lang string")
    f = R.prepare(raw)
    w = T.latest_per_subject(T.eligible(T.subject_events(f, settings), res))
    got = sorted((r.s, r.o) for r in T.apply_changes(prior, w, res).collect())
    # brute force
    state = {f"http://cms.test/node/{i}": "old" for i in range(n_sub + 3)}
    for seq, st, i, good in evs:
        if not good:
            continue
        s = f"http://cms.test/node/{i}"
        if st == "del":
            state.pop(s, None)
        elif i in have_doc:
            state[s] = f"new{i}"
    assert got == sorted(state.items())
    # changeset and render agree with the winners
    cs = T.changeset(prior, w, res).collect()
    assert {r.s for r in cs if r.op == "delete"} <= {r.s for r in w.collect()}
    txt = {(r.s, r.step): r.update_text for r in T.render_update(w, res).collect()}
    for r in w.collect():
        assert txt[r.s, 0] == f"DELETE WHERE {{ <{r.s}> ?p ?o }}"
        assert ((r.s, 1) in txt) == (r.kind == "index")
    assert all(v.startswith("INSERT DATA { ") for (_, step), v in txt.items() if step)


def test_unparsable_document_does_not_win(spark):
    settings = Settings(node_stream="idx", delete_stream="del", triples_index_stream="idx",
                        triples_delete_stream="del")
    raw = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "idx", {}, _event(1)), (2, dt.datetime(2024, 1, 1), "idx", {}, _event(2))],
        "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    res = spark.createDataFrame(
        [("http://cms.test/node/1?_format=jsonld", '{"@graph": [ broken'),
         ("http://cms.test/node/2?_format=jsonld",
          json.dumps({"@graph": [{"@id": "http://cms.test/node/2", "p:v": [{"@value": "new"}]}]}))],
        "url string, body string")
    prior = spark.createDataFrame([(f"http://cms.test/node/{i}", "p:v", "old", "literal", None, None)
                                   for i in (1, 2)],
                                  "s string, p string, o string, o_kind string, datatype string, lang string")
    sev = T.subject_events(R.prepare(raw), settings)
    w = T.latest_per_subject(T.eligible(sev, res))
    got = sorted((r.s, r.o) for r in T.apply_changes(prior, w, res).collect())
    assert got == [("http://cms.test/node/1", "old"), ("http://cms.test/node/2", "new")]
    out = {r.seq: (r.outcome, r.reason) for r in T.triples_outcomes(sev, res, w).collect()}
    assert out == {1: ("failed", "document_rejected"), 2: ("ok", "applied")}
