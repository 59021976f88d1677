"""Property-based checks: the column form of the option rule equals the driver form."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaysync import Settings
from relaysync.functions import add_http_options, add_http_options_col
from relaysync.operators import requests as R
from tests import events as E

ELEMENT = st.one_of(
    st.sampled_from(["", " ", "\t", "a=1", " b=2 ", "connectionClose=false", "disableStreamCache=x",
                     "ConnectionClose=1", "connectionClose", "x=?&y", "=", "k=v=w"]),
    st.text(alphabet="ab=?& \t", max_size=6),
)
OPTIONS = st.lists(ELEMENT, max_size=6).map(",".join)
ENDPOINT = st.sampled_from(["", "http://h/x", "http://h/x?y=1", "h?", "?"])


@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.tuples(ENDPOINT, OPTIONS, st.booleans()), min_size=1, max_size=25))
def test_column_form_equals_driver_form(spark, rows):
    df = spark.createDataFrame(rows, "e string, o string, f boolean")
    got = df.select(add_http_options_col(F.col("e"), F.col("o"), F.col("f")).alias("u")).collect()
    assert [r.u for r in got] == [add_http_options(e, o, f) for e, o, f in rows]


def test_strict_unknown_field_outcome(spark):
    import json
    ev = json.loads(E.node_event())
    ev["unexpected"] = {"x": 1}
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "node", {}, json.dumps(ev))],
                                "seq bigint, ts timestamp, stream string, headers map<string,string>, body string")
    s = Settings(node_stream="node")
    assert R.requests_from_raw(raw, s).count() == 1
    assert R.requests_from_raw(raw, s, strict=True).count() == 0
    o = R.event_outcomes(R.prepare(raw, strict=True), s).first()
    assert (o.reason, o.outcome, o.level) == ("unknown_field", "failed", "ERROR")
