import pytest
from pyspark.sql import functions as F

from relaysync.functions import add_http_options, add_http_options_col, first_url, parse_events

DEFAULTS = "connectionClose=true&disableStreamCache=true"
GOLDEN = [
    ("http://press.test/run/7", "", f"http://press.test/run/7?{DEFAULTS}"),
    ("http://press.test/run/7", "soTimeout=900", f"http://press.test/run/7?soTimeout=900&{DEFAULTS}"),
    ("http://press.test/run/7", "depth=3, ink=blue ", f"http://press.test/run/7?depth=3&ink=blue&{DEFAULTS}"),
    ("http://press.test/run/7", "disableStreamCache=auto,depth=3",
     "http://press.test/run/7?disableStreamCache=auto&depth=3&connectionClose=true"),
    ("", "depth=3", f"depth=3&{DEFAULTS}"),
    ("http://press.test/run?job=7", "", f"http://press.test/run?job=7&{DEFAULTS}"),
    ("http://press.test/run", "  ,depth=3,,", f"http://press.test/run?&depth=3&{DEFAULTS}"),
    ("http://press.test/run", "CONNECTIONCLOSE=1", f"http://press.test/run?CONNECTIONCLOSE=1&{DEFAULTS}"),
]


@pytest.mark.parametrize("endpoint, options, expect", GOLDEN)
def test_http_options_driver(endpoint, options, expect):
    assert add_http_options(endpoint, options) == expect


def test_http_options_column_matches_driver(spark):
    rows = [(e, o, f) for e, o, _ in GOLDEN for f in (False, True)]
    df = spark.createDataFrame(rows, "e string, o string, f boolean")
    got = df.select("e", "o", "f", add_http_options_col(F.col("e"), F.col("o"), F.col("f")).alias("u")).collect()
    for r in got:
        assert r.u == add_http_options(r.e, r.o, r.f)


def test_first_url_semantics(spark):
    u = "array<struct<name:string,type:string,href:string,mediaType:string,rel:string>>"
    df = spark.createDataFrame([
        ([("a", "Link", "h1", None, "canonical"), ("b", "Link", "h2", "APPLICATION/JSON", None),
          ("c", "Link", "h3", "application/json", "Canonical")],),
        ([],), (None,),
    ], f"url {u}")
    got = df.select(first_url(F.col("url"), media_type="application/json").alias("j"),
                    first_url(F.col("url"), rel="canonical").alias("c"),
                    first_url(F.col("url"), "application/json", "canonical").alias("both")).collect()
    assert (got[0].j, got[0].c, got[0].both) == ("h2", "h1", "h3")
    assert (got[1].j, got[1].c) == (None, None)
    assert (got[2].j, got[2].c) == (None, None)


@pytest.mark.parametrize("body, malformed", [
    ('{"type":"Update","object":{"id":"urn:uuid:x"}}', False),
    ("{bad", True), ("", True), (None, True), ("[]", True),
    ('{"type":"Update","object":"str"}', True),
])
def test_quarantine(spark, body, malformed):
    df = spark.createDataFrame([(body,)], "body string")
    assert parse_events(df).first().malformed is malformed


def test_strict_unknown_field(spark):
    df = spark.createDataFrame([('{"type":"Update","extra":1}',), ('{"type":"Update"}',)], "body string")
    assert [r.malformed for r in parse_events(df, strict=True).collect()] == [True, False]
    assert [r.parse_reason for r in parse_events(df, strict=True).collect()] == ["unknown_field", None]
    assert [r.malformed for r in parse_events(df).collect()] == [False, False]


def test_uuid_replace_all(spark):
    from relaysync.functions import strip_uuid
    df = spark.createDataFrame([("urn:uuid:abc-urn:uuid:def",)], "id string")
    assert df.select(strip_uuid(F.col("id"))).first()[0] == "abc-def"


def test_strict_nested_unknown_fields(spark):
    link = '{"name":"n","type":"Link","href":"h","mediaType":"text/html","rel":"canonical"%s}'
    def event(obj="", url="", actor="", att="", content=""):
        return ('{"type":"Update","object":{"id":"i","url":[%s]%s},"actor":{"id":"a"%s},'
                '"attachment":{"type":"Object","content":{"args":"x"%s}%s}}'
                % (link % url, obj, actor, content, att))
    bodies = [event(), event(obj=',"q":1'), event(url=',"hreflang":"en"'), event(actor=',"name":"N"'),
              event(att=',"size":3'), event(content=',"dpi":300'), '{"type":"Update","object":null}']
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r.k: r.parse_reason for r in parse_events(df, strict=True).collect()}
    assert got == {0: None, **{k: "unknown_field" for k in range(1, 6)}, 6: None}
    assert not any(r.malformed for r in parse_events(df).collect())
