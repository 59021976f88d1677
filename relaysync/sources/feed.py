"""Deterministic feed: the driver's ``events`` / ``pages`` tables -> engine inputs.

Everything is a pure function of the source columns, so DuckDB can compute
the expected results from the raw columns independently (plans/oracle.py).
Rules (m = props.k % 10):

* stream by event_type: click -> node, signup -> delete, view -> media,
  purchase -> external, error -> derivative item (event_id % 4).
* object.id = ``urn:uuid:`` + UUID_PREFIX + lpad(user_id, 12, '0').
* object.url = canonical ``http://cms/node/<user_id>``, JSON and JSON-LD
  alternates; defects by m: 0 no JSON-LD link, 1 no JSON link, 2 no canonical
  link, 3 url absent, 4 media types / rels in mixed case, 5 isNewVersion
  "true", 6 isNewVersion true (JSON boolean) + describes link, 7 isNewVersion
  "false" + describes link + a second JSON link, 8 truncated body, 9 no target.
* headers: Authorization ``Bearer <user_id>`` unless event_id % 7 = 0; a
  trace header always; a stale base-url header when event_id % 5 = 0; a
  message id; a recipients list when event_id % 3 = 0.
* media events: attachment.content.source_field = field_media_<event_id % 3>,
  absent when event_id % 11 = 0.
* resources: one JSON-LD document per page except page_id % 17 = 0.
* prior triples: one (node, schema:version, "old") per page.
* attempts: see ``attempts_for``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.settings import Settings

# --- fixed values of the feed ---------------------------------------------
CMS = "http://cms/node/"
REPO_TARGET = "http://repo/rest/"
UUID_PREFIX = "00000000-0000-4000-8000-"
ACTOR_PREFIX = "ffffffff-0000-4000-8000-"
CONTEXT = "https://www.w3.org/ns/activitystreams"
TRUE_MARKER = "__json_true__"
SCHEMA_ORG = "http://schema.org/"
PAGE_TYPE = "http://schema.org/WebPage"
DERIVATIVE_ITEMS = ["techmd", "audio", "image", "ocr"]
DERIVATIVE_MIMETYPES = {"techmd": "application/xml", "audio": "audio/mpeg",
                        "image": "image/jpeg", "ocr": "text/plain"}
DISABLED_ITEMS = {"ocr"}
BASE_HEADER = "X-Repository-Base-Url"
TRACE_HEADER = "X-Trace"
RECIPIENTS_HEADER = "X-Recipients"
MESSAGE_ID_HEADER = "message-id"

FEED_PROPERTIES: list[tuple[str, str]] = [
    ("error.maxRedeliveries", "5"),
    ("http.additional_options", ""),
    ("indexer.enabled", "true"),
    ("indexer.node", "queue:sync-node"),
    ("indexer.delete", "queue:sync-delete"),
    ("indexer.media", "queue:sync-media"),
    ("indexer.external", "queue:sync-external"),
    ("indexer.service.baseUrl", "http://cms/sync/"),
    ("triplestore.indexer.enabled", "true"),
    ("triplestore.index.stream", "queue:sync-node"),
    ("triplestore.delete.stream", "queue:sync-delete"),
    ("triplestore.baseUrl", "http://triples/sparql"),
    ("derivative.systems.installed", ",".join(DERIVATIVE_ITEMS)),
    ("sync.base_url_header", BASE_HEADER),
    ("sync.recipients_header", RECIPIENTS_HEADER),
    ("sync.message_id_header", MESSAGE_ID_HEADER),
] + [
    kv
    for item in DERIVATIVE_ITEMS
    for kv in (
        (f"derivative.{item}.enabled", "false" if item in DISABLED_ITEMS else "true"),
        (f"derivative.{item}.in.stream", f"queue:derivative-{item}"),
        (f"derivative.{item}.service.url", f"http://svc/{item}/convert"),
    )
]

FEED_SETTINGS = Settings.from_map(dict(FEED_PROPERTIES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(table, SPREAD_ROWS if name == "events" else None)


# Inputs with at most this many splits are small (a few GB at the default
# split size), so a round-robin shuffle of their compact rows is cheap.
SPREAD_MAX_SPLITS = 64
# A compact row of some 20 bytes becomes about 1.5 KB of JSON: a split of any
# size in bytes can hold millions of them.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a scan over at least as many tasks as the cluster has cores, and of about ``rows`` rows at most.

    The feed turns each compact source row into a ~1.5 KB JSON document that
    is then parsed; a table stored as one row group would do all of that in
    a single task, and the splits of a large one hold more rows the larger it
    is.  Shuffling the compact rows round-robin first is cheap, puts every
    core to work and keeps a task's work and memory the same at any size.
    Without ``rows`` (tables whose rows are as wide as what is made of them) a
    table of more than ``SPREAD_MAX_SPLITS`` splits is read with its own.
    The rows are counted from the files' footers.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no RDD view: read as is
        return df
    wanted = target if n <= SPREAD_MAX_SPLITS else 0
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    if n < wanted:
        return df.repartition(wanted)
    return df


def _link_sql(name: str, href: str, media_type: str, rel: str) -> str:
    return (f"named_struct('name', '{name}', 'type', 'Link', 'href', {href}, "
            f"'mediaType', '{media_type}', 'rel', '{rel}')")


def _feed_sql(settings: Settings) -> list[str]:
    """Spark SQL select list of the feed (one analysis call, no per-node RPC)."""
    canon = f"concat('{CMS}', cast(user_id AS string))"
    canon_l = _link_sql("Canonical", canon, "text/html", "canonical")
    js = _link_sql("JSON", f"concat({canon}, '?_format=json')", "application/json", "alternate")
    jsld = _link_sql("JSONLD", f"concat({canon}, '?_format=jsonld')", "application/ld+json", "alternate")
    desc = _link_sql("Describes", canon, "text/html", "describes")
    js2 = _link_sql("JSON", f"concat({canon}, '?_format=json&alt=1')", "application/json", "alternate")
    mixed = ", ".join([
        _link_sql("Canonical", canon, "Text/HTML", "Canonical"),
        _link_sql("JSON", f"concat({canon}, '?_format=json')", "Application/JSON", "Alternate"),
        _link_sql("JSONLD", f"concat({canon}, '?_format=jsonld')", "Application/LD+JSON", "Alternate"),
    ])
    items = ", ".join(f"'{i}'" for i in DERIVATIVE_ITEMS)
    mimes = ", ".join(f"'{k}', '{v}'" for k, v in DERIVATIVE_MIMETYPES.items())
    actor_n = "cast(pmod(event_id, 50) AS string)"
    body = f"""to_json(named_struct(
      '@context', '{CONTEXT}',
      'actor', named_struct('type', 'Person',
          'id', concat('urn:uuid:{ACTOR_PREFIX}', lpad({actor_n}, 12, '0')),
          'url', array({_link_sql("Canonical", f"concat('http://cms/user/', {actor_n})", "text/html", "canonical")})),
      'object', named_struct('type', 'Object',
          'id', concat('urn:uuid:{UUID_PREFIX}', lpad(cast(user_id AS string), 12, '0')),
          'url', CASE m WHEN 0 THEN array({canon_l}, {js}) WHEN 1 THEN array({canon_l}, {jsld})
                        WHEN 2 THEN array({js}, {jsld}) WHEN 3 THEN NULL WHEN 4 THEN array({mixed})
                        WHEN 6 THEN array({canon_l}, {js}, {jsld}, {desc})
                        WHEN 7 THEN array({canon_l}, {js}, {jsld}, {desc}, {js2})
                        ELSE array({canon_l}, {js}, {jsld}) END,
          'isNewVersion', CASE m WHEN 5 THEN 'true' WHEN 6 THEN '{TRUE_MARKER}' WHEN 7 THEN 'false' END),
      'attachment', CASE WHEN kind IN ('media', 'derivative') THEN named_struct(
          'type', 'Object', 'mediaType', 'application/json',
          'content', named_struct(
              'fedora_uri', CAST(NULL AS string),
              'source_field', CASE WHEN kind = 'media' AND pmod(event_id, 11) <> 0
                                   THEN concat('field_media_', cast(pmod(event_id, 3) AS string)) END,
              'source_uri', CASE WHEN kind = 'derivative'
                                 THEN concat('http://cms/files/', cast(user_id AS string), '/original.jpg') END,
              'destination_uri', CASE WHEN kind = 'derivative'
                                      THEN concat({canon}, '/media/', item, '/', cast(event_id AS string)) END,
              'mimetype', CASE WHEN kind = 'derivative' THEN element_at(map({mimes}), item) END,
              'args', CASE WHEN kind = 'derivative' THEN CASE WHEN pmod(event_id, 2) = 0 THEN ''
                           ELSE concat('-quality ', cast(pmod(event_id, 100) AS string)) END END,
              'file_upload_uri', CASE WHEN kind = 'derivative'
                  THEN concat('private://derivatives/', item, '/', cast(event_id AS string), ' file.bin') END)) END,
      'type', {_TYPE_SQL},
      'summary', CASE WHEN pmod(event_id, 4) <> 3 THEN concat({_TYPE_SQL}, ' a ', kind) END,
      'target', CASE WHEN m <> 9 THEN concat('{REPO_TARGET}', kind) END))"""
    stream = (f"CASE kind WHEN 'node' THEN '{settings.node_stream}' WHEN 'delete' THEN '{settings.delete_stream}' "
              f"WHEN 'media' THEN '{settings.media_stream}' WHEN 'external' THEN '{settings.external_stream}' "
              f"ELSE concat('queue:derivative-', item) END")
    headers = f"""map_from_entries(filter(array(
        named_struct('k', 'Authorization', 'v',
                     CASE WHEN pmod(event_id, 7) <> 0 THEN concat('Bearer ', cast(user_id AS string)) END),
        named_struct('k', '{TRACE_HEADER}', 'v', concat('trace-', cast(event_id AS string))),
        named_struct('k', '{BASE_HEADER}', 'v', CASE WHEN pmod(event_id, 5) = 0 THEN 'stale' END),
        named_struct('k', '{MESSAGE_ID_HEADER}', 'v', concat('msg-', cast(event_id AS string))),
        named_struct('k', '{RECIPIENTS_HEADER}', 'v', CASE WHEN pmod(event_id, 3) = 0
            THEN concat('audit, search,, ,shard-', cast(pmod(event_id, 4) AS string)) END)),
      x -> x.v IS NOT NULL))"""
    return [
        "event_id", "user_id", "ts",
        "pmod(cast(get_json_object(props, '$.k') AS int), 10) AS m",
        "CASE event_type WHEN 'click' THEN 'node' WHEN 'signup' THEN 'delete' WHEN 'view' THEN 'media' "
        "WHEN 'purchase' THEN 'external' WHEN 'error' THEN 'derivative' END AS kind",
        f"element_at(array({items}), cast(pmod(event_id, 4) + 1 AS int)) AS item",
    ], [
        "event_id AS seq",
        "cast(ts AS timestamp) AS ts",
        f"{stream} AS stream",
        f"{headers} AS headers",
        f"replace({body}, '\"isNewVersion\":\"{TRUE_MARKER}\"', '\"isNewVersion\":true') AS body0",
        "m",
    ]


_TYPE_SQL = ("CASE kind WHEN 'delete' THEN 'Delete' WHEN 'external' THEN 'Create' "
             "WHEN 'derivative' THEN 'Activity' ELSE 'Update' END")


def raw_events(events: DataFrame, settings: Settings = FEED_SETTINGS) -> DataFrame:
    """Driver ``events`` table -> ``raw_events`` (seq, ts, stream, headers, body)."""
    base, out = _feed_sql(settings)
    return events.selectExpr(*base).selectExpr(*out).selectExpr(
        "seq", "ts", "stream", "headers",
        "CASE WHEN m = 8 THEN substring(body0, 1, cast(length(body0) / 2 AS int)) ELSE body0 END AS body",
    )


def redelivered_events(events: DataFrame) -> DataFrame:
    """The driver's events with every fifth one delivered twice (compact rows, ``copy`` 1 or 2)."""
    copies = F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1)))
    return events.select("*", F.explode(copies).alias("copy"))


def redelivered(raw: DataFrame) -> DataFrame:
    """The feed with every fifth message delivered twice (input of E6).

    One pass: each row is emitted once or twice by an explode, instead of a
    self-union that would build the feed twice.
    """
    copies = F.when(F.pmod(F.col("seq"), F.lit(5)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return raw.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def with_unknown_keys(raw: DataFrame) -> DataFrame:
    """The feed with keys outside the event model, by seq % 6: 1 at the top, 2 in the object, 4 in the
    actor's link (bodies cut short stay malformed)."""
    k, body = F.pmod("seq", F.lit(6)), F.col("body")
    actor_link = '"name":"Canonical","type":"Link","href":"http://cms/user/'
    return raw.withColumn("body", (
        F.when(k == 1, F.concat(F.lit('{"priority":3,'), F.expr("substring(body, 2)")))
        .when(k == 2, F.replace(body, F.lit('"object":{'), F.lit('"object":{"shelf":"a",')))
        .when(k == 4, F.replace(body, F.lit(actor_link), F.lit('"hreflang":"en",' + actor_link)))
        .otherwise(body)))


def _title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def _lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, '<html lang="([^"]*)"', 1), F.lit(""))


def documents(pages: DataFrame) -> DataFrame:
    """JSON-LD documents (url, body), one per page."""
    pid = F.col("page_id")
    node = F.struct(
        F.concat(F.lit(CMS), pid.cast("string")).alias("@id"),
        F.array(F.lit(PAGE_TYPE)).alias("@type"),
        F.array(F.struct(F.col("url").alias("@id"))).alias(SCHEMA_ORG + "url"),
        F.array(F.struct(F.length("html").alias("@value"))).alias(SCHEMA_ORG + "size"),
        F.array(F.struct(_title(F.col("html")).alias("@value"), _lang(F.col("html")).alias("@language")))
        .alias(SCHEMA_ORG + "name"),
    )
    return pages.select(
        F.concat(F.lit(CMS), pid.cast("string"), F.lit("?_format=jsonld")).alias("url"),
        F.to_json(F.struct(F.array(node).alias("@graph"))).alias("body"),
    )


def resources(pages: DataFrame) -> DataFrame:
    """What was fetched: the documents of all pages but page_id % 17 = 0, whose fetch failed
    (the feature under test is the missing document)."""
    return documents(pages.where(F.pmod("page_id", F.lit(17)) != 0))


def faulty_resources(pages: DataFrame) -> DataFrame:
    """``documents`` of all pages with broken documents: by page_id % 6, 1 an error object, 2 an empty
    list, 3 a number, 4 cut in half; 0 and 5 stay."""
    pid = F.regexp_extract("url", r"(\d+)\?", 1).cast("bigint")
    k = F.pmod(pid, F.lit(6))
    body = (F.when(k == 1, F.lit('{"message":"error"}')).when(k == 2, F.lit("[]")).when(k == 3, F.lit("5"))
            .when(k == 4, F.expr("substring(body, 1, cast(length(body) / 2 AS int))")).otherwise(F.col("body")))
    return documents(pages).select("url", body.alias("body"))


def prior_triples(pages: DataFrame) -> DataFrame:
    """Triples already in the store: one (node, schema:version, "old") per page."""
    return pages.select(
        F.concat(F.lit(CMS), F.col("page_id").cast("string")).alias("s"),
        F.lit(SCHEMA_ORG + "version").alias("p"),
        F.lit("old").alias("o"),
        F.lit("literal").alias("o_kind"),
        F.lit(None).cast("string").alias("datatype"),
        F.lit(None).cast("string").alias("lang"),
    )


def attempts_for(requests: DataFrame, *keep: str) -> DataFrame:
    """Recorded delivery attempts of each request (what the remote answered), with the columns ``keep`` of the request.

    First rule that applies, by the request's event id:
    * % 19 = 0: attempts 1-6 answer 500, attempt 7 answers 201
    * % 23 = 0: 500, 500, 412
    * % 13 = 0: 500, 500 (nothing after)
    * else attempts 1-7 with status by (event_id*7 + a*13) % 10:
      0 -> 412, 1 -> 410, 2 -> 404, 3 or 4 -> 500, else 201.
    """
    eid = F.col("seq")
    n = (F.when(F.pmod(eid, F.lit(19)) == 0, 7).when(F.pmod(eid, F.lit(23)) == 0, 3)
         .when(F.pmod(eid, F.lit(13)) == 0, 2).otherwise(7))
    a = F.col("attempt_no")
    code = F.pmod(eid * 7 + a * 13, F.lit(10))
    formula = (F.when(code == 0, 412).when(code == 1, 410).when(code == 2, 404)
               .when(code.isin(3, 4), 500).otherwise(201))
    status = (
        F.when(F.pmod(eid, F.lit(19)) == 0, F.when(a <= 6, 500).otherwise(201))
        .when(F.pmod(eid, F.lit(23)) == 0, F.when(a <= 2, 500).otherwise(412))
        .when(F.pmod(eid, F.lit(13)) == 0, F.lit(500))
        .otherwise(formula)
    )
    return (
        requests.select("request_id", *dict.fromkeys(("seq", *keep)), F.explode(F.sequence(F.lit(1), n)).alias("attempt_no"))
        .select("request_id", F.col("attempt_no").cast("int").alias("attempt_no"),
                status.cast("int").alias("status"), *keep)
    )


def properties_frame(spark: SparkSession, props: list[tuple[str, str]] = FEED_PROPERTIES) -> DataFrame:
    """The feed deployment's properties as a (key, value, priority) DataFrame."""
    return spark.createDataFrame([(k, v, 0) for k, v in props], "key string, value string, priority int")
