"""Events -> per-route HTTP request rows.

All routes are produced in ONE pass over the events: each event builds a
small array of candidate requests (index / version / delete / media /
external), ``filter`` keeps those whose conditions hold and ``explode`` fans
them out.  No self-union, no shuffle: the whole step is a narrow projection,
so it pipelines inside one stage right after the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync import schema as S
from relaysync.functions.headers import default_header, keep_headers, set_header
from relaysync.functions.http_options import options_suffix
from relaysync.functions.parse import is_new_version, parse_events, strip_uuid
from relaysync.functions.urls import canonical_url, describes_url, json_url, jsonld_url
from relaysync.settings import Settings

# route families of the repository indexer
NODE, DELETE, MEDIA, EXTERNAL = "node", "delete", "media", "external"
PRIMARY_ROUTE = {NODE: S.NODE_INDEX, DELETE: S.NODE_DELETE, MEDIA: S.MEDIA_INDEX, EXTERNAL: S.EXTERNAL_INDEX}
AUTHORIZATION = "Authorization"


def family(stream: Column, settings: Settings) -> Column:
    """Route family of an event from its stream (C3); null for other streams."""
    if not settings.indexer_enabled:
        return F.lit(None).cast("string")
    return (
        F.when(stream == settings.node_stream, F.lit(NODE))
        .when(stream == settings.delete_stream, F.lit(DELETE))
        .when(stream == settings.media_stream, F.lit(MEDIA))
        .when(stream == settings.external_stream, F.lit(EXTERNAL))
    )


def event_fields(parsed: DataFrame) -> DataFrame:
    """Derived per-event properties (B4, B5, B6a-d, B8, B3)."""
    e = F.col("event")
    urls = e.getField("object").getField("url")
    return parsed.select(
        "*",
        strip_uuid(e.getField("object").getField("id")).alias("uuid"),
        e.getField("target").alias("base_url"),
        jsonld_url(urls).alias("jsonld_url"),
        json_url(urls).alias("json_url"),
        canonical_url(urls).alias("canonical_url"),
        describes_url(urls).alias("describes_url"),
        e.getField("attachment").getField("content").getField("source_field").alias("source_field"),
        is_new_version(e.getField("object").getField("isNewVersion")).alias("is_new_version"),
    )


def prepare(raw: DataFrame, strict: bool = False) -> DataFrame:
    """raw_events -> parsed events with derived fields."""
    return event_fields(parse_events(raw, strict=strict))


def _stop_reason(settings: Settings) -> Column:
    """Why an event of the indexer streams stops before fan-out."""
    fam = family(F.col("stream"), settings)
    uuid_missing = F.col("uuid").isNull() | (F.col("uuid") == "")
    return (
        F.when(fam.isNull(), F.lit(None).cast("string"))
        .when(F.col("malformed"), F.coalesce(F.col("parse_reason"), F.lit(S.R_MALFORMED)))
        .when(fam.isin(NODE, DELETE, EXTERNAL) & uuid_missing, F.lit(S.R_MISSING_ID))
        .when((fam == NODE) & F.col("jsonld_url").isNull(), F.lit(S.R_MISSING_JSONLD))
        .when((fam == MEDIA) & F.col("json_url").isNull(), F.lit(S.R_MISSING_JSON))
        .when((fam == MEDIA) & F.col("source_field").isNull(), F.lit(S.R_MISSING_SOURCE_FIELD))
        .when((fam == EXTERNAL) & F.col("canonical_url").isNull(), F.lit(S.R_MISSING_CANONICAL))
    )


def _policy(reason: Column, what: int) -> Column:
    expr = None
    for r, pair in S.PRE_DISPATCH_POLICY.items():
        expr = (F.when(reason == r, F.lit(pair[what])) if expr is None
                else expr.when(reason == r, F.lit(pair[what])))
    return expr


def event_outcomes(fields: DataFrame, settings: Settings) -> DataFrame:
    """Outcome rows of events that stop before any request is sent."""
    fam = family(F.col("stream"), settings)
    route = F.element_at(F.create_map(*[F.lit(x) for kv in PRIMARY_ROUTE.items() for x in kv]), fam)
    reason = _stop_reason(settings)
    return (
        fields.select("seq", "ts", route.alias("route"), reason.alias("reason"))
        .where(F.col("reason").isNotNull())
        .select(
            "seq", "ts",
            F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("route")).alias("request_id"),
            "route",
            _policy(F.col("reason"), 0).alias("outcome"),
            "reason",
            _policy(F.col("reason"), 1).alias("level"),
            F.lit(0).cast("bigint").alias("attempts"),
        )
    )


def service_base(settings: Settings) -> str:
    """Base URL with exactly one trailing slash."""
    return settings.service_base_url.rstrip("/") + "/"


def build_requests(fields: DataFrame, settings: Settings) -> DataFrame:
    """Fan events out into request rows (D1 + C1), every route in one pass (H1).

    Columns: request_id, seq, ts, stream, route, method, uri,
    content_location, base_url, headers.
    """
    fam = family(F.col("stream"), settings)
    ok = F.col("reason").isNull()
    version = F.coalesce(F.col("is_new_version"), F.lit(False))
    uuid, sf = F.col("uuid"), F.col("source_field")
    null = F.lit(None).cast("string")

    def cand(route: str, method: str, path: Column, loc: Column, keep: Column) -> Column:
        return F.struct(
            F.lit(route).alias("route"), F.lit(method).alias("method"),
            path.alias("path"), loc.alias("content_location"), keep.alias("keep"),
        )

    node_ok = ok & (fam == NODE)
    media_ok = ok & (fam == MEDIA)
    candidates = (
        F.when(fam == NODE, F.array(
            cand(S.NODE_INDEX, "POST", F.concat(F.lit("node/"), uuid), F.col("jsonld_url"), node_ok),
            cand(S.NODE_VERSION, "POST", F.concat(F.lit("node/"), uuid, F.lit("/version")),
                 F.col("jsonld_url"), node_ok & version),
        ))
        .when(fam == DELETE, F.array(
            cand(S.NODE_DELETE, "DELETE", F.concat(F.lit("node/"), uuid), null, ok),
        ))
        .when(fam == MEDIA, F.array(
            cand(S.MEDIA_INDEX, "POST", F.concat(F.lit("media/"), sf), F.col("json_url"), media_ok),
            cand(S.MEDIA_VERSION, "POST", F.concat(F.lit("media/"), sf, F.lit("/version")),
                 F.col("json_url"), media_ok & version),
        ))
        .when(fam == EXTERNAL, F.array(
            cand(S.EXTERNAL_INDEX, "POST", F.concat(F.lit("external/"), uuid), F.col("canonical_url"), ok),
        ))
    )
    # The paths never contain '?', the base URL may: the option suffix is a
    # constant folded into the plan (built once on the driver).
    base = service_base(settings)
    suffix = options_suffix(settings.http_options, force_ampersand="?" in base)

    staged = (
        fields.withColumn("reason", _stop_reason(settings))
        .select("seq", "ts", "stream", "headers", "base_url",
                F.explode(F.filter(candidates, lambda c: c.getField("keep"))).alias("r"))
    )
    hdrs = set_header(keep_headers(F.col("headers"), [AUTHORIZATION]),
                      settings.base_url_header, F.col("base_url"))
    if settings.auth_token:
        hdrs = default_header(hdrs, AUTHORIZATION, F.lit("Bearer " + settings.auth_token))
    r = F.col("r")
    return staged.select(
        F.concat(F.col("seq").cast("string"), F.lit(":"), r.getField("route")).alias("request_id"),
        "seq", "ts", "stream",
        r.getField("route").alias("route"),
        r.getField("method").alias("method"),
        F.concat(F.lit(base), r.getField("path"), F.lit(suffix)).alias("uri"),
        r.getField("content_location").alias("content_location"),
        "base_url",
        hdrs.alias("headers"),
    )


def requests_from_raw(raw: DataFrame, settings: Settings, strict: bool = False,
                      transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """raw_events -> requests.  ``transform`` is the user hook (J1) applied to
    the parsed events before dispatch, e.g. ``lambda df: df.where(...)`` or a
    function adding columns with ``F.expr``; it must keep the event columns."""
    fields = prepare(raw, strict)
    if transform is not None:
        fields = fields.transform(transform)
    return build_requests(fields, settings)


def flatten_envelope(fields: DataFrame) -> DataFrame:
    """Envelope fields of parsed events, actor's canonical link included."""
    e = F.col("event")
    actor = e.getField("actor")
    return fields.select(
        "seq",
        e.getField("@context").alias("context"),
        e.getField("type").alias("type"),
        e.getField("summary").alias("summary"),
        actor.getField("type").alias("actor_type"),
        actor.getField("id").alias("actor_id"),
        canonical_url(actor.getField("url")).alias("actor_url"),
        e.getField("attachment").getField("type").alias("attachment_type"),
        e.getField("attachment").getField("mediaType").alias("attachment_media_type"),
    )


def indexer_streams(settings: Settings) -> list[str]:
    return [settings.node_stream, settings.delete_stream, settings.media_stream, settings.external_stream]


def requests_from_landed(landed: DataFrame, settings: Settings) -> DataFrame:
    """Requests from a landed raw_events table partitioned by ``stream``.

    The stream filter (C3) is on the partition column, so only the indexer
    streams' files are read (partition pruning), never the derivative ones.
    """
    return requests_from_raw(landed.where(F.col("stream").isin(*indexer_streams(settings))), settings)
