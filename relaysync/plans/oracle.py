"""DuckDB oracle SQL for every registered query.

The oracles never read our JSON: they compute the expected rows straight from
the raw ``events`` / ``pages`` columns with the feed rules (sources/feed.py),
so they check the Spark path independently.  DuckDB string literals do not
process backslash escapes, and ``concat`` skips nulls, so ``||`` is used.
"""

from __future__ import annotations

from relaysync.sources import feed

BASE = feed.FEED_SETTINGS.service_base_url.rstrip("/") + "/"
SUFFIX = "?connectionClose=true&disableStreamCache=true"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
SO = feed.SCHEMA_ORG

F_CTE = f"""
f AS (
  SELECT event_id, user_id, ts, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS m,
         CASE event_type WHEN 'click' THEN 'node' WHEN 'signup' THEN 'delete' WHEN 'view' THEN 'media'
              WHEN 'purchase' THEN 'external' WHEN 'error' THEN 'derivative' END AS kind,
         ['techmd', 'audio', 'image', 'ocr'][event_id % 4 + 1] AS item,
         '{feed.CMS}' || CAST(user_id AS VARCHAR) AS canon,
         '{feed.UUID_PREFIX}' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS uuid
  FROM events
)"""

REQ_CTE = f"""
req AS (
  SELECT event_id, user_id, m, 'node_index' AS route, 'POST' AS method,
         '{BASE}node/' || uuid || '{SUFFIX}' AS uri, canon || '?_format=jsonld' AS content_location,
         CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}node' END AS base_url
  FROM f WHERE kind = 'node' AND m NOT IN (0, 3, 8)
  UNION ALL
  SELECT event_id, user_id, m, 'node_version', 'POST', '{BASE}node/' || uuid || '/version{SUFFIX}',
         canon || '?_format=jsonld', CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}node' END
  FROM f WHERE kind = 'node' AND m IN (5, 6)
  UNION ALL
  SELECT event_id, user_id, m, 'node_delete', 'DELETE', '{BASE}node/' || uuid || '{SUFFIX}', NULL,
         CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}delete' END
  FROM f WHERE kind = 'delete' AND m <> 8
  UNION ALL
  SELECT event_id, user_id, m, 'media_index', 'POST',
         '{BASE}media/field_media_' || CAST(event_id % 3 AS VARCHAR) || '{SUFFIX}',
         canon || '?_format=json', CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}media' END
  FROM f WHERE kind = 'media' AND m NOT IN (1, 3, 8) AND event_id % 11 <> 0
  UNION ALL
  SELECT event_id, user_id, m, 'media_version', 'POST',
         '{BASE}media/field_media_' || CAST(event_id % 3 AS VARCHAR) || '/version{SUFFIX}',
         canon || '?_format=json', CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}media' END
  FROM f WHERE kind = 'media' AND m IN (5, 6) AND event_id % 11 <> 0
  UNION ALL
  SELECT event_id, user_id, m, 'external_index', 'POST', '{BASE}external/' || uuid || '{SUFFIX}', canon,
         CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}external' END
  FROM f WHERE kind = 'external' AND m NOT IN (2, 3, 8)
),
r AS (SELECT CAST(event_id AS VARCHAR) || ':' || route AS request_id, * FROM req)"""

ATT_CTE = """
att AS (
  SELECT r.request_id, r.route, r.event_id, CAST(a.attempt_no AS BIGINT) AS attempt_no,
    CAST(CASE
      WHEN r.event_id % 19 = 0 THEN CASE WHEN a.attempt_no <= 6 THEN 500 ELSE 201 END
      WHEN r.event_id % 23 = 0 THEN CASE WHEN a.attempt_no <= 2 THEN 500 ELSE 412 END
      WHEN r.event_id % 13 = 0 THEN 500
      ELSE CASE (r.event_id * 7 + a.attempt_no * 13) % 10
             WHEN 0 THEN 412 WHEN 1 THEN 410 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 500 ELSE 201 END
    END AS BIGINT) AS status
  FROM r CROSS JOIN (SELECT range AS attempt_no FROM range(1, 8)) a
  WHERE a.attempt_no <= CASE WHEN r.event_id % 19 = 0 THEN 7 WHEN r.event_id % 23 = 0 THEN 3
                             WHEN r.event_id % 13 = 0 THEN 2 ELSE 7 END
),
cls AS (
  SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (412, 410) THEN 'skip'
                 WHEN status = 404 AND route = 'node_delete' THEN 'skip' ELSE 'retry' END AS class
  FROM att
),
agg AS (
  SELECT request_id, count(*) AS n,
         min(attempt_no) FILTER (WHERE class <> 'retry') AS t,
         arg_min(status, attempt_no) FILTER (WHERE class <> 'retry') AS t_status,
         arg_max(status, attempt_no) AS last_status
  FROM cls WHERE attempt_no <= 6 GROUP BY request_id
),
done AS (
  SELECT r.event_id, r.request_id, r.route,
    CASE WHEN t IS NOT NULL THEN CASE WHEN t_status BETWEEN 200 AND 299 THEN 'ok' ELSE 'skipped' END
         WHEN coalesce(n, 0) >= 6 THEN 'failed' ELSE 'pending' END AS outcome,
    'http_' || CAST(CASE WHEN t IS NOT NULL THEN t_status ELSE last_status END AS VARCHAR) AS reason,
    CAST(CASE WHEN t IS NOT NULL THEN t ELSE coalesce(n, 0) END AS BIGINT) AS attempts
  FROM r LEFT JOIN agg USING (request_id)
)"""

PRE_CTE = """
pre AS (
  SELECT event_id, route, reason,
         CASE WHEN reason IN ('malformed', 'missing_source_field') THEN 'failed' ELSE 'skipped' END AS outcome,
         CASE WHEN reason IN ('missing_jsonld_url', 'missing_json_url') THEN 'WARN' ELSE 'ERROR' END AS level
  FROM (
    SELECT event_id,
      CASE kind WHEN 'node' THEN 'node_index' WHEN 'delete' THEN 'node_delete' WHEN 'media' THEN 'media_index'
                WHEN 'external' THEN 'external_index' END AS route,
      CASE WHEN m = 8 THEN 'malformed'
           WHEN kind = 'node' AND m IN (0, 3) THEN 'missing_jsonld_url'
           WHEN kind = 'media' AND m IN (1, 3) THEN 'missing_json_url'
           WHEN kind = 'media' AND event_id % 11 = 0 THEN 'missing_source_field'
           WHEN kind = 'external' AND m IN (2, 3) THEN 'missing_canonical_url' END AS reason
    FROM f WHERE kind <> 'derivative'
  ) x WHERE reason IS NOT NULL
),
allout AS (
  SELECT event_id, route, outcome FROM pre
  UNION ALL SELECT event_id, route, outcome FROM done
)"""

DOC_CTE = f"""
pg AS (
  SELECT page_id, '{feed.CMS}' || CAST(page_id AS VARCHAR) AS s, url, html FROM pages
),
alldoc AS (
  SELECT page_id, s, '{RDF_TYPE}' AS p, '{feed.PAGE_TYPE}' AS o, 'iri' AS o_kind,
         CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang FROM pg
  UNION ALL SELECT page_id, s, '{SO}url', url, 'iri', NULL, NULL FROM pg
  UNION ALL SELECT page_id, s, '{SO}size', CAST(length(html) AS VARCHAR), 'literal', '{XSD_INTEGER}', NULL FROM pg
  UNION ALL SELECT page_id, s, '{SO}name', regexp_extract(html, '<title>([^<]*)</title>', 1), 'literal', NULL,
    nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') FROM pg
),
doc AS (SELECT s, p, o, o_kind, datatype, lang FROM alldoc WHERE page_id % 17 <> 0),
prior AS (
  SELECT s, '{SO}version' AS p, 'old' AS o, 'literal' AS o_kind,
         CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang FROM pg
),
sev AS (
  SELECT event_id, CASE kind WHEN 'node' THEN 'index' ELSE 'delete' END AS k, canon AS s
  FROM f
  WHERE kind IN ('node', 'delete') AND m NOT IN (2, 3, 8)
    AND NOT (kind = 'node' AND (m = 0 OR user_id NOT IN (SELECT page_id FROM pages WHERE page_id % 17 <> 0)))
),
win AS (SELECT s, max(event_id) AS seq, arg_max(k, event_id) AS kind FROM sev GROUP BY s),
win_idx AS (SELECT s, max(event_id) AS seq FROM sev WHERE k = 'index' GROUP BY s)"""


TEV_CTE = """
tev AS (
  SELECT event_id, CASE kind WHEN 'node' THEN 'triples_index' ELSE 'triples_delete' END AS route,
    CASE WHEN m = 8 THEN 'malformed'
         WHEN m IN (2, 3) THEN 'missing_canonical_url'
         WHEN kind = 'node' AND m = 0 THEN 'missing_jsonld_url'
         WHEN kind = 'node' AND user_id NOT IN (SELECT page_id FROM pages WHERE page_id % 17 <> 0)
           THEN 'resource_missing'
         WHEN event_id IN (SELECT seq FROM win) THEN 'applied'
         ELSE 'superseded' END AS reason
  FROM f WHERE kind IN ('node', 'delete')
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _esc(col: str) -> str:
    return (f"replace(replace(replace(replace({col}, '\\', '\\\\'), '\"', '\\\"'), "
            f"chr(10), '\\n'), chr(13), '\\r')")


NTRIPLE = ("'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE "
           "'\"' || " + _esc("o") + " || '\"' || CASE WHEN lang IS NOT NULL THEN '@' || lang "
           "WHEN datatype IS NOT NULL THEN '^^<' || datatype || '>' ELSE '' END END || ' .'")

# expected option suffix of each HTTP_OPTION_CASES entry, worked out by hand
HTTP_OPTION_GOLDEN = [
    "connectionClose=true&disableStreamCache=true",
    "soTimeout=4500&connectionClose=true&disableStreamCache=true",
    "soTimeout=4500&tag=night run&connectionClose=true&disableStreamCache=true",
    "disableStreamCache=auto&zone=b7&connectionClose=true",
    "connectionClose=later&disableStreamCache=true",
    "&first=x&last=y&connectionClose=true&disableStreamCache=true",
    "CONNECTIONCLOSE=1&connectionClose=true&disableStreamCache=true",
    "connectionClose=no&disableStreamCache=no",
    "connectionClose=true&disableStreamCache=true",
    "edge=tab&connectionClose=true&disableStreamCache=true",
]

_type = ("CASE kind WHEN 'delete' THEN 'Delete' WHEN 'external' THEN 'Create' "
         "WHEN 'derivative' THEN 'Activity' ELSE 'Update' END")
_stream = ("CASE kind WHEN 'node' THEN 'queue:sync-node' WHEN 'delete' THEN 'queue:sync-delete' "
           "WHEN 'media' THEN 'queue:sync-media' WHEN 'external' THEN 'queue:sync-external' "
           "ELSE 'queue:derivative-' || item END")
_req_cols = "request_id, method, uri, content_location, base_url"

SQL: dict[str, str] = {
    "parse_ok": _with(F_CTE) + f"""
SELECT event_id AS seq, uuid, {_type} AS type,
       CASE WHEN m = 9 THEN NULL ELSE '{feed.REPO_TARGET}' || kind END AS target
FROM f WHERE m <> 8""",
    "quarantine": _with(F_CTE) + "\nSELECT event_id AS seq, 'malformed' AS reason FROM f WHERE m = 8",
    "flatten_envelope": _with(F_CTE) + f"""
SELECT event_id AS seq, '{feed.CONTEXT}' AS context,
       CASE WHEN event_id % 4 <> 3 THEN {_type} || ' a ' || kind END AS summary,
       'urn:uuid:{feed.ACTOR_PREFIX}' || lpad(CAST(event_id % 50 AS VARCHAR), 12, '0') AS actor_id,
       'http://cms/user/' || CAST(event_id % 50 AS VARCHAR) AS actor_url,
       CASE WHEN kind IN ('media', 'derivative') THEN 'Object' END AS attachment_type
FROM f WHERE m <> 8""",
    "first_urls": _with(F_CTE) + """
SELECT event_id AS seq,
       CASE WHEN m IN (0, 3) THEN NULL ELSE canon || '?_format=jsonld' END AS jsonld_url,
       CASE WHEN m IN (1, 3) THEN NULL ELSE canon || '?_format=json' END AS json_url,
       CASE WHEN m IN (2, 3) THEN NULL ELSE canon END AS canonical_url,
       CASE WHEN m IN (6, 7) THEN canon END AS describes_url
FROM f WHERE m <> 8""",
    "missing_url_outcomes": _with(F_CTE, REQ_CTE, ATT_CTE, PRE_CTE) + """
SELECT event_id AS seq, route, reason, outcome, level FROM pre WHERE reason LIKE 'missing_%'""",
    "node_requests": _with(F_CTE, REQ_CTE) + f"\nSELECT {_req_cols} FROM r WHERE route IN ('node_index', 'node_version')",
    "media_requests": _with(F_CTE, REQ_CTE) + f"\nSELECT {_req_cols} FROM r WHERE route IN ('media_index', 'media_version')",
    "external_requests": _with(F_CTE, REQ_CTE) + f"\nSELECT {_req_cols} FROM r WHERE route = 'external_index'",
    "delete_requests": _with(F_CTE, REQ_CTE) + f"\nSELECT {_req_cols} FROM r WHERE route = 'node_delete'",
    "all_requests": _with(F_CTE, REQ_CTE) + "\nSELECT request_id, route, method, uri, content_location, base_url FROM r",
    "version_requests": _with(F_CTE, REQ_CTE) + "\nSELECT request_id, uri FROM r WHERE route IN ('node_version', 'media_version')",
    "header_policy": _with(F_CTE, REQ_CTE) + """
SELECT request_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'Bearer ' || CAST(user_id AS VARCHAR) END AS authorization,
       base_url AS base_header,
       CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS BIGINT) AS header_count
FROM r""",
    "default_auth": _with(F_CTE, REQ_CTE) + """
SELECT request_id,
       CASE WHEN event_id % 7 = 0 THEN 'Bearer static-token' ELSE 'Bearer ' || CAST(user_id AS VARCHAR) END
         AS authorization
FROM r""",
    "http_options": _with(F_CTE) + ", g AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{v}')" for i, v in enumerate(HTTP_OPTION_GOLDEN)) + """) t(gm, common)),
e AS (
  SELECT event_id, m,
         CASE WHEN event_id % 3 = 0 THEN 'http://svc/' || event_type || '?id=' || CAST(event_id AS VARCHAR)
              WHEN event_id % 3 = 1 THEN 'http://svc/' || event_type ELSE '' END AS endpoint
  FROM f
)
SELECT event_id AS seq,
       endpoint || CASE WHEN endpoint = '' THEN '' WHEN contains(endpoint, '?') OR event_id % 2 = 0 THEN '&'
                        ELSE '?' END || common AS uri
FROM e JOIN g ON e.m = g.gm""",
    "derivative_requests": _with(F_CTE) + f"""
SELECT event_id AS seq, 'derivative.' || item AS route, CAST(event_id AS VARCHAR) || ':derivative.' || item AS request_id,
       'http://svc/' || item || '/convert{SUFFIX}' AS service_uri,
       'http://cms/files/' || CAST(user_id AS VARCHAR) || '/original.jpg' AS source_uri,
       CASE WHEN event_id % 2 = 0 THEN '' ELSE '-quality ' || CAST(event_id % 100 AS VARCHAR) END AS args,
       CASE item WHEN 'techmd' THEN 'application/xml' WHEN 'audio' THEN 'audio/mpeg'
                 WHEN 'image' THEN 'image/jpeg' ELSE 'text/plain' END AS mimetype,
       canon || '/media/' || item || '/' || CAST(event_id AS VARCHAR) AS destination_uri,
       'private://derivatives/' || item || '/' || CAST(event_id AS VARCHAR) || ' file.bin' AS file_upload_uri
FROM f WHERE kind = 'derivative' AND m <> 8 AND item <> 'ocr'""",
    "recipient_fanout": _with(F_CTE) + """
SELECT event_id AS seq, 'audit' AS recipient FROM f WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'search' FROM f WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'shard-' || CAST(event_id % 4 AS VARCHAR) FROM f WHERE event_id % 3 = 0""",
    "dedup_messages": _with(F_CTE) + f"""
SELECT 'msg-' || CAST(event_id AS VARCHAR) AS message_id, event_id AS seq, {_stream} AS stream FROM f""",
    "response_classes": _with(F_CTE, REQ_CTE, ATT_CTE) + "\nSELECT request_id, attempt_no, status, class FROM cls",
    "redelivery_outcomes": _with(F_CTE, REQ_CTE, ATT_CTE) + "\nSELECT request_id, outcome, reason, attempts FROM done",
    "outcome_rollup": _with(F_CTE, REQ_CTE, ATT_CTE, PRE_CTE) + """
SELECT route, outcome, count(*) AS n FROM allout GROUP BY ROLLUP (route, outcome)""",
    "daily_outcomes": _with(F_CTE, REQ_CTE, ATT_CTE, PRE_CTE) + """
SELECT strftime(f.ts, '%Y-%m-%d') AS day, outcome, count(*) AS n
FROM allout JOIN f USING (event_id) GROUP BY 1, 2""",
    "jsonld_triples": _with(F_CTE, DOC_CTE) + "\nSELECT s, p, o, o_kind, datatype, lang FROM alldoc",
    "latest_per_subject": _with(F_CTE, DOC_CTE) + "\nSELECT s, seq, kind FROM win",
    "triples_after_replace": _with(F_CTE, DOC_CTE) + """
SELECT * FROM prior WHERE s NOT IN (SELECT s FROM win_idx)
UNION ALL SELECT * FROM doc WHERE s IN (SELECT s FROM win_idx)""",
    "triples_after_delete": _with(F_CTE, DOC_CTE) + """
SELECT * FROM prior WHERE s NOT IN (SELECT s FROM win)
UNION ALL SELECT * FROM doc WHERE s IN (SELECT s FROM win WHERE kind = 'index')""",
    "changeset": _with(F_CTE, DOC_CTE) + """
SELECT 'delete' AS op, win.seq, prior.* FROM prior JOIN win USING (s)
UNION ALL
SELECT 'insert', win.seq, doc.* FROM doc JOIN win USING (s) WHERE win.kind = 'index'""",
    "render_update": _with(F_CTE, DOC_CTE) + f""",
lines AS (SELECT s, {NTRIPLE} AS line FROM doc WHERE s IN (SELECT s FROM win WHERE kind = 'index')),
ins AS (SELECT s, 'INSERT DATA {{ ' || string_agg(line, ' ' ORDER BY line) || ' }}' AS body FROM lines GROUP BY s)
SELECT s, CAST(0 AS BIGINT) AS step, 'DELETE WHERE {{ <' || s || '> ?p ?o }}' AS update_text FROM win
UNION ALL SELECT s, 1, body FROM ins""",
}
SQL["triples_outcomes"] = _with(F_CTE, DOC_CTE, TEV_CTE) + """
SELECT event_id AS seq, route,
       CASE WHEN reason IN ('applied', 'superseded') THEN 'ok'
            WHEN reason IN ('malformed', 'resource_missing') THEN 'failed' ELSE 'skipped' END AS outcome,
       reason,
       CASE WHEN reason IN ('applied', 'superseded') THEN 'DEBUG'
            WHEN reason IN ('malformed', 'resource_missing') THEN 'ERROR' ELSE 'WARN' END AS level
FROM tev"""
SQL["derivative_outcomes"] = _with(F_CTE) + """
SELECT event_id AS seq, 'derivative.' || item AS route, 'failed' AS outcome, 'malformed' AS reason, 'ERROR' AS level
FROM f WHERE kind = 'derivative' AND m = 8 AND item <> 'ocr'"""
SQL["triples_requests"] = _with(F_CTE, DOC_CTE) + f""",
lines AS (SELECT s, {NTRIPLE} AS line FROM doc WHERE s IN (SELECT s FROM win WHERE kind = 'index')),
ins AS (SELECT s, 'INSERT DATA {{ ' || string_agg(line, ' ' ORDER BY line) || ' }}' AS body FROM lines GROUP BY s),
r AS (SELECT win.*, CASE win.kind WHEN 'index' THEN 'triples_index' ELSE 'triples_delete' END AS route FROM win)
SELECT CAST(r.seq AS VARCHAR) || ':' || r.route || ':' || CAST(u.step AS VARCHAR) AS request_id, r.seq, u.step,
       r.route, 'POST' AS method, 'http://triples/sparql{SUFFIX}' AS uri,
       'application/sparql-update' AS content_type, u.body
FROM r JOIN (
  SELECT s, CAST(0 AS BIGINT) AS step, 'DELETE WHERE {{ <' || s || '> ?p ?o }}' AS body FROM win
  UNION ALL SELECT s, 1, body FROM ins
) u USING (s)"""
SQL["stream_requests"] = SQL["all_requests"]
SQL["stream_latest"] = SQL["latest_per_subject"]
SQL["stream_triples_after_delete"] = SQL["triples_after_delete"]
SQL["stream_outcomes"] = SQL["redelivery_outcomes"]
SQL["stream_daily_outcomes"] = SQL["daily_outcomes"]

SQL["late_messages"] = SQL["dedup_messages"]
SQL["jsonld_rejects"] = f"""
SELECT '{feed.CMS}' || CAST(page_id AS VARCHAR) || '?_format=jsonld' AS url,
       CASE WHEN page_id % 6 = 4 THEN 'not_json' ELSE 'no_triples' END AS reason
FROM pages WHERE page_id % 6 IN (1, 2, 3, 4)"""
SQL["no_answer_outcomes"] = _with(F_CTE, REQ_CTE, ATT_CTE) + """,
seen AS (
  SELECT request_id, attempt_no,
         CASE WHEN (event_id + attempt_no) % 3 = 0 THEN 'retry' ELSE class END AS class,
         CASE WHEN (event_id + attempt_no) % 3 = 0 THEN 'no_answer'
              ELSE 'http_' || CAST(status AS VARCHAR) END AS reason
  FROM cls WHERE attempt_no <= 6
),
fin AS (
  SELECT request_id, count(*) AS n,
         min(attempt_no) FILTER (WHERE class <> 'retry') AS t,
         arg_min(reason, attempt_no) FILTER (WHERE class <> 'retry') AS t_reason,
         arg_min(class, attempt_no) FILTER (WHERE class <> 'retry') AS t_class,
         arg_max(reason, attempt_no) AS last_reason
  FROM seen GROUP BY request_id
)
SELECT request_id,
       CASE WHEN t_class = 'ok' THEN 'ok' WHEN t_class = 'skip' THEN 'skipped'
            WHEN n >= 6 THEN 'failed' ELSE 'pending' END AS outcome,
       coalesce(t_reason, last_reason) AS reason,
       coalesce(t, n) AS attempts
FROM fin"""
SQL["stream_responses"] = _with(F_CTE, REQ_CTE, ATT_CTE) + """
SELECT request_id, attempt_no, status, class FROM cls WHERE event_id % 29 <> 0
UNION ALL SELECT request_id, NULL, NULL, 'pending' FROM r WHERE event_id % 29 = 0"""
_FINAL = """
  SELECT request_id,
         CASE arg_min(class, attempt_no) FILTER (WHERE class <> 'retry') WHEN 'ok' THEN 'ok' WHEN 'skip' THEN 'skipped'
              ELSE CASE WHEN max(attempt_no) >= 6 THEN 'failed' ELSE 'pending' END END AS outcome,
         'http_' || CAST(coalesce(arg_min(status, attempt_no) FILTER (WHERE class <> 'retry'),
                                  arg_max(status, attempt_no)) AS VARCHAR) AS reason,
         coalesce(min(attempt_no) FILTER (WHERE class <> 'retry'), max(attempt_no)) AS attempts
  FROM cls WHERE attempt_no <= 6 {only} GROUP BY request_id"""
SQL["final_outcomes"] = _with(F_CTE, REQ_CTE, ATT_CTE) + f""",
closed AS ({_FINAL.format(only="AND (event_id % 31 <> 0 OR attempt_no = 1)")}),
later AS ({_FINAL.format(only="")})
SELECT 'final' AS kind, request_id, outcome, reason, attempts FROM closed
UNION ALL SELECT 'correction', * FROM (SELECT * FROM later EXCEPT SELECT * FROM closed)"""
SQL["sync_triples"] = SQL["triples_after_delete"]
SQL["late_documents"] = _with(F_CTE, DOC_CTE, TEV_CTE) + """
SELECT s, seq, kind AS what FROM win
UNION ALL SELECT NULL, event_id, reason FROM tev WHERE reason = 'resource_missing'"""
SQL["committed_reads"] = SQL["all_requests"]
SQL["subject_transitions"] = _with(F_CTE) + """,
ev AS (
  SELECT event_id AS seq, canon AS s, CASE kind WHEN 'node' THEN 'index' ELSE 'delete' END AS kind
  FROM f WHERE kind IN ('node', 'delete') AND m NOT IN (2, 3, 8) AND NOT (kind = 'node' AND m = 0)
),
l AS (SELECT *, lag(kind) OVER (PARTITION BY s ORDER BY seq) AS prev FROM ev)
SELECT s, seq, kind, coalesce(prev, 'none') AS before,
       CASE WHEN kind = 'index' THEN CASE WHEN prev = 'index' THEN 'updated' ELSE 'created' END
            WHEN prev = 'index' THEN 'deleted' ELSE 'absent' END AS change
FROM l"""
SQL["landed_requests"] = SQL["all_requests"]
SQL["transformed_requests"] = _with(F_CTE, REQ_CTE) + f"""
SELECT request_id, route, method, uri, content_location,
       CASE route WHEN 'node_delete' THEN 'Delete' WHEN 'external_index' THEN 'Create' ELSE 'Update' END AS base_url
FROM r WHERE event_id % 4 <> 3"""
SQL["strict_outcomes"] = _with(F_CTE) + """
SELECT event_id AS seq,
       CASE kind WHEN 'node' THEN 'node_index' WHEN 'delete' THEN 'node_delete' WHEN 'media' THEN 'media_index'
                 WHEN 'external' THEN 'external_index' END AS route,
       'unknown_field' AS reason, 'failed' AS outcome, 'ERROR' AS level
FROM f WHERE kind <> 'derivative' AND m <> 8 AND event_id % 6 IN (1, 2, 4)"""
SQL["sync_outcomes"] = _with(F_CTE, REQ_CTE, ATT_CTE, PRE_CTE, DOC_CTE, TEV_CTE) + """
SELECT CAST(event_id AS VARCHAR) || ':' || route AS request_id, route, outcome, level, CAST(0 AS BIGINT) AS attempts
FROM pre
UNION ALL SELECT request_id, route, outcome,
  CASE outcome WHEN 'ok' THEN 'DEBUG' WHEN 'failed' THEN 'ERROR'
    WHEN 'skipped' THEN CASE reason WHEN 'http_410' THEN 'WARN' ELSE 'INFO' END END, attempts
FROM done
UNION ALL SELECT CAST(event_id AS VARCHAR) || ':' || route, route,
  CASE WHEN reason IN ('malformed', 'resource_missing') THEN 'failed' ELSE 'skipped' END,
  CASE WHEN reason IN ('malformed', 'resource_missing') THEN 'ERROR' ELSE 'WARN' END, 0
FROM tev WHERE reason NOT IN ('applied', 'superseded')
UNION ALL SELECT CAST(event_id AS VARCHAR) || ':derivative.' || item, 'derivative.' || item,
  CASE WHEN m = 8 THEN 'failed' ELSE 'pending' END, CASE WHEN m = 8 THEN 'ERROR' END, 0
FROM f WHERE kind = 'derivative' AND item <> 'ocr'"""
