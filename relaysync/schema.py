"""Schemas and fixed tables (routes, error policy) of the engine."""

from __future__ import annotations

# Link element of ``object.url`` / ``actor.url``.
URL_DDL = "struct<name:string,type:string,href:string,mediaType:string,rel:string>"

# Attachment content uses snake_case JSON names (fixed values of the event format).
CONTENT_DDL = (
    "struct<fedora_uri:string,source_field:string,source_uri:string,"
    "destination_uri:string,mimetype:string,args:string,file_upload_uri:string>"
)

CORRUPT_COL = "_corrupt_record"

# isNewVersion stays a string: a boolean field would turn the string "true"
# into null.  It is coerced afterwards (functions.parse.is_new_version).
EVENT_DDL = (
    "`@context` string, type string, summary string, target string, "
    f"object struct<type:string, id:string, url:array<{URL_DDL}>, isNewVersion:string>, "
    f"actor struct<type:string, id:string, url:array<{URL_DDL}>>, "
    f"attachment struct<type:string, mediaType:string, content:{CONTENT_DDL}>, "
    f"{CORRUPT_COL} string"
)


# Top-level keys the event model knows (for strict parsing).
KNOWN_KEYS = ["@context", "type", "summary", "target", "object", "actor", "attachment"]
# Keys of the nested objects (for strict parsing).
KNOWN_NESTED = {
    "object": ["type", "id", "url", "isNewVersion"],
    "actor": ["type", "id", "url"],
    "attachment": ["type", "mediaType", "content"],
}
KNOWN_URL = ["name", "type", "href", "mediaType", "rel"]
KNOWN_CONTENT = ["fedora_uri", "source_field", "source_uri", "destination_uri", "mimetype", "args", "file_upload_uri"]

RAW_EVENTS_DDL = "seq bigint, ts timestamp, stream string, headers map<string,string>, body string"

ATTEMPTS_DDL = "request_id string, attempt_no int, status int"
RESOURCES_DDL = "url string, body string"
TRIPLES_DDL = "s string, p string, o string, o_kind string, datatype string, lang string"

# --- fixed values: route names and what each route sends -------------------
NODE_INDEX = "node_index"
NODE_VERSION = "node_version"
NODE_DELETE = "node_delete"
MEDIA_INDEX = "media_index"
MEDIA_VERSION = "media_version"
EXTERNAL_INDEX = "external_index"
TRIPLES_INDEX = "triples_index"
TRIPLES_DELETE = "triples_delete"

# --- fixed values: media types and link relations picked from object.url ---
MT_JSONLD = "application/ld+json"
MT_JSON = "application/json"
REL_CANONICAL = "canonical"
REL_DESCRIBES = "describes"

# --- fixed values: reasons ------------------------------------------------
R_MALFORMED = "malformed"
R_UNKNOWN_FIELD = "unknown_field"
R_MISSING_ID = "missing_id"
R_MISSING_JSONLD = "missing_jsonld_url"
R_MISSING_JSON = "missing_json_url"
R_MISSING_CANONICAL = "missing_canonical_url"
R_MISSING_SOURCE_FIELD = "missing_source_field"
R_MISSING_ATTACHMENT = "missing_attachment"
R_RESOURCE_MISSING = "resource_missing"
R_DOCUMENT_REJECTED = "document_rejected"
R_ILLEGAL_SUBJECT = "illegal_subject"

# --- fixed values: error policy before dispatch ---------------------------
# (reason, outcome, level); route scoping is applied in operators.requests.
PRE_DISPATCH_POLICY = {
    R_MISSING_JSONLD: ("skipped", "WARN"),
    R_MISSING_JSON: ("skipped", "WARN"),
    R_MISSING_CANONICAL: ("skipped", "ERROR"),
    R_MISSING_SOURCE_FIELD: ("failed", "ERROR"),
    R_MISSING_ID: ("failed", "ERROR"),
    R_MALFORMED: ("failed", "ERROR"),
    R_UNKNOWN_FIELD: ("failed", "ERROR"),
    R_MISSING_ATTACHMENT: ("failed", "ERROR"),
}

# --- fixed values: HTTP status handling after dispatch ---------------------
# 2xx -> ok; a status below, on one of its routes -> skipped at once with that
# level; everything else is retried and finally failed (ERROR).  Triplestore
# and derivative routes skip nothing.
STATUS_PRECONDITION_FAILED = 412
STATUS_GONE = 410
STATUS_NOT_FOUND = 404
INDEXER_ROUTES = [NODE_INDEX, NODE_VERSION, NODE_DELETE, MEDIA_INDEX, MEDIA_VERSION, EXTERNAL_INDEX]
STATUS_SKIPS = {
    STATUS_PRECONDITION_FAILED: (INDEXER_ROUTES, "INFO"),
    STATUS_GONE: (INDEXER_ROUTES, "WARN"),
    STATUS_NOT_FOUND: ([NODE_DELETE], "INFO"),
}
R_NO_ANSWER = "no_answer"

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
XSD_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"
XSD_BOOLEAN = "http://www.w3.org/2001/XMLSchema#boolean"
