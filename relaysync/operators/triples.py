"""Triplestore synchronisation as table operations.

* ``jsonld_triples`` flattens expanded JSON-LD (``@graph`` of nodes) with
  VARIANT casts + ``explode``: graph -> nodes -> predicates -> values.
* ``subject_events`` / ``latest_per_subject``: last writer wins per subject
  across index AND delete events; the tie-break is ``seq`` (queue order).
  ``max_by`` is a partial aggregate, so a subject holding a third of all
  events is collapsed map-side before the shuffle.
* ``apply_changes`` = prior triples ``left_anti`` changed subjects, union the
  documents of index winners.  With AQE the anti-join is split when one
  subject is hot, or turned into a broadcast join when the measured winner
  set is small; nothing is broadcast on a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync import schema as S
from relaysync.functions.ntriples import ntriple
from relaysync.operators.ordered import lagged, segmented
from relaysync.settings import Settings

INDEX, DELETE = "index", "delete"
TRIPLE_COLS = ["s", "p", "o", "o_kind", "datatype", "lang"]
# Largest number of triples rendered into one update text (bounded output rows).
RENDER_CHUNK = 10000


def _values(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def jsonld_values(resources: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """One row per (document, node, predicate, value); other columns pass through."""
    keep = [c for c in resources.columns if c not in (url, body)]
    doc = F.try_parse_json(F.col(body))
    nodes = F.coalesce(
        F.try_variant_get(doc, '$["@graph"]', "array<variant>"),
        _values(doc),
        F.array(doc),
    )
    n = resources.select(F.col(url).alias("url"), *keep, F.explode(nodes).alias("node"))
    kv = n.select(
        "url", *keep,
        F.try_variant_get("node", '$["@id"]', "string").alias("s"),
        F.explode(F.try_variant_get("node", "$", "map<string,variant>")).alias("key", "vals"),
    ).where(~F.col("key").isin("@id", "@context", "@index"))
    return kv.select(
        "url", *keep, "s", "key",
        F.explode_outer(_values(F.col("vals"))).alias("val"),
    )


# Characters an IRI must not hold in update text, and the prefix of blank nodes (fixed values).
BAD_IRI = r'[\x00-\x20<>"{}|^`\\]|^_:'
LANGUAGE_TAG = "^[A-Za-z]+(-[A-Za-z0-9]+)*$"


def legal_iri(col: Column) -> Column:
    """True for a text that can stand between ``<`` and ``>``; null stays null."""
    return (col != "") & ~col.rlike(BAD_IRI)


def _value_text(key: Column, val: Column) -> Column:
    """The object of a value entry; null when it gives no triple (nothing usable, or an illegal IRI or tag)."""
    as_type = F.try_variant_get(val, "$", "string")
    vid = F.try_variant_get(val, '$["@id"]', "string")
    lang = F.try_variant_get(val, '$["@language"]', "string")
    kind = F.try_variant_get(val, '$["@type"]', "string")
    tags_ok = F.coalesce(lang.rlike(LANGUAGE_TAG), F.lit(True)) & F.coalesce(legal_iri(kind), F.lit(True))
    return (F.when(key == "@type", F.when(legal_iri(as_type), as_type))
            .when(~legal_iri(key), F.lit(None).cast("string"))
            .when(vid.isNotNull(), F.when(legal_iri(vid), vid))
            .when(tags_ok, F.try_variant_get(val, '$["@value"]', "string")))


def _datatype(val: Column) -> Column:
    t = F.schema_of_variant(F.variant_get(val, '$["@value"]', "variant"))
    return F.coalesce(
        F.try_variant_get(val, '$["@type"]', "string"),
        F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(S.XSD_INTEGER))
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit(S.XSD_DOUBLE))
        .when(t == "BOOLEAN", F.lit(S.XSD_BOOLEAN)),
    )


def jsonld_triples(resources: DataFrame, url: str = "url", body: str = "body",
                   keep_rejects: bool = False) -> DataFrame:
    """Expanded JSON-LD -> (url, s, p, o, o_kind, datatype, lang).

    ``@type`` values become rdf:type IRIs; ``{"@id"}`` values IRIs;
    ``{"@value"}`` values literals with optional ``@type`` / ``@language``.
    A property that is not an array, a value with neither ``@id`` nor
    ``@value`` (e.g. ``@list``), a node without ``@id``, a blank node, an IRI
    with characters that update text cannot hold and a malformed language tag
    are rejected (``reject`` column; dropped unless ``keep_rejects``).
    """
    v = jsonld_values(resources, url, body)
    val, key = F.col("val"), F.col("key")
    is_type = key == "@type"
    vid = F.try_variant_get(val, '$["@id"]', "string")
    vvalue = F.try_variant_get(val, '$["@value"]', "string")
    given = F.when(is_type, F.try_variant_get(val, "$", "string")).otherwise(F.coalesce(vid, vvalue))
    o = _value_text(key, val)
    o_kind = F.when(is_type | vid.isNotNull(), F.lit("iri")).when(vvalue.isNotNull(), F.lit("literal"))
    lang = F.when(~is_type & vid.isNull(), F.try_variant_get(val, '$["@language"]', "string"))
    datatype = F.when(~is_type & vid.isNull() & lang.isNull(), _datatype(val))
    reject = (
        F.when(F.col("s").isNull(), F.lit("node_without_id"))
        .when(val.isNull(), F.lit("not_an_array"))
        .when(key.startswith("@") & ~is_type, F.lit("keyword"))
        .when(given.isNull(), F.lit("value_without_id_or_value"))
        .when(~legal_iri(F.col("s")) | o.isNull(), F.lit("illegal_iri_or_tag"))
    )
    keep = [c for c in resources.columns if c not in (url, body)]
    out = v.select(
        "url", *keep, "s",
        F.when(is_type, F.lit(S.RDF_TYPE)).otherwise(key).alias("p"),
        o.alias("o"), o_kind.alias("o_kind"), datatype.alias("datatype"), lang.alias("lang"),
        reject.alias("reject"),
    )
    if keep_rejects:
        return out
    return out.where(F.col("reject").isNull()).drop("reject")


def subject_uri(describes: Column, canonical: Column) -> Column:
    """The subject of an event."""
    return F.coalesce(describes, canonical)


def subject_events(fields: DataFrame, settings: Settings) -> DataFrame:
    """Index / delete events of the triplestore streams: seq, ts, s, kind, url, reason.

    ``reason`` is null when the event can take part in last-writer-wins.
    """
    st = F.col("stream")
    kind = (F.when(st == settings.triples_index_stream, F.lit(INDEX))
            .when(st == settings.triples_delete_stream, F.lit(DELETE)))
    s = subject_uri(F.col("describes_url"), F.col("canonical_url"))
    reason = (
        F.when(F.col("malformed"), F.coalesce(F.col("parse_reason"), F.lit(S.R_MALFORMED)))
        .when(s.isNull(), F.lit(S.R_MISSING_CANONICAL))
        .when(~legal_iri(s), F.lit(S.R_ILLEGAL_SUBJECT))
        .when((kind == INDEX) & F.col("jsonld_url").isNull(), F.lit(S.R_MISSING_JSONLD))
    )
    if not settings.triples_enabled:
        kind = F.lit(None).cast("string")
    return (
        fields.select("seq", "ts", s.alias("s"), kind.alias("kind"),
                      F.col("jsonld_url").alias("url"), reason.alias("reason"))
        .where(F.col("kind").isNotNull())
    )


DOC_OK, DOC_NOT_JSON, DOC_NO_TRIPLES = "ok", "not_json", "no_triples"


def document_status(body: Column) -> Column:
    """``ok`` when the document gives at least one triple, else why it is rejected.

    ``not_json``: null or not parseable; ``no_triples``: JSON without any node
    that has an ``@id`` and a usable value (an error message, a number, an
    empty list).  One expression per document, nothing is exploded.
    """
    doc = F.try_parse_json(body)
    nodes = F.coalesce(F.try_variant_get(doc, '$["@graph"]', "array<variant>"), _values(doc), F.array(doc))

    def gives_triple(key: Column, val: Column) -> Column:
        return ((key == "@type") | ~key.startswith("@")) & _value_text(key, val).isNotNull()

    def node_ok(node: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
        some = F.exists(entries, lambda e: F.coalesce(
            F.exists(_values(e.getField("value")), lambda v: gives_triple(e.getField("key"), v)), F.lit(False)))
        named = legal_iri(F.try_variant_get(node, '$["@id"]', "string"))
        return F.coalesce(named, F.lit(False)) & F.coalesce(some, F.lit(False))

    return (F.when(doc.isNull(), F.lit(DOC_NOT_JSON))
            .when(F.coalesce(F.exists(nodes, node_ok), F.lit(False)), F.lit(DOC_OK))
            .otherwise(F.lit(DOC_NO_TRIPLES)))


def rejected_documents(resources: DataFrame) -> DataFrame:
    """Quarantine of fetched documents that give no triple: url, reason, body."""
    status = document_status(F.col("body"))
    return (resources.select("url", status.alias("reason"), "body")
            .where(F.col("reason") != DOC_OK))


PARSED_DDL = "url string, s string, p string, o string, o_kind string, datatype string, lang string, doc_len int"


def needed_urls(subject_evts: DataFrame) -> DataFrame:
    """The documents that the events can need: one row for each URL of a valid index event."""
    return subject_evts.where(F.col("reason").isNull() & (F.col("kind") == INDEX)).select("url").distinct()


def parsed_documents(resources: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Documents as triples (``PARSED_DDL``): parsed once, to be stored and read by every consumer.

    With ``urls`` only those documents are parsed (a semi-join below the
    parse).  Each document also has one row without a predicate, so one that
    gives no triple is still known to be there.
    """
    docs = resources.select("url", "body")
    if urls is not None:
        docs = docs.join(urls.select("url").distinct(), "url", "left_semi")
    none = [F.lit(None).cast("string").alias(c) for c in TRIPLE_COLS]
    parsed = jsonld_triples(docs.select("url", "body", F.length("body").alias("doc_len")))
    return (parsed.select("url", *TRIPLE_COLS, "doc_len")
            .unionByName(docs.select("url", *none, F.lit(None).cast("int").alias("doc_len"))))


def _is_parsed(documents: DataFrame) -> bool:
    return "body" not in documents.columns


def fetched_documents(documents: DataFrame) -> DataFrame:
    """One row per fetched URL (column ``_have``) with ``_usable``: does any copy give a triple?

    ``documents`` are fetched ones (url, body) or ``parsed_documents``.  The
    index event of a rejected document must not win, or replacing would empty
    the subject.  Only the URL and the flag leave this step, bodies are not
    moved.
    """
    ok = F.col("p").isNotNull() if _is_parsed(documents) else document_status(F.col("body")) == DOC_OK
    return (documents.select(F.col("url").alias("_have"), ok.alias("_ok"))
            .groupBy("_have").agg(F.max("_ok").alias("_usable")))


def _with_documents(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Left join of index events to their documents' flags.

    Other events get a key of their own that matches no URL, so they are spread
    over the shuffle instead of sharing the null key.
    """
    key = F.coalesce(F.when(F.col("kind") == INDEX, F.col("url")), F.concat(F.lit("\n"), F.col("seq").cast("string")))
    return (events.withColumn("_key", key)
            .join(fetched_documents(documents), F.col("_key") == F.col("_have"), "left").drop("_key"))


APPLIED, SUPERSEDED = "applied", "superseded"


def triples_outcomes(subject_evts: DataFrame, resources: DataFrame, winners: DataFrame) -> DataFrame:
    """A6 for the triplestore routes: one outcome per index / delete event.

    Valid events are ``ok``: ``applied`` when the event is its subject's last
    writer, ``superseded`` otherwise (a later event of the same subject
    replaces its effect, as in FIFO consumption).  Missing links are
    ``skipped`` (WARN); a malformed event, an unknown field (strict mode) and
    a missing or rejected document ``failed``.
    """
    ev = _with_documents(subject_evts, resources)
    # two streams may hand out the same seq: an event is known by its kind too
    won = winners.select(F.col("seq").alias("_wseq"), F.col("kind").alias("_wkind"))
    ev = ev.join(won, (F.col("seq") == F.col("_wseq")) & (F.col("kind") == F.col("_wkind")), "left").drop("_wkind")
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when((F.col("kind") == INDEX) & F.col("_have").isNull(), F.lit(S.R_RESOURCE_MISSING))
              .when((F.col("kind") == INDEX) & ~F.col("_usable"), F.lit(S.R_DOCUMENT_REJECTED))
              .when(F.col("_wseq").isNotNull(), F.lit(APPLIED))
              .otherwise(F.lit(SUPERSEDED)))
    outcome = (F.when(reason.isin(APPLIED, SUPERSEDED), F.lit("ok"))
               .when(reason.isin(S.R_MALFORMED, S.R_UNKNOWN_FIELD, S.R_RESOURCE_MISSING, S.R_DOCUMENT_REJECTED,
                                 S.R_ILLEGAL_SUBJECT), F.lit("failed"))
               .otherwise(F.lit("skipped")))
    level = (F.when(outcome == "ok", F.lit("DEBUG")).when(outcome == "failed", F.lit("ERROR"))
             .otherwise(F.lit("WARN")))
    route = F.when(F.col("kind") == INDEX, F.lit(S.TRIPLES_INDEX)).otherwise(F.lit(S.TRIPLES_DELETE))
    return ev.select(
        "seq", "ts",
        F.concat(F.col("seq").cast("string"), F.lit(":"), route).alias("request_id"),
        route.alias("route"), outcome.alias("outcome"), reason.alias("reason"), level.alias("level"),
        F.lit(0).cast("bigint").alias("attempts"),
    )


def eligible(subject_evts: DataFrame, resources: DataFrame) -> DataFrame:
    """Events that may win: valid, and (for index) with a fetched document that gives triples (D3).

    One pass over the events: a left join to the fetched URLs (one row each,
    so the join cannot multiply events), then a filter.
    """
    j = _with_documents(subject_evts.where(F.col("reason").isNull()), resources)
    return j.where((F.col("kind") == DELETE) | F.col("_usable")).drop("_have", "_usable", "reason")


def latest_per_subject(candidates: DataFrame) -> DataFrame:
    """E5: the last writer per subject (max seq across index and delete; at equal seq, as two
    streams may have, the later ts, then the index event)."""
    w = F.max_by(F.struct("seq", "ts", "kind", "url"), F.struct("seq", "ts", "kind", "url"))
    return (candidates.groupBy("s").agg(w.alias("w"))
            .select("s", F.col("w.seq").alias("seq"), F.col("w.ts").alias("ts"), F.col("w.kind").alias("kind"),
                    F.col("w.url").alias("url")))


def candidates(subject_evts: DataFrame) -> DataFrame:
    """The valid events that can win, reduced: of those with one subject, kind and document only the last.

    Same columns as the events, so that many rows, not all events, meet the documents' flags.
    """
    url = F.when(F.col("kind") == INDEX, F.col("url"))
    last = F.max(F.struct("seq", "ts")).alias("w")
    return (subject_evts.where(F.col("reason").isNull()).groupBy("s", "kind", url.alias("url")).agg(last)
            .select("w.seq", "w.ts", "s", "kind", "url", F.lit(None).cast("string").alias("reason")))


def last_writers(subject_evts: DataFrame, documents: DataFrame) -> DataFrame:
    """``latest_per_subject`` of the ``eligible`` events, which are reduced before they are joined."""
    return latest_per_subject(eligible(candidates(subject_evts), documents))


NO_EVENT = "none"


def transitions(subject_evts: DataFrame) -> DataFrame:
    """Each valid event with the one before it on its subject, by seq (at equal seq: ts, then delete before index).

    Adds ``before`` (kind of the event before, ``none`` for a subject's first)
    and ``change``: ``created`` (index, none before or after a delete),
    ``updated`` (index after index), ``deleted`` (delete after index) or
    ``absent`` (delete of what is not there).  A subject of any number of
    events is cut into segments (``operators.ordered``).
    """
    order = [F.col("seq"), F.col("ts"), F.col("kind")]
    seg = segmented(subject_evts.where(F.col("reason").isNull()).select("seq", "ts", "s", "kind"), ["s"], order, "transitions")
    j = lagged(seg, ["s"], order, {"kind": "before"})
    was = F.coalesce(F.col("before") == INDEX, F.lit(False))
    change = (F.when(F.col("kind") == INDEX, F.when(was, F.lit("updated")).otherwise(F.lit("created")))
              .when(was, F.lit("deleted")).otherwise(F.lit("absent")))
    return j.select("seq", "ts", "s", "kind", F.coalesce("before", F.lit(NO_EVENT)).alias("before"), change.alias("change"))


def _winner_keys(winners: DataFrame) -> DataFrame:
    # Every consumer reads the same projection of the winners, so the
    # optimizer sees one plan and the shuffle behind it is reused.
    return winners.select(F.col("s").alias("w_s"), F.col("seq").alias("w_seq"),
                          F.col("kind").alias("w_kind"), F.col("url").alias("w_url"))


def _winner_rows(winners: DataFrame, documents: DataFrame) -> DataFrame:
    w = _winner_keys(winners).where(F.col("w_kind") == INDEX)
    more = [F.col("w_seq").alias("seq"), F.col("w_s").alias("subject")]
    docs = documents.join(w, F.col("url") == F.col("w_url"), "inner")
    if _is_parsed(documents):
        return docs.where(F.col("p").isNotNull()).select("url", *more, "doc_len", *TRIPLE_COLS)
    return jsonld_triples(docs.select("url", "body", *more, F.length("body").alias("doc_len")))


def winner_documents(winners: DataFrame, documents: DataFrame) -> DataFrame:
    """Triples of the documents of index winners (fetched ones are parsed, only those of winners).

    Columns: seq, subject (the winner's subject), doc_len (document length)
    and the triple columns.
    """
    t = _winner_rows(winners, documents)
    # a graph is a set: a value listed twice, or a document fetched twice, is one triple
    return (t.groupBy("seq", "subject", *TRIPLE_COLS).agg(F.max("doc_len").alias("doc_len"))
            .select("seq", "subject", "doc_len", *TRIPLE_COLS))


def winner_triples(winners: DataFrame, documents: DataFrame) -> DataFrame:
    """The triples that the winners' documents give, each once, with ``foreign``: does some document
    have it about a node that is not its subject?"""
    return (_winner_rows(winners, documents).groupBy(*TRIPLE_COLS)
            .agg(F.max(F.col("s") != F.col("subject")).alias("foreign")))


def _triple_key() -> Column:
    """A key without nulls that equal triples share."""
    return F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c) for c in TRIPLE_COLS if c != "s"])


def apply_changes(prior: DataFrame, winners: DataFrame, documents: DataFrame) -> DataFrame:
    """E2 + E3: the triples table after the batch, a set of triples (``documents``: fetched or parsed)."""
    return replace_subjects(prior, winners, winner_triples(winners, documents))


def replace_subjects(prior: DataFrame, winners: DataFrame, new: DataFrame) -> DataFrame:
    """``prior`` without the winners' subjects, and the ``winner_triples``.

    A document may describe nodes besides its subject, and several documents
    the same node: equal triples count once, and those of such other nodes
    that are stored already are not added again.  Only the stored rows of
    these nodes are looked at, and only these triples are compared.
    """
    w = _winner_keys(winners)
    kept = prior.select(*TRIPLE_COLS).join(w, F.col("s") == F.col("w_s"), "left_anti")
    own, other = new.where(~F.col("foreign")), new.where("foreign").drop("foreign")
    stored = (kept.join(other.select("s").distinct(), "s", "left_semi")
              .select(F.col("s").alias("_s"), _triple_key().alias("_key")))
    added = other.join(stored, (F.col("s") == F.col("_s")) & (_triple_key() == F.col("_key")), "left_anti")
    return kept.unionByName(own.select(*TRIPLE_COLS)).unionByName(added.select(*TRIPLE_COLS))


def changeset(prior: DataFrame, winners: DataFrame, resources: DataFrame) -> DataFrame:
    """Delete rows (everything known about each changed subject) + insert rows."""
    w = _winner_keys(winners)
    dels = (prior.select(*TRIPLE_COLS).join(w, F.col("s") == F.col("w_s"), "inner")
            .select(F.lit("delete").alias("op"), F.col("w_seq").alias("seq"), *TRIPLE_COLS))
    ins = winner_documents(winners, resources).select(F.lit("insert").alias("op"), "seq", *TRIPLE_COLS)
    return dels.unionByName(ins)


# A triple takes at least this many characters of its document (an ``@type``
# entry is ``"x",``), so a document of L characters holds at most
# L / MIN_VALUE_CHARS triples.
MIN_VALUE_CHARS = 4


def render_update(winners: DataFrame, resources: DataFrame, chunk: int = RENDER_CHUNK) -> DataFrame:
    """The update texts of each subject, to be sent in the order of ``step``.

    Every subject has the same layout: step 0 deletes what is known about it,
    steps 1, 2, ... insert the document's triples.  The triples are dealt to
    the insert steps by a hash of their line; the number of steps comes from
    the document's length (at most ``length / MIN_VALUE_CHARS`` triples), so a
    step holds about ``chunk`` triples and no group grows without bound, with
    one pass over the documents.  Columns: s, step, update_text.
    """
    docs = winner_documents(winners, resources)
    parts = F.greatest(F.lit(1), F.ceil(F.col("doc_len") / F.lit(MIN_VALUE_CHARS * chunk))).cast("bigint")
    lines = docs.select(
        F.col("subject").alias("s"),
        ntriple(F.col("s"), F.col("p"), F.col("o"), F.col("o_kind"), F.col("datatype"), F.col("lang"))
        .alias("line"),
        parts.alias("parts"),
    )
    inserts = (
        lines.groupBy("s", (F.pmod(F.xxhash64("line"), F.col("parts")) + 1).alias("step"))
        .agg(F.array_join(F.array_sort(F.collect_list("line")), " ").alias("body"))
        .select("s", "step", F.concat(F.lit("INSERT DATA { "), F.col("body"), F.lit(" }")).alias("update_text"))
    )
    deletes = _winner_keys(winners).select(
        F.col("w_s").alias("s"), F.lit(0).cast("bigint").alias("step"),
        F.concat(F.lit("DELETE WHERE { <"), F.col("w_s"), F.lit("> ?p ?o }")).alias("update_text"))
    return deletes.unionByName(inserts)


SPARQL_UPDATE = "application/sparql-update"


def triples_requests(winners: DataFrame, resources: DataFrame, settings: Settings,
                     chunk: int = RENDER_CHUNK) -> DataFrame:
    """One POST of update text to the triplestore endpoint per step.

    Columns: request_id (seq:route:step), seq, step, ts, route, method, uri,
    content_type, body.  A sender delivers a subject's steps in order: an
    insert sent before step 0 would be deleted by it.  The endpoint gets the
    HTTP options suffix like every other endpoint.
    """
    from relaysync.functions.http_options import add_http_options

    uri = add_http_options(settings.triples_base_url, settings.http_options)
    w = winners.select("s", "seq", "ts", "kind")
    steps = render_update(winners, resources, chunk).join(w, "s")
    route = F.when(F.col("kind") == INDEX, F.lit(S.TRIPLES_INDEX)).otherwise(F.lit(S.TRIPLES_DELETE))
    return steps.select(
        F.concat_ws(":", F.col("seq").cast("string"), route, F.col("step").cast("string")).alias("request_id"),
        "seq", "step", "ts", route.alias("route"), F.lit("POST").alias("method"), F.lit(uri).alias("uri"),
        F.lit(SPARQL_UPDATE).alias("content_type"), F.col("update_text").alias("body"),
    )
