"""End-to-end jobs: what a deployment runs (batch and continuous).

``sync_batch`` parses the landed events once into a narrow prepared table
(derived columns only, no event struct), then writes every output from it:
requests, outcomes of events stopped before dispatch, derivative requests,
resolved outcomes (when delivery attempts are given) and the triples table
after last-writer-wins.

``sync_stream`` runs the indexer and derivative routes continuously and
``plans.triplestore.sync_triplestore`` the triplestore's; ``sync_attempts``
takes the recorded delivery attempts as a stream and ``resolved_outcomes`` reads
them all.  Their outputs are logs of committed batches (``streaming.batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync.operators import dedup as D
from relaysync.operators import derivatives, outcomes, triples
from relaysync.operators import requests as R
from relaysync.plans import triplestore
from relaysync.plans.prepare import Transform, prepared
from relaysync.schema import TRIPLES_DDL
from relaysync.session import materialize, stage_table
from relaysync.settings import Settings
from relaysync.sources import sinks
from relaysync.streaming.batches import EVERY, BatchLog, log_writer
from relaysync.streaming.pipeline import idempotent_writer, read_sink, state_partitions

def sync_batch(spark: SparkSession, raw: DataFrame, settings: Settings, out: str,
               resources: DataFrame | None = None, prior_triples: DataFrame | None = None,
               attempts: DataFrame | None = None, registry: DataFrame | None = None,
               strict: bool = False, dedup: bool = False, transform: Transform | None = None) -> dict[str, str]:
    """Run every batch output over ``raw``; returns the written paths.

    ``dedup`` removes re-delivered messages first; ``transform`` is applied to
    the parsed events.  With ``resources`` and no ``prior_triples`` the
    triples table starts empty (first run).

    The parsed events are written once as a parquet table partitioned by
    ``stream`` (``events``) and every other output reads that table, so each
    body is parsed exactly once and each route reads only its partitions.
    Every output overwrites its folder under ``out``, so re-running the same
    job (after a failure) replaces its results instead of adding to them.
    """
    paths: dict[str, str] = {"events": f"{out}/events"}
    if dedup:
        raw = D.dedup_messages(raw, settings).drop("message_id")
    prepared(raw, strict, transform).write.mode("overwrite").partitionBy("stream").parquet(paths["events"])
    f = spark.read.parquet(paths["events"])
    # each consumer filters on its own streams: partition pruning on `stream`
    f_idx = f.where(F.col("stream").isin(*R.indexer_streams(settings)))
    f_tri = f.where(F.col("stream").isin(settings.triples_index_stream, settings.triples_delete_stream))

    req = R.build_requests(f_idx, settings)
    paths["requests"] = f"{out}/requests"
    sinks.write_requests(req, paths["requests"], mode="overwrite")

    stopped = R.event_outcomes(f_idx, settings).select(*outcomes.OUTCOME_COLUMNS)
    sent_cols = ["seq", "ts", "request_id", "route"]
    sent_paths = [paths["requests"]]
    if registry is not None:
        f_der = derivatives.routed(f, registry)
        stopped = stopped.unionByName(derivatives.derivative_outcomes(f_der, registry)
                                      .select(*outcomes.OUTCOME_COLUMNS))
        paths["derivative_requests"] = f"{out}/derivative_requests"
        derivatives.derivative_requests(f_der, registry, settings).write.mode("overwrite").parquet(
            paths["derivative_requests"])
        sent_paths.append(paths["derivative_requests"])

    if resources is not None:
        if prior_triples is None:
            prior_triples = spark.createDataFrame([], TRIPLES_DDL)
        sev = stage_table(triples.subject_events(f_tri, settings), "subject_events")
        docs = stage_table(triples.parsed_documents(resources, triples.needed_urls(sev)), "parsed_documents")
        w = stage_table(triples.last_writers(sev, docs), "winners")
        paths["triples"] = f"{out}/triples"
        sinks.write_triples(triples.apply_changes(prior_triples, w, docs), paths["triples"])
        paths["triples_requests"] = f"{out}/triples_requests"
        triples.triples_requests(w, docs, settings).write.mode("overwrite").parquet(paths["triples_requests"])
        sent_paths.append(paths["triples_requests"])
        stopped = stopped.unionByName(triples.triples_outcomes(sev, docs, w)
                                      .where(F.col("reason") != triples.APPLIED).select(*outcomes.OUTCOME_COLUMNS))

    if attempts is not None:
        # every request that was written (indexer, derivative, triplestore) is resolved the same way
        sent = None
        for path in sent_paths:
            part = spark.read.parquet(path).select(*sent_cols)
            sent = part if sent is None else sent.unionByName(part)
        stopped = stopped.unionByName(outcomes.redelivery_outcomes(sent, attempts, settings)
                                      .select(*outcomes.OUTCOME_COLUMNS))
    paths["outcomes"] = f"{out}/outcomes"
    sinks.write_outcomes(stopped, paths["outcomes"], mode="overwrite")
    return paths


_STATS_DDL = "request_id string, n int, " + ", ".join(f"{c} bigint" for c in outcomes.STATS_COLUMNS[1:])
_OUTCOMES_DDL = ("seq bigint, ts timestamp, request_id string, route string, outcome string, reason string, level string, "
                 "attempts bigint")
_SENT_DDL = "seq bigint, ts timestamp, request_id string, route string"


def sync_stream(raw_stream: DataFrame, settings: Settings, out: str, checkpoint: str,
                trigger: dict | None = None, registry: DataFrame | None = None, strict: bool = False,
                dedup: bool = False, transform: Transform | None = None, every: int = EVERY):
    """Continuous run of the indexer and derivative routes: requests and stopped-event outcomes per
    micro-batch, derivative requests when a registry is given (``sync_triplestore`` runs the triplestore's).

    ``dedup`` drops copies of messages seen in any earlier batch
    (``dedup_stream``); ``strict`` and ``transform`` as in ``sync_batch``.
    Returns the started query.  The outputs of a batch are committed together
    (``streaming.batches``); read them with ``written``.
    """
    log = BatchLog(raw_stream.sparkSession, f"{out}/sync", every=every)
    if dedup:
        raw_stream = D.dedup_stream(raw_stream, settings).drop("message_id")
    if registry is not None:
        registry = materialize(registry)  # a few rows, read by every batch

    def write(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):
            return
        # several outputs per batch: parse once, keep it for the other writes
        f = derivatives.content_only(prepared(batch, strict, transform)).persist()
        try:
            with log.batch(batch_id) as put:
                put("requests", R.build_requests(f, settings))
                stopped = R.event_outcomes(f, settings).select(*outcomes.OUTCOME_COLUMNS)
                if registry is not None:
                    mine = derivatives.routed(f, registry)
                    put("derivative_requests", derivatives.derivative_requests(mine, registry, settings))
                    stopped = stopped.unionByName(derivatives.derivative_outcomes(mine, registry)
                                                  .select(*outcomes.OUTCOME_COLUMNS))
                put("outcomes", stopped)
        finally:
            f.unpersist()

    w = (raw_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})))
    return w.start()


def _attempt_log(spark: SparkSession, out: str, every: int) -> BatchLog:
    return BatchLog(spark, f"{out}/attempts", {"attempt_stats": lambda rows, last: outcomes.merge_stats(rows)}, every)


def sync_attempts(attempts_stream: DataFrame, settings: Settings, out: str, checkpoint: str,
                  trigger: dict | None = None, every: int = EVERY):
    """Continuous redelivery resolution (E1): each micro-batch of attempts is reduced to one row of
    statistics per request and logged.

    The statistics are minima and maxima, so rows of the same request from
    several batches merge in any order: no state is held in the query and no
    attempt is lost for being late.  Returns the started query.
    """
    log = _attempt_log(attempts_stream.sparkSession, out, every)
    w = (attempts_stream.writeStream.foreachBatch(
        lambda batch, batch_id: log_writer(log, "attempt_stats")(outcomes.attempt_stats(batch, settings), batch_id))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))
    return w.start()


def sync_final(sent: DataFrame, settings: Settings, out: str, checkpoint: str, horizon: str = "1 day",
               trigger: dict | None = None, every: int = EVERY) -> list:
    """Final outcomes (E1): starts two queries over ``sent`` (see ``outcomes.final_stats``), the final
    statistics into ``{out}/final`` and those of every attempt, late ones too, into ``{out}/attempts``."""
    log = BatchLog(sent.sparkSession, f"{out}/final", every=every)
    final = (outcomes.final_stats(sent, settings, horizon).drop("ts").writeStream.outputMode("append")
             .foreachBatch(log_writer(log, "final_stats")).option("checkpointLocation", f"{checkpoint}/final")
             .trigger(**(trigger or {"availableNow": True})).start())
    attempts = sent.select("request_id", "attempt_no", "status").where(F.col("attempt_no").isNotNull())
    return [final, sync_attempts(attempts, settings, out, f"{checkpoint}/attempts", trigger, every)]


def final_outcomes(spark: SparkSession, requests: DataFrame, settings: Settings, out: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes of the requests that ``sync_final`` has closed, corrections of them by attempts that came later)."""
    closed = outcomes.merge_stats(BatchLog(spark, f"{out}/final").read("final_stats", _STATS_DDL))
    logged = outcomes.merge_stats(_attempt_log(spark, out, EVERY).read("attempt_stats", _STATS_DDL))
    mine = requests.join(closed.select("request_id"), "request_id", "left_semi")
    final = outcomes.resolve(mine, closed, settings)
    return final, outcomes.corrections(final, outcomes.resolve(mine, logged, settings))


def sync_responses(requests: DataFrame, attempts: DataFrame, out: str, checkpoint: str, delay: str = "1 hour",
                   horizon: str = "1 day", trigger: dict | None = None, partitions: int | None = None) -> list:
    """Continuous response join (D4): starts two queries, the join (``outcomes.response_stream``) into
    ``{out}/responses`` and the attempts as they came into ``{out}/attempt_log``.

    ``partitions`` of the join's state (as many as the session shuffles to, if not given) stay as long as its
    checkpoint; each of them costs four state stores in every trigger, however few its rows.
    """
    def run(stream: DataFrame, name: str):
        return (stream.writeStream.outputMode("append").foreachBatch(idempotent_writer(f"{out}/{name}"))
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).start())

    with state_partitions(requests.sparkSession, partitions):
        join = run(outcomes.response_stream(requests, attempts, delay, horizon), "responses")
    return [join, run(attempts, "attempt_log")]


def late_responses(spark: SparkSession, out: str) -> DataFrame:
    """The attempts of ``sync_responses`` that came too late for the join, or belong to no known request."""
    logged = read_sink(spark, f"{out}/attempt_log").drop("batch_id").where(F.col("request_id").isNotNull())
    return outcomes.late_attempts(logged, read_sink(spark, f"{out}/responses"))


def resolved_outcomes(spark: SparkSession, settings: Settings, out: str) -> DataFrame:
    """All outcomes of a continuous run: events that stopped, index events that wait for their document
    (pending), and every request written so far resolved against the attempts logged so far."""
    sync, store = BatchLog(spark, f"{out}/sync"), BatchLog(spark, f"{out}/triplestore")
    sent, stopped = spark.createDataFrame([], _SENT_DDL), triplestore.waiting_outcomes(spark, out)
    for log, names in ((sync, ("requests", "derivative_requests")), (store, ("triples_requests",))):
        for name in names:
            part = log.read(name)
            if part is not None:
                sent = sent.unionByName(part.select("seq", "ts", "request_id", "route"))
        stopped = stopped.unionByName(log.read("outcomes", _OUTCOMES_DDL))
    stats = outcomes.merge_stats(_attempt_log(spark, out, EVERY).read("attempt_stats", _STATS_DDL))
    return outcomes.all_outcomes(stopped, outcomes.resolve(sent, stats, settings))


def written(spark: SparkSession, out: str, name: str) -> DataFrame:
    """An output of ``sync_stream`` or ``sync_triplestore``, committed batches only."""
    job = "triplestore" if name == "triples_requests" else "sync"
    rows = BatchLog(spark, f"{out}/{job}").read(name)
    if rows is None:
        raise ValueError(f"no committed batch of {out} has the output {name}")
    return rows


__all__ = ["final_outcomes", "late_responses", "prepared", "resolved_outcomes", "sync_attempts", "sync_batch", "sync_final",
           "sync_responses", "sync_stream", "written"]
