"""Continuous run of the triplestore routes with the triples table kept beside it.

Two streams feed one query: events, and the documents as they are fetched.  A
micro-batch

1. parses its documents, each once, and adds their triples to the ``documents``
   table (buckets by URL; a later copy of a URL takes the place of an earlier);
2. looks up the documents of its index events in the buckets these fall into.
   An event whose document is not there yet waits; the waiting ones are joined
   only to the documents that came with this batch, and one that has waited
   for ``tries`` batches fails (``resource_missing``);
3. reduces new and released events to the last writer of each subject, and
   leaves out those whose subject an earlier batch took further (``winners``,
   buckets by subject): an event released late never undoes a newer one;
4. replaces the winners' subjects in the ``triples`` table, of which only the
   buckets that change are read and written;
5. commits its requests, outcomes and waiting events together.

Each table and the log know the last batch they hold, so a batch that is
replayed after a failure completes what was missing and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaysync import schema as S
from relaysync.operators import outcomes, triples
from relaysync.plans.prepare import Transform, prepared
from relaysync.session import stage_table
from relaysync.settings import Settings
from relaysync.streaming.batches import EVERY, BatchLog
from relaysync.streaming.buckets import BucketTable

WAITING_DDL = "seq bigint, ts timestamp, s string, kind string, url string, tried int, at bigint"
_WINNERS_DDL = "s string, seq bigint, ts timestamp, kind string, url string"
_DOCUMENTS_DDL = triples.PARSED_DDL + ", arrived bigint"
_RAW = ["seq", "ts", "stream", "headers", "body"]


def _log(spark: SparkSession, out: str, every: int = EVERY) -> BatchLog:
    # a snapshot of the waiting events stands in every batch: only the last is kept
    return BatchLog(spark, f"{out}/triplestore", {"waiting": lambda rows, last: rows.where(F.col("at") == last)}, every)


def _both(events: DataFrame, documents: DataFrame, streams: list[str]) -> DataFrame:
    """One stream of documents and of the events of some streams, told apart by ``what``.

    No filter on a batch goes below the batch: other streams' events are left out before.
    """
    null = F.lit(None).cast("string")
    ev = events.where(F.col("stream").isin(*streams)).select(F.lit("event").alias("what"), *_RAW, null.alias("url"))
    docs = documents.select(F.lit("document").alias("what"), F.lit(None).cast("bigint").alias("seq"),
                            F.lit(None).cast("timestamp").alias("ts"), null.alias("stream"),
                            F.lit(None).cast("map<string,string>").alias("headers"), "body", "url")
    return ev.unionByName(docs)


def _latest_copies(documents: DataFrame) -> DataFrame:
    """The rows of each URL's last arrival."""
    last = documents.groupBy("url").agg(F.max("arrived").alias("arrived"))
    return documents.join(last, ["url", "arrived"], "left_semi").select(*documents.columns)


def _of(table: BucketTable, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a table that have one of the keys; only the keys' buckets are read."""
    return table.read(table.touched(keys)).join(keys, key, "left_semi")


def sync_triplestore(raw_stream: DataFrame, documents: DataFrame, settings: Settings, out: str, checkpoint: str,
                     prior: DataFrame | None = None, buckets: int = 256, tries: int = 5, trigger: dict | None = None,
                     strict: bool = False, transform: Transform | None = None, every: int = EVERY):
    """Start the run; returns the query.

    ``documents`` is a stream of fetched documents (url, body); ``prior`` the
    triples stored before the first batch.  ``buckets`` is fixed when the
    tables are made: a bucket should stay small enough to be rewritten often.
    Read the results with ``triples_table``, ``jobs.written`` and
    ``jobs.resolved_outcomes``.
    """
    spark = raw_stream.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    store = BucketTable.create(empty(S.TRIPLES_DDL) if prior is None else prior.select(*triples.TRIPLE_COLS), f"{out}/triples", "s", buckets)
    fetched = BucketTable.create(empty(_DOCUMENTS_DDL), f"{out}/documents", "url", buckets)
    writers = BucketTable.create(empty(_WINNERS_DDL), f"{out}/winners", "s", buckets)
    log = _log(spark, out, every)
    streams = [settings.triples_index_stream, settings.triples_delete_stream]

    def write(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):
            return
        # a micro-batch has a session of its own without adaptive execution: from here on the job's is used
        rows = batch.persist()  # read twice, and each read of a batch makes all of it anew
        try:
            came = stage_table(triples.parsed_documents(rows.where("what = 'document'").select("url", "body").distinct()), "came", spark)
            events = rows.where("what = 'event'").select(*_RAW)
            sev = stage_table(triples.subject_events(prepared(events, strict, transform), settings), "subject_events", spark)
        finally:
            rows.unpersist()
        fetched.append(came.withColumn("arrived", F.lit(batch_id).cast("bigint")), batch_id, _latest_copies)
        before = log.read("waiting", WAITING_DDL, batch_id, batch_id - 1).where(F.col("at") == batch_id - 1)
        came_urls = came.select("url").distinct()
        released = before.join(came_urls, "url", "left_semi").select(
            "seq", "ts", "s", "kind", "url", F.lit(None).cast("string").alias("reason"))
        open_events = sev.unionByName(released)
        # what the batch's events need of the documents, read once; a released event's document came with this batch
        needed = triples.needed_urls(open_events)
        known = stage_table(_latest_copies(_of(fetched, needed, "url")).drop("arrived"), "needed")
        subjects = open_events.where(F.col("reason").isNull()).select("s").distinct()
        held = triples.latest_per_subject(_of(writers, subjects, "s")).select(
            F.col("s").alias("_s"), F.struct("seq", "ts", "kind").alias("_held"))
        mine = triples.last_writers(open_events, known)
        w = stage_table(mine.join(held, F.col("s") == F.col("_s"), "left")
                        .where(F.col("_held").isNull() | (F.struct("seq", "ts", "kind") >= F.col("_held")))
                        .select(*mine.columns), "winners")
        new = stage_table(triples.winner_triples(w, known), "winner_triples")
        changed = store.touched(w.select("s"), new.select("s"))
        store.replace(triples.replace_subjects(store.read(changed), w, new), changed, batch_id)
        writers.append(w.select("s", "seq", "ts", "kind", "url"), batch_id, triples.latest_per_subject)

        fresh = (sev.where((F.col("kind") == triples.INDEX) & F.col("reason").isNull())
                 .join(known.select("url").distinct(), "url", "left_anti").select("seq", "ts", "s", "kind", "url", F.lit(0).alias("tried")))
        again = before.join(came_urls, "url", "left_anti").withColumn("tried", F.col("tried") + 1)
        waiting = fresh.unionByName(again.select(*fresh.columns))
        given_up = _as_outcomes(waiting.where(F.col("tried") >= tries), "failed", "ERROR")
        results = triples.triples_outcomes(open_events, known, w).where(~F.col("reason").isin(triples.APPLIED, S.R_RESOURCE_MISSING))
        with log.batch(batch_id) as put:
            put("triples_requests", triples.triples_requests(w, known, settings))
            put("outcomes", results.select(*outcomes.OUTCOME_COLUMNS).unionByName(given_up))
            put("waiting", waiting.where(F.col("tried") < tries).withColumn("at", F.lit(batch_id).cast("bigint")))

    q = (_both(raw_stream, documents, streams).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})))
    return q.start()


def _as_outcomes(waiting: DataFrame, outcome: str, level: str | None) -> DataFrame:
    route = F.lit(S.TRIPLES_INDEX)
    return waiting.select(
        "seq", "ts", F.concat(F.col("seq").cast("string"), F.lit(":"), route).alias("request_id"), route.alias("route"),
        F.lit(outcome).alias("outcome"), F.lit(S.R_RESOURCE_MISSING).alias("reason"), F.lit(level).cast("string").alias("level"),
        F.lit(0).cast("bigint").alias("attempts"))


def waiting_events(spark: SparkSession, out: str) -> DataFrame:
    """Index events that wait for their document after the last committed batch."""
    log = _log(spark, out)
    return log.read("waiting", WAITING_DDL, since=log.last()).where(F.col("at") == log.last()).drop("at")


def waiting_outcomes(spark: SparkSession, out: str) -> DataFrame:
    return _as_outcomes(waiting_events(spark, out), "pending", None)


def triples_table(spark: SparkSession, out: str) -> DataFrame:
    """The triples after the last applied batch."""
    return BucketTable(spark, f"{out}/triples").read()


def last_writers_of(spark: SparkSession, out: str) -> DataFrame:
    """The last applied event of each subject."""
    return triples.latest_per_subject(BucketTable(spark, f"{out}/winners").read())
