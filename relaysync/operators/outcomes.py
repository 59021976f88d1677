"""Delivery outcomes.

Redelivery resolution is split in two so it scales and streams:

1. ``attempt_stats`` aggregates the attempts of each request WITHOUT looking
   at the request (route-independent facts: first 2xx attempt, first attempt
   of each skippable status, count, last attempt).  Attempts past 1+N are dropped before
   the shuffle, so a request contributes at most N+1 rows and the partial
   (map-side) aggregate collapses them; the same aggregation runs unchanged
   on a stream in update mode.
2. ``resolve`` joins one stats row per request to the request (equi-join on
   request_id; the stats side is already hash-partitioned on request_id, so
   only the requests side is exchanged) and applies the route-scoped policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync import schema as S
from relaysync.settings import Settings

OUTCOME_COLUMNS = ["seq", "ts", "request_id", "route", "outcome", "reason", "level", "attempts"]


def is_success(status: Column) -> Column:
    return (status >= 200) & (status <= 299)


def _skips(status: Column, route: Column) -> Column:
    """True when the status ends the request on this route (schema.STATUS_SKIPS); never null."""
    hit = F.lit(False)
    for code, (routes, _) in S.STATUS_SKIPS.items():
        hit = hit | ((status == code) & route.isin(*routes))
    return F.coalesce(hit, F.lit(False))


def status_class(status: Column, route: Column) -> Column:
    """Per-attempt class (C2, C5): ok / skip / retry (a null status, no answer, is retried)."""
    return (
        F.when(is_success(status), F.lit("ok"))
        .when(_skips(status, route), F.lit("skip"))
        .otherwise(F.lit("retry"))
    )


def response_classes(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every recorded attempt with its class (D4 join + C2/C5)."""
    j = attempts.join(requests.select("request_id", "route"), "request_id", "inner")
    return j.select("request_id", "route", "attempt_no", "status",
                    status_class(F.col("status"), F.col("route")).alias("class"))


PENDING = "pending"


def response_stream(requests: DataFrame, attempts: DataFrame, delay: str = "1 hour", horizon: str = "1 day") -> DataFrame:
    """D4 on two streams: every attempt with its class, and one ``pending`` row for a request without any.

    ``requests`` (request_id, route, ts) and ``attempts`` (request_id,
    attempt_no, status, at).  An attempt belongs to a request sent at most
    ``horizon`` before it; either stream may be late by ``delay``.  Both bounds
    let the join drop its state: a request is held until the watermark has
    passed its horizon, and is then ``pending`` (attempt_no and status null)
    if nothing came.  Attempts later than that are in the attempts' own log
    (``late_attempts``).
    """
    r = requests.select("request_id", "route", "ts").withWatermark("ts", delay)
    a = (attempts.select(F.col("request_id").alias("_id"), "attempt_no", "status", "at").withWatermark("at", delay))
    j = r.join(a, F.expr(f"request_id = _id AND at >= ts AND at <= ts + INTERVAL {horizon}"), "leftOuter")
    cls = F.when(F.col("_id").isNull(), F.lit(PENDING)).otherwise(status_class(F.col("status"), F.col("route")))
    return j.select("request_id", "route", "attempt_no", "status", cls.alias("class"))


def late_attempts(attempts: DataFrame, responses: DataFrame) -> DataFrame:
    """Logged attempts that the join did not take: too late, or of no known request."""
    return attempts.join(responses.select("request_id", "attempt_no"), ["request_id", "attempt_no"], "left_anti")


# (attempt_no, status) packed into one long, attempt first, so min/max order
# by attempt; keeps every aggregation buffer fixed-width (hash aggregate,
# small streaming state).  The low 32 bits hold status + 1, or 0 for an
# attempt without an answer (null or negative status), so no code is altered.
PACK = 1 << 32
SKIP_STATS = {code: f"first_{code}_p" for code in S.STATUS_SKIPS}
STATS_COLUMNS = ["n", "first_ok_p", *SKIP_STATS.values(), "last_p"]


def _pack(a: Column, st: Column) -> Column:
    code = F.when(st >= 0, st.cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return a.cast("long") * F.lit(PACK) + code


def _attempt(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def _status(packed: Column) -> Column:
    """The packed status; null where the attempt had no answer."""
    code = packed.bitwiseAND(F.lit(PACK - 1))
    return F.when(code > 0, (code - 1).cast("int"))


def attempt_stats(attempts: DataFrame, settings: Settings) -> DataFrame:
    """Route-independent per-request aggregate of attempts 1..N+1.

    Columns: request_id and ``STATS_COLUMNS`` (packed: first success, first
    answer of each status that some route skips, last attempt).
    ``n`` is the highest attempt number seen (deliveries made): a delivery
    logged twice, or a missing log line, does not change it.
    """
    return _stats(attempts.where(_in_range(settings)).groupBy("request_id"))


def _in_range(settings: Settings) -> Column:
    a = F.col("attempt_no")
    if settings.attempt_limit is None:
        return a >= 1
    return (a >= 1) & (a <= settings.attempt_limit)


def _stats(grouped) -> DataFrame:
    a, st = F.col("attempt_no"), F.col("status")
    packed = _pack(a, st)
    return grouped.agg(
        F.max(a).alias("n"),
        F.min(F.when(is_success(st), packed)).alias("first_ok_p"),
        *[F.min(F.when(st == code, packed)).alias(name) for code, name in SKIP_STATS.items()],
        F.max(packed).alias("last_p"),
    )


def final_stats(sent: DataFrame, settings: Settings, horizon: str = "1 day") -> DataFrame:
    """E1 in append mode: the statistics of a request, once, when no attempt is awaited any more.

    ``sent`` (request_id, ts, attempt_no, status) is a stream of requests
    (attempt_no null) and of their attempts, both with the time the request
    was sent.  A request is final when the watermark, ``horizon`` behind the
    latest request, has passed that time; its state is then dropped.  Attempts
    that come later do not change a final row: they are in the attempts' own
    log (``corrections``).  A request without a time never becomes final.
    """
    kept = sent.where(F.col("attempt_no").isNull() | _in_range(settings)).withWatermark("ts", horizon)
    return _stats(kept.groupBy("request_id", "ts"))


def corrections(final: DataFrame, now: DataFrame) -> DataFrame:
    """The rows of ``now`` (outcomes by all attempts logged) that differ from the final ones of the same requests."""
    told = ["outcome", "reason", "attempts"]
    was = final.select("request_id", F.struct(*told).alias("_was"))
    return now.join(was, "request_id").where(~F.struct(*told).eqNullSafe(F.col("_was"))).drop("_was")


def merge_stats(stats: DataFrame) -> DataFrame:
    """Fold partial ``attempt_stats`` rows of the same requests (each batch's own) into one row each."""
    return stats.groupBy("request_id").agg(
        F.max("n").alias("n"), F.min("first_ok_p").alias("first_ok_p"),
        *[F.min(name).alias(name) for name in SKIP_STATS.values()], F.max("last_p").alias("last_p"))


def resolve(requests: DataFrame, stats: DataFrame, settings: Settings) -> DataFrame:
    """requests (one row each) + stats -> outcome per request."""
    j = requests.select("seq", "ts", "request_id", "route").join(stats, "request_id", "left")
    # the first attempt that ends the request on its route (least ignores nulls)
    ends = [F.when(F.col("route").isin(*routes), F.col(SKIP_STATS[code]))
            for code, (routes, _) in S.STATUS_SKIPS.items()]
    term = F.least(F.col("first_ok_p"), *ends)
    term_a, term_status = _attempt(term), _status(term)
    n = F.coalesce(F.col("n"), F.lit(0))
    exhausted = F.lit(False) if settings.attempt_limit is None else n >= settings.attempt_limit
    outcome = (
        F.when(term_a.isNotNull(), F.when(is_success(term_status), F.lit("ok")).otherwise(F.lit("skipped")))
        .when(exhausted, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    deciding = F.coalesce(term, F.col("last_p"))
    reason = (F.when(_status(deciding).isNotNull(), F.concat(F.lit("http_"), _status(deciding).cast("string")))
              .when(deciding.isNotNull(), F.lit(S.R_NO_ANSWER)))
    warn = [code for code, (_, level) in S.STATUS_SKIPS.items() if level == "WARN"]
    level = (
        F.when(outcome == "ok", F.lit("DEBUG"))
        .when(outcome == "skipped", F.when(term_status.isin(*warn), F.lit("WARN")).otherwise(F.lit("INFO")))
        .when(outcome == "failed", F.lit("ERROR"))
    )
    attempts_used = F.when(term_a.isNotNull(), term_a).otherwise(n)
    return j.select(
        "seq", "ts", "request_id", "route",
        outcome.alias("outcome"),
        reason.alias("reason"),
        level.alias("level"),
        attempts_used.cast("bigint").alias("attempts"),
    )


def redelivery_outcomes(requests: DataFrame, attempts: DataFrame, settings: Settings) -> DataFrame:
    """Resolve each request from its recorded attempts (retry N, then fail)."""
    return resolve(requests, attempt_stats(attempts, settings), settings)


def all_outcomes(event_outcomes: DataFrame, request_outcomes: DataFrame) -> DataFrame:
    """The outcomes table: events stopped before dispatch + dispatched requests."""
    return event_outcomes.select(*OUTCOME_COLUMNS).unionByName(request_outcomes.select(*OUTCOME_COLUMNS))


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """Counts by (route, outcome) with subtotals per route and a grand total."""
    return outcomes.rollup("route", "outcome").agg(F.count(F.lit(1)).alias("n"))


def daily_outcomes(outcomes: DataFrame) -> DataFrame:
    """Counts by ingest day and outcome (ingest time, not event time)."""
    return (outcomes.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "outcome")
            .agg(F.count(F.lit(1)).alias("n")))


def windowed_outcomes(outcomes: DataFrame) -> DataFrame:
    """E7 streaming form: tumbling one-day windows on ingest time (update mode).

    No watermark: an outcome that comes late still counts, and the state is
    one number per day and outcome.
    """
    return (outcomes
            .groupBy(F.window("ts", "1 day").alias("w"), "outcome")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format(F.col("w").getField("start"), "yyyy-MM-dd").alias("day"), "outcome", "n"))
