"""The response join over many triggers: the streams land in time order, the join holds its horizon only."""

import datetime as dt
import os
import uuid
from collections import Counter

from relaysync.plans import jobs
from relaysync.plans import queries as Q
from relaysync.session import scratch_dir
from relaysync.streaming import pipeline as P

KEY = "spark.sql.shuffle.partitions"


def _events(spark):
    """An event an hour over 20 days; some come again at other times, some have no time or no id."""
    root = scratch_dir(spark, f"responses-{uuid.uuid4().hex}")

    def made(ids, event_id="id", hours="id"):
        return ids.selectExpr(
            f"{event_id} AS event_id", f"timestamp_seconds(1704067200 + {hours} * 3600) AS ts", "id + 100 AS user_id",
            "element_at(array('click', 'signup', 'view', 'purchase', 'error'), cast(id % 5 + 1 AS int)) AS event_type",
            "1.0D AS value", "concat('{\"k\": ', id % 8 + 4, '}') AS props")

    rows = made(spark.range(480))
    again = [made(spark.range(0, 40, 4), hours=f"(id + {h})") for h in (0, 20, 300)]
    for part in (*again, made(spark.range(6), "if(id < 3, id + 1000, null)", "if(id < 3, null, id)")):
        rows = rows.unionByName(part)
    rows.coalesce(1).write.parquet(f"{root}/events.parquet")
    return root


def _run(spark, root, monkeypatch):
    """(rows, most rows in the join's state, its triggers)."""
    started, sync = [], jobs.sync_responses
    monkeypatch.setattr(jobs, "sync_responses", lambda *a, **k: started.extend(sync(*a, **k)) or started)
    got = Counter(map(tuple, Q.q_stream_responses(spark, root).collect()))
    monkeypatch.setattr(jobs, "sync_responses", sync)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in started[0].recentProgress if p["stateOperators"]]
    return got, max(held), len(held)


def test_join_holds_its_horizon_and_not_all_rows(spark, monkeypatch):
    root, was = _events(spark), spark.conf.get(KEY)
    whole, all_held, few = _run(spark, root, monkeypatch)
    monkeypatch.setattr(Q, "TRIGGER_ROWS", 10, raising=False)
    got, held, triggers = _run(spark, root, monkeypatch)
    assert got == whole and sum(got.values()) > 2000
    pending = {i.split(":")[0] for i, _, _, c in got if c == "pending"}
    assert pending and all(int(i) % 29 == 0 for i in pending)
    assert triggers > few + 4 and held < all_held / 3
    assert spark.conf.get(KEY) == was


def test_chunks_are_landed_whole(spark):
    path = scratch_dir(spark, "whole")
    for name, rows in (("a", spark.range(2).repartition(5)), ("b", spark.range(0).repartition(5)), ("c", spark.range(100).repartition(5))):
        P.stage_whole(rows, f"{path}/{name}", 5)
        found = [f for _, _, names in os.walk(f"{path}/{name}".removeprefix("file:")) for f in names if f.endswith(".parquet")]
        back = spark.read.option("recursiveFileLookup", "true").schema("id bigint").parquet(f"{path}/{name}")
        assert len(found) == 5 and sorted(r.id for r in back.collect()) == sorted(r.id for r in rows.collect())


def test_time_cuts(spark):
    days = [*range(1, 21), *[7] * 10]
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in days] + [(None,)] * 3, "ts timestamp")
    cuts = P.time_cuts(df, "ts", 6)
    parts = df.select("ts", P.chunk_of("ts", cuts).alias("k")).collect()
    assert {r.k for r in parts if r.ts is None} == {len(cuts)} and 2 <= len(cuts) <= 5
    timed = sorted((r.ts, r.k) for r in parts if r.ts is not None)
    assert [k for _, k in timed] == sorted(k for _, k in timed) and {k for _, k in timed} >= set(range(1, len(cuts) + 1))
    assert len({k for t, k in timed if t.day == 7}) == 1
    none = df.where("ts is null")
    assert P.time_cuts(none, "ts", 6) == P.time_cuts(none.limit(0), "ts", 6) == P.time_cuts(df, "ts", 1) == []


def test_state_partitions(spark):
    was = spark.conf.get(KEY)
    with P.state_partitions(spark, 3):
        assert spark.conf.get(KEY) == "3"
    with P.state_partitions(spark, None):
        assert spark.conf.get(KEY) == was
    assert spark.conf.get(KEY) == was
