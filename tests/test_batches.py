"""Committed batches, compaction, and the bucketed table."""

import pytest
from pyspark.sql import functions as F

from relaysync import storage
from relaysync.session import scratch_dir
from relaysync.streaming import buckets as B
from relaysync.streaming.batches import BatchLog
from relaysync.streaming.buckets import BucketTable


def _batch(spark, n):
    return spark.createDataFrame([(n, k) for k in range(3)], "batch long, k long").coalesce(1)


def _rows(log, **kw):
    return sorted((r.batch, r.k) for r in log.read("rows", "batch long, k long", **kw).collect())


def test_half_written_batches_are_not_read(spark):
    log = BatchLog(spark, scratch_dir(spark, "log") + "/x")
    assert log.read("rows") is None and log.last() == -1 and not log.committed(0)
    with log.batch(0) as put:
        put("rows", _batch(spark, 0))
    with pytest.raises(RuntimeError), log.batch(1) as put:
        put("rows", _batch(spark, 1))
        raise RuntimeError("lost between two outputs")
    assert _rows(log) == [(0, 0), (0, 1), (0, 2)] and log.last() == 0
    with log.batch(1) as put:  # the replay
        put("rows", _batch(spark, 1))
        put("more", _batch(spark, 1))
    assert len(_rows(log)) == 6 and log.committed(1) and log.read("more").count() == 3
    # two attempts that both reached the end of a batch count once
    with log.batch(1) as put:
        put("rows", _batch(spark, 1))
    assert len(_rows(log)) == 6


def test_folders_after_a_hundred_batches(spark):
    latest = {"latest": lambda rows, last: rows.groupBy("k").agg(F.max("batch").alias("batch"))}
    log = BatchLog(spark, scratch_dir(spark, "log") + "/x", latest, every=4)
    for n in range(100):
        with log.batch(n) as put:
            put("rows", _batch(spark, n))
            if n >= 90:
                put("latest", _batch(spark, n))
        if n in (5, 63, 64, 70):
            assert _rows(log) == [(b, k) for b in range(n + 1) for k in range(3)]
    assert _rows(log) == [(b, k) for b in range(100) for k in range(3)]
    assert log.read("latest").groupBy("k").agg(F.max("batch").alias("b")).where("b = 99").count() == 3
    # 64 + 16 + 16 + 4 batches, and those that the last compaction replaced
    assert [s[:2] for s in log.live()] == [(0, 63), (64, 79), (80, 95), (96, 99)]
    assert len(storage.names(f"{log.root}/data")) <= 8 and len(storage.names(f"{log.root}/commits")) <= 8
    # a read from a batch on opens the segments that reach it, also one that begins earlier
    assert {r[0] for r in _rows(log, since=97)} == {96, 97, 98, 99}
    assert {r[0] for r in _rows(log, before=64)} == set(range(64))


def _table(spark, buckets=8, n=200):
    rows = spark.range(n).selectExpr("concat('s', id) AS s", "'old' AS o")
    return BucketTable.create(rows, scratch_dir(spark, "buckets") + "/t", "s", buckets)


def test_untouched_buckets_are_not_read_or_written(spark):
    table = _table(spark)
    before = table.current()["paths"]
    keys = spark.createDataFrame([("s1",), ("s7",)], "s string")
    touched = table.touched(keys)
    assert 1 <= len(touched) <= 2
    part = table.read(touched)
    size = part.count()
    read = {"/" + f.rsplit("/", 1)[0].split(":")[-1].lstrip("/") for f in part.inputFiles()}
    assert read == {p for b in touched for p in before[str(b)]}
    new = part.join(keys, "s", "left_anti").unionByName(keys.select("s", F.lit("new").alias("o")))
    table.replace(new, touched, 0)
    after = table.current()["paths"]
    assert {b for b in before if before[b] != after.get(b)} == {str(b) for b in touched}
    got = {r.s: r.o for r in table.read().collect()}
    assert got == {f"s{i}": "new" if i in (1, 7) else "old" for i in range(200)}
    # a replayed change is left out; a bucket that loses all rows is empty
    table.replace(new.limit(0), touched, 0)
    assert table.read().count() == 200
    table.replace(new.limit(0), touched, 1)
    assert table.read().count() == 200 - size and table.read(touched).count() == 0


def test_versions_and_attempts_that_died(spark):
    table = _table(spark, buckets=2, n=20)
    spark.range(3).write.parquet(f"{table.root}/data/dead")
    old = table.read()
    for batch in range(5):
        table.append(spark.createDataFrame([(f"x{batch}", "a")], "s string, o string"), batch)
        if batch == 0:
            assert old.count() == 20  # a reader of the version before is still served
    assert table.read().count() == 25 and len(storage.names(f"{table.root}/versions")) == B.KEEP
    named = {p.rsplit("/", 2)[1] for p in sum(table.current()["paths"].values(), [])}
    assert set(storage.names(f"{table.root}/data")) == named
    for batch in range(5, 40):
        table.append(spark.createDataFrame([("x0", str(batch))], "s string, o string"), batch,
                     lambda df: df.groupBy("s").agg(F.max("o").alias("o")))
    assert max(map(len, table.current()["paths"].values())) <= B.FOLDERS
    assert table.read().where("s = 'x1'").count() == 1


def test_a_hot_key_becomes_several_files(spark):
    """A subject with most of the rows: its bucket is written by several tasks, and a join with it is split."""
    hot = spark.range(0, 90_000, 1, 6).selectExpr("if(id % 3 > 0, 'hot', concat('s', id)) AS s", "sha2(cast(id AS string), 512) AS o")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        table = BucketTable.create(hot, scratch_dir(spark, "hot") + "/t", "s", 4)
        b = str(table.touched(spark.createDataFrame([("hot",)], "s string"))[0])
        files = [f for f in table.read().inputFiles() if f"/_bucket={b}/" in f]
        assert len(files) > 3
        kept = table.read().join(spark.createDataFrame([("s0",)], "s string"), "s", "left_anti")
        out = kept.agg(F.count("*").alias("n"), F.max("o"))
        assert out.collect()[0].n == hot.count() - 1
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
