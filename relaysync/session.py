"""SparkSession and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # delete checkpoint files of written intermediates once they are unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # client-side call-site capture walks the Python stack on every Column call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "relaysync",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session.  Only a local-mode session (tests) without the
    setting gets a folder of its own; on a cluster the setting is required,
    since a machine-local folder would not survive the loss of an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Connect session has no SparkContext view
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="relaysync-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
    elif sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared root."""
    root = shared_root(spark).rstrip("/")
    path = f"{root}/relaysync/{name}-{uuid.uuid4().hex}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.removeprefix("file:"), exist_ok=True)
    return path


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    For intermediate tables read by several consumers (e.g. the winners of
    last-writer-wins), so the expensive input (parsing every event) is not
    recomputed per consumer.  Reliable checkpoint, never a local one.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df, name: str, spark=None):
    """Write ``df`` once as Parquet under the shared folder and read it back (in the session ``spark``).

    Cuts lineage like ``materialize``, but columnar: a reader takes only the
    columns it needs.  A lost executor loses nothing of it.
    """
    path = scratch_dir(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)
