"""The command line runs the batch and stream jobs end to end."""

import os

import pytest

from relaysync.__main__ import main
from relaysync.plans import jobs
from relaysync.plans import queries as Q
from relaysync.session import scratch_dir
from relaysync.sources import feed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")


def test_cli_batch_and_stream(spark, tmp_path):
    props = tmp_path / "site.properties"
    # the service base URL comes in under a site-specific key name, mapped with --alias
    lines = [f"{k}={v}" for k, v in feed.FEED_PROPERTIES if k != "indexer.service.baseUrl"]
    lines.append("site.service.base=http://cms/sync/")
    props.write_text("\n".join(lines) + "\n")
    root = scratch_dir(spark, "cli")
    Q.raw(spark, SF).write.parquet(f"{root}/raw")
    Q.resources(spark, SF).write.parquet(f"{root}/docs")
    Q.prior(spark, SF).write.parquet(f"{root}/prior")
    paths = main(["batch", "--props", str(props), "--alias", "site.service.base=indexer.service.baseUrl",
                  "--raw", f"{root}/raw", "--out", f"{root}/out",
                  "--resources", f"{root}/docs", "--prior-triples", f"{root}/prior"], spark)
    got = spark.read.parquet(paths["requests"]).select(*Q.ALL_REQ_COLS)
    want = Q.q_all_requests(spark, SF)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    tri = spark.read.parquet(paths["triples"])
    want_t = Q.q_triples_after_delete(spark, SF)
    assert tri.exceptAll(want_t).count() == 0 and want_t.exceptAll(tri).count() == 0
    out = main(["stream", "--props", str(props), "--alias", "site.service.base=indexer.service.baseUrl",
                "--raw", f"{root}/raw", "--raw-format", "parquet",
                "--out", f"{root}/sout", "--checkpoint", f"{root}/ckpt"], spark)
    assert out["sync"] == f"{root}/sout/sync"
    sgot = jobs.written(spark, f"{root}/sout", "requests").select(*Q.ALL_REQ_COLS)
    assert sgot.exceptAll(want).count() == 0 and want.exceptAll(sgot).count() == 0
    dcols = ["seq", "route", "service_uri", "source_uri"]
    dgot = jobs.written(spark, f"{root}/sout", "derivative_requests").select(*dcols)
    dwant = Q.q_derivative_requests(spark, SF).select(*dcols)
    assert dgot.exceptAll(dwant).count() == 0 and dwant.exceptAll(dgot).count() == 0
