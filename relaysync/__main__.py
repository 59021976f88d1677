"""Command line: run the batch job over landed events, or the stream job.

  python -m relaysync batch --props site.properties --raw /landing/raw --out /out/run-42 \\
      [--raw-format parquet|json] [--resources /docs] [--prior-triples /triples/current] \\
      [--attempts /attempts] [--strict]
  python -m relaysync stream --props site.properties --raw /landing/raw --out /out/stream \\
      --checkpoint /shared/ckpt/stream [--resources /docs] [--attempts /attempts] [--every "1 minute"]

The session comes from the environment (spark-submit); nothing is set here
except what the arguments say.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from relaysync.operators.derivatives import routes_registry
from relaysync.plans import jobs
from relaysync.plans.triplestore import sync_triplestore
from relaysync.schema import ATTEMPTS_DDL, RESOURCES_DDL
from relaysync.sources.events import read_raw_events, read_raw_events_stream, read_resources
from relaysync.sources.properties import read_properties, to_map
from relaysync.settings import Settings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relaysync")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("batch", "stream"):
        s = sub.add_parser(name)
        s.add_argument("--props", action="append", default=[], help="properties file (repeatable, later wins)")
        s.add_argument("--alias", action="append", default=[], metavar="THEIR=OURS",
                       help="read property THEIR as key OURS (repeatable)")
        s.add_argument("--raw", required=True, help="landed raw_events")
        s.add_argument("--raw-format", default="parquet" if name == "batch" else "json")
        s.add_argument("--out", required=True)
        s.add_argument("--strict", action="store_true", help="reject events with unknown keys")
        s.add_argument("--dedup", action="store_true", help="drop re-delivered messages")
    b = sub.choices["batch"]
    b.add_argument("--resources")
    b.add_argument("--prior-triples", help="default: start from an empty store")
    b.add_argument("--attempts")
    st = sub.choices["stream"]
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--resources", help="folder of fetched documents (parquet), read as they arrive: adds the triplestore routes")
    st.add_argument("--prior-triples", help="triples stored before the first batch; default: an empty store")
    st.add_argument("--buckets", type=int, default=256, help="hash buckets of the triples table (fixed by the first run)")
    st.add_argument("--tries", type=int, default=5, help="batches that an index event waits for its document")
    st.add_argument("--attempts", help="folder of recorded delivery attempts (parquet), read as a second stream")
    st.add_argument("--every", help="processing-time trigger; default: process what is there and stop")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("relaysync").getOrCreate()
    props = read_properties(spark, args.props)
    aliases = dict(a.split("=", 1) for a in args.alias)
    settings = Settings.from_map(to_map(props, aliases), aliases)
    if args.cmd == "batch":
        raw = read_raw_events(spark, args.raw, args.raw_format)
        res = read_resources(spark, args.resources) if args.resources else None
        prior = spark.read.parquet(args.prior_triples) if args.prior_triples else None
        att = spark.read.parquet(args.attempts) if args.attempts else None
        reg = routes_registry(props)
        paths = jobs.sync_batch(spark, raw, settings, args.out, resources=res, prior_triples=prior,
                                attempts=att, registry=reg, strict=args.strict, dedup=args.dedup)
        print(json.dumps(paths))
        return paths
    trigger = {"processingTime": args.every} if args.every else {"availableNow": True}
    raw = read_raw_events_stream(spark, args.raw, args.raw_format)
    started = [jobs.sync_stream(raw, settings, args.out, args.checkpoint, trigger, registry=routes_registry(props),
                                strict=args.strict, dedup=args.dedup)]
    paths = {"sync": f"{args.out}/sync"}
    if args.resources:
        docs = spark.readStream.schema(RESOURCES_DDL).parquet(args.resources)
        prior = spark.read.parquet(args.prior_triples) if args.prior_triples else None
        started.append(sync_triplestore(raw, docs, settings, args.out, f"{args.checkpoint}-triplestore", prior, args.buckets,
                                        args.tries, trigger, args.strict))
        paths["triplestore"], paths["triples"] = f"{args.out}/triplestore", f"{args.out}/triples"
    if args.attempts:
        att = spark.readStream.schema(ATTEMPTS_DDL).parquet(args.attempts)
        started.append(jobs.sync_attempts(att, settings, args.out, f"{args.checkpoint}-attempts", trigger))
        paths["attempts"] = f"{args.out}/attempts"
    for query in started:
        query.awaitTermination()
    return paths


if __name__ == "__main__":
    main()
