"""python -m lodewell run | listen | fetch | replay | baseline | rarity: the store's work from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodewell.operators.replay import ReplayRange
from lodewell.plans import replay_run
from lodewell.plans.store import Store
from lodewell.sources import decoders, sockets
from lodewell.sources.node import BlockSource
from lodewell.streaming import live


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodewell", description=__doc__)
    steps = top.add_subparsers(dest="step", required=True)
    run = steps.add_parser("run", help="follow a node's tip: events, confirmations and reorganisations as they happen")
    run.add_argument("--checkpoint", required=True)
    run.add_argument("--start", type=int, help="first height of a store that is new; the present tip if not given")
    run.add_argument("--network", default="mainnet")
    run.add_argument("--once", action="store_true", help="end at the present tip")
    listen = steps.add_parser("listen", help="hold a push socket and land its messages in a folder, until interrupted")
    listen.add_argument("--address", required=True, help="tcp://host:port of a publisher, or ws(s)://host/path")
    listen.add_argument("--into", required=True, help="a folder of this machine's file system that Spark reads too")
    listen.add_argument("--topic", action="append", help="topic of a publisher, as often as needed; rawtx, rawblock and sequence if none is given")
    listen.add_argument("--say", action="append", default=[], help="text sent to a web socket when it opens")
    listen.add_argument("--seconds", type=float, default=5.0, help="a file at least so often")
    fetch = steps.add_parser("fetch", help="read raw blocks of a range from a node into Parquet")
    for one in (run, fetch):
        one.add_argument("--url", required=True)
        one.add_argument("--kind", choices=("rpc", "rest"), default="rpc")
        one.add_argument("--cookie")
    fetch.add_argument("--into", required=True)
    again = steps.add_parser("replay", help="detect events of a range of raw blocks")
    again.add_argument("--blocks", required=True)
    again.add_argument("--job", required=True)
    rare = steps.add_parser("rarity", help="rarity of the events of a baseline run")
    rare.add_argument("--run", required=True)
    base = steps.add_parser("baseline", help="store the distributions of a range")
    for one in (fetch, again, base):
        one.add_argument("--start", type=int, required=True)
        one.add_argument("--end", type=int, required=True)
    for one in (run, again, base, rare):
        one.add_argument("--store", required=True)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    if a.step == "listen":
        client = sockets.Subscriber(a.address, a.topic or ["rawtx", "rawblock", "sequence"]) if a.address.startswith("tcp:") else sockets.WebSocket(a.address, a.say)
        sockets.land(sockets.lasting(client, told=lambda why, wait: print(f"{why}; again in {wait:g} s", file=sys.stderr)), a.into, a.seconds)
        return
    spark = spark or SparkSession.builder.appName("lodewell").getOrCreate()
    if a.step == "run":
        options = {"kind": a.kind} | ({"cookie": a.cookie} if a.cookie else {}) | ({"start": a.start} if a.start is not None else {})
        for query in live.follow(Store(spark, a.store), a.checkpoint, a.url, a.network, once=a.once, **options):
            query.awaitTermination()
    elif a.step == "fetch":
        spark.dataSource.register(BlockSource)
        options = {"url": a.url, "kind": a.kind, "start": a.start, "end": a.end} | ({"cookie": a.cookie} if a.cookie else {})
        spark.read.format("lodewell_blocks").options(**options).load().write.mode("append").parquet(a.into)
    elif a.step == "replay":
        span = ReplayRange(a.start, a.end)
        span.check()
        raw = spark.read.parquet(a.blocks).dropDuplicates(["block_hash"])
        heights = raw.selectExpr("block_hash", "height AS stated")
        decoded = decoders.blocks(raw).drop("height").join(heights, "block_hash").withColumnRenamed("stated", "height")
        print(replay_run.run(Store(spark, a.store), decoded, span, a.job))
    elif a.step == "baseline":
        print(Store(spark, a.store).save_baseline(a.start, a.end))
    else:
        Store(spark, a.store).rarity(a.run).orderBy("id", "metric").show(100, truncate=False)


if __name__ == "__main__":
    main()
