"""Live detection: decoded transactions and blocks of streams, enriched with stored outputs, into stored events; reorganisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodewell.functions.lineage import cut, cut_counted
from lodewell.operators import chain, detectors, provenance
from lodewell.plans import replay_run
from lodewell.plans.store import Store
from lodewell.sources import decoders
from lodewell.sources.node import BlockSource
from lodewell.streaming import tip


def enriched_live(tx: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions with input totals and fees, inputs) of mempool transactions against the stored outputs.

    Only outputs that an input names are taken from the table, so what is joined further is no larger than the batch.
    """
    known = replay_run.named_outputs(tx, outputs)
    bare = {"block_hash": F.lit(None).cast("string"), "block_height": F.lit(None).cast("bigint")}
    missing = {c: v for c, v in bare.items() if c not in tx.columns}
    return replay_run.enriched(tx.withColumns(missing), known)


def detect_transactions(tx: DataFrame, outputs: DataFrame, limits: replay_run.Thresholds = replay_run.Thresholds(), network: str = "mainnet") -> DataFrame:
    """Canonical events of unconfirmed transactions; tx has a timestamp of arrival."""
    rows, inputs = enriched_live(tx, outputs)
    return replay_run.transaction_events(rows, inputs, limits, network).withColumn("observation_mode", F.lit("live"))


def observations(store: Store, events: DataFrame) -> DataFrame:
    """A sighting of each event in the mempool; of one whose block was reorganised out, that it came back."""
    if store.has("observations"):
        out = store.table("observations").filter("kind = 'ReorgedOut'").select(F.col("event_id").alias("id")).distinct().withColumn("back", F.lit(True))
        events = events.join(out, "id", "left")
    else:
        events = events.withColumn("back", F.lit(None).cast("boolean"))
    return provenance.observe(events, "MempoolSeen", transport="landed", confirmation_status=F.when(F.col("back"), "reentered").otherwise("unconfirmed"))


def sink(store: Store, limits: replay_run.Thresholds = replay_run.Thresholds(), network: str = "mainnet"):
    """A foreachBatch sink of decoded transactions: new events and one live observation for each; a batch that runs twice adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        tx = batch.dropDuplicates(["txid"])
        tx = tx if "timestamp" in tx.columns else tx.withColumn("timestamp", F.current_timestamp())
        rows, inputs, flow = replay_run.counted_enriched(*enriched_live(tx, _outputs(store, tx)))
        found = replay_run.transaction_events(rows, inputs, limits, network).withColumn("observation_mode", F.lit("live"))
        events, made = cut_counted(found, n=F.count(F.lit(1)))
        new = store.append_new("events", events.withColumn("replay_job_id", F.lit(None).cast("string")), ["id"])
        store.save_observations(observations(store, events))
        store.count("live/transactions", number, **flow, events_generated=new, events_deduplicated=made["n"] - new)

    return write


def _outputs(store: Store, tx: DataFrame) -> DataFrame:
    """The stored outputs that tx spends."""
    found = store.lookup("outputs", replay_run.spent_points(tx))
    return found if found is not None else store.spark.createDataFrame([], "txid string, confirmed_at timestamp, confirmed_height bigint, n bigint, value_sats bigint")


def _confirmed(events: DataFrame) -> DataFrame:
    return provenance.observe(events, "Confirmed", confirmation_status=F.lit("confirmed"))


def _reorged_out(confirmed: DataFrame, gone: DataFrame) -> DataFrame:
    """An observation that its block is gone, for each confirmation by a block that is (gone: block_hash, gone_at)."""
    rows = confirmed.filter("mode = 'live' AND kind = 'Confirmed'").join(gone, "block_hash").select(F.col("event_id").alias("id"), F.col("bitcoin_time").alias("event_time"), "block_height", "block_hash", "gone_at")
    return provenance.observe(rows, "ReorgedOut", observed_at=F.col("gone_at"), confirmation_status=F.lit("reorged_out"))


def block_sink(store: Store, limits: replay_run.Thresholds = replay_run.Thresholds(), network: str = "mainnet"):
    """A foreachBatch sink of decoded blocks, of whatever branch: headers, outputs, events and their confirmations.

    Intervals are those between arrivals: a batch is taken in order of height after the last block of the batches before.
    A batch that runs twice adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocks, counts = cut_counted(batch.dropDuplicates(["block_hash"]), blocks_observed=F.count(F.lit(1)))
        first = number * 1_000_000
        order = Window.orderBy("height", "block_hash")  # over the headers of one batch
        heads = blocks.select(F.lit(network).alias("network"), "block_hash", "previous_block_hash", "height", "timestamp")
        heads = heads.withColumn("arrival", F.lit(first).cast("bigint") + F.row_number().over(order))
        before = store.table("headers").filter(F.col("arrival") < first).orderBy(F.desc("arrival")).limit(1) if store.has("headers") else heads.limit(0)
        spaced = chain.arrival_intervals(before.unionByName(heads)).filter(F.col("arrival") > first)
        context = F.struct(F.lit(None).cast("string").alias("txid"), "block_hash", F.col("height").alias("block_height"), F.col("timestamp").alias("event_time"))
        slow = detectors.canonical(detectors.long_interval(spaced.withColumn("context", context), *limits.interval), network)
        tx = replay_run.transactions_of(blocks)
        rows, inputs, flow = replay_run.counted_enriched(*enriched_live(tx, _outputs(store, tx)))
        events, made = cut_counted(replay_run.transaction_events(rows, inputs, limits, network).unionByName(slow).withColumns({"observation_mode": F.lit("live"), "replay_job_id": F.lit(None).cast("string")}), n=F.count(F.lit(1)))
        watched = replay_run.watch_step(store, rows, inputs)
        store.append_new("headers", heads, "block_hash")
        store.append_new("outputs", replay_run.outputs_of(tx), ["txid", "n"])
        new = store.append_new("events", events, ["id"])
        store.save_observations(_confirmed(events))
        store.count("live/blocks", number, **counts, **flow, **watched, events_generated=new, events_deduplicated=made["n"] - new)
        if store.has("gone_blocks"):  # the reorganisation was told before its blocks were stored
            store.save_observations(_reorged_out(_confirmed(events), store.table("gone_blocks")))

    return write


def reorg_sink(store: Store, network: str = "mainnet"):
    """A foreachBatch sink of ``tip.moves``: one event for each reorganisation; confirmations by replaced blocks become ReorgedOut.

    Either this sink or ``block_sink`` sees both a replaced block's confirmations and that it is gone, as each writes its
    own part before it reads the other's.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = cut(tip.reorgs(batch))
        context = F.struct(F.lit(None).cast("string").alias("txid"), F.col("new_tip_hash").alias("block_hash"), F.col("new_tip_height").alias("block_height"), F.col("observed_at").alias("event_time"))
        events, made = cut_counted(detectors.canonical(detectors.reorg(found.withColumn("context", context)), network), n=F.count(F.lit(1)))
        if made["n"] == 0:
            return
        new = store.append_new("events", events.withColumns({"observation_mode": F.lit("live"), "replay_job_id": F.lit(None).cast("string")}), ["id"])
        store.save_observations(_confirmed(events))
        store.count("live/tip", number, reorgs_detected=new, events_generated=new, events_deduplicated=made["n"] - new)
        gone = cut(found.select(F.explode("disconnected_blocks").alias("block_hash"), F.col("observed_at").alias("gone_at")))
        store.append_new("gone_blocks", gone, "block_hash")
        store.save_observations(_reorged_out(store.all_observations(), gone))

    return write


def follow(store: Store, checkpoint: str, url: str, network: str = "mainnet", limits: replay_run.Thresholds = replay_run.Thresholds(), once: bool = False, **options) -> list[StreamingQuery]:
    """Follow a node's tip into a store: one stream of blocks into events, one of headers into reorganisations.

    With ``once`` both end when they have read up to the present tip.
    """
    spark = store.spark
    spark.dataSource.register(BlockSource)
    raw = lambda part: spark.readStream.format("lodewell_blocks").options(url=url, part=part, **options).load()
    blocks, heads = decoders.blocks(raw("block"), stated="height"), decoders.headers(raw("header"))
    sinks = {"blocks": (blocks, block_sink(store, limits, network)), "tip": (tip.moves(heads, network=network), reorg_sink(store, network))}
    when = {"availableNow": True} if once else {"processingTime": "30 seconds"}
    return [df.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**when).start() for name, (df, write) in sinks.items()]
