"""A replay of decoded blocks as one plan: enrich, detect, split new from known, store, checkpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import money
from lodewell.functions.lineage import cut, cut_counted
from lodewell.operators import chain, detectors, metrics, provenance, replay, watch
from lodewell.plans.store import Store


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the detectors, in satoshis, counts, days and seconds."""

    transfer: tuple[int, int, int] = (100 * 10**8, 1_000 * 10**8, 10_000 * 10**8)
    interval: tuple[int, int, int] = (1_800, 5_400, 7_200)
    dormant_days: int = 1_825
    dormant_sats: int = 10**8
    consolidation: tuple[int, int, int, int, int] = (20, 5, 100, 50, 100 * 10**8)
    fan_out: tuple[int, int, int, int] = (50, 200, 100, 100 * 10**8)
    fee: tuple[int, float] = (10**7, 200.0)
    fee_steps: tuple[int, int] = (10**8, 5 * 10**7)
    rate_steps: tuple[float, float] = (1000.0, 500.0)


def transactions_of(blocks: DataFrame) -> DataFrame:
    """One row a transaction with its block's place in the chain."""
    tx = blocks.select("block_hash", F.col("height").alias("block_height"), "timestamp", F.posexplode("transactions").alias("tx_index", "t"))
    return tx.select("block_hash", "block_height", "timestamp", "tx_index", "t.*")


def outputs_of(tx: DataFrame) -> DataFrame:
    return tx.select("txid", F.col("timestamp").alias("confirmed_at"), F.col("block_height").alias("confirmed_height"), F.inline(F.transform("outputs", lambda o: F.struct(o["n"].alias("n"), o["value_sats"].alias("value_sats"), o["address"].alias("address")))))


def named_outputs(tx: DataFrame, outputs: DataFrame | None) -> DataFrame | None:
    """The stored outputs that an input of tx names: what is joined further is no larger than tx, however long the chain."""
    return None if outputs is None else outputs.join(spent_points(tx), ["txid", "n"], "left_semi")


def spent_points(tx: DataFrame) -> DataFrame:
    """The outputs that inputs name, by txid and n."""
    return tx.select(F.explode("inputs").alias("i")).select(F.col("i.txid").alias("txid"), F.col("i.vout").cast("bigint").alias("n")).distinct()


def enriched(tx: DataFrame, known_outputs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions with input totals and fees, one row an input). known_outputs: outputs of earlier ranges.

    A transaction with an input that is not known keeps fee 0 and no rate; a first transaction of a block has no inputs.
    """
    outputs = outputs_of(tx)
    if known_outputs is not None:
        outputs = outputs.unionByName(known_outputs.select(*[c for c in outputs.columns if c in known_outputs.columns]), allowMissingColumns=True).dropDuplicates(["txid", "n"])
    points = tx.select(F.col("txid").alias("spender"), F.col("timestamp").alias("ts"), "block_hash", "block_height", F.posexplode("inputs").alias("position", "i")).filter(~F.col("i.is_coinbase"))
    points = points.select(F.col("spender"), "ts", "block_hash", "block_height", "position", F.col("i.txid").alias("prev_txid"), F.col("i.vout").alias("prev_vout"))
    inputs = chain.enrich_inputs(points, outputs).withColumnRenamed("spender", "txid")
    totals = inputs.groupBy("txid").agg(F.sum("value_sats").alias("in_sats"), F.every(F.col("value_sats").isNotNull()).alias("resolved"))
    whole = tx.select(F.col("txid"), "input_count", "total_output_sats")
    inputs = inputs.join(totals.select("txid", F.coalesce("in_sats", F.lit(0).cast("bigint")).alias("total_input_sats")), "txid").join(whole, "txid")
    joined = tx.drop("total_input_sats", "fee_sats").join(totals, "txid", "left")
    resolved = F.coalesce("resolved", F.lit(False))
    fee = F.when(resolved, F.greatest(F.lit(0).cast("bigint"), F.col("in_sats") - F.col("total_output_sats"))).otherwise(F.lit(0).cast("bigint"))
    out = joined.withColumns({"total_input_sats": F.coalesce("in_sats", F.lit(0).cast("bigint")), "fee_sats": fee, "fee_rate_sat_vb": F.when(resolved & (F.col("vsize") > 0), fee.cast("double") / F.col("vsize"))})
    return out.drop("in_sats", "resolved"), inputs


def detect(blocks: DataFrame, known_outputs: DataFrame | None = None, limits: Thresholds = Thresholds(), network: str = "mainnet", history: bool = True) -> DataFrame:
    """Canonical events of decoded blocks. Intervals need the block before the range among the blocks."""
    return block_events(blocks, *enriched(transactions_of(blocks), known_outputs), limits, network, history)


def block_events(blocks: DataFrame, tx: DataFrame, inputs: DataFrame, limits: Thresholds = Thresholds(), network: str = "mainnet", history: bool = True) -> DataFrame:
    """Canonical events of decoded blocks whose transactions are enriched already."""
    found = transaction_events(tx, inputs, limits, network)
    context = F.struct(F.lit(None).cast("string").alias("txid"), "block_hash", F.col("height").alias("block_height"), F.col("timestamp").alias("event_time"))
    spaced = chain.block_intervals(blocks, live=not history).withColumn("context", context)
    return found.unionByName(detectors.canonical(detectors.long_interval(spaced, *limits.interval), network))


def counted_enriched(tx: DataFrame, inputs: DataFrame, own: Column | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Enriched transactions and inputs, written once for all that asks for them, with their counters. own: what a step counts."""
    own = F.lit(True) if own is None else own
    tx, found = cut_counted(tx, transactions_observed=F.count_if(own), transactions_enriched=F.count_if(own & F.col("fee_rate_sat_vb").isNotNull()))
    inputs, missed = cut_counted(inputs, utxo_lookup_failures=F.count_if(own & F.col("value_sats").isNull()))
    return tx, inputs, found | missed


def watch_step(store: Store, tx: DataFrame, inputs: DataFrame, max_depth: int = 3) -> dict[str, int]:
    """Match a step's transactions with the stored watch targets: activities, alerts, and the outputs to follow from now on.

    Steps come in the order of the chain; what was followed in earlier ones is stored, so descendants are found across steps.
    """
    none = {"incident_activities_detected": 0, "incident_alerts_emitted": 0}
    if not store.has("target_writes"):
        return none
    targets = cut(store.watch_targets())
    arrival = F.coalesce(F.col("block_height"), F.lit(0)) * 1_000_000 + (F.col("tx_index") if "tx_index" in tx.columns else F.lit(0))
    heads = tx.select("txid", arrival.cast("bigint").alias("arrival"), F.col("block_height").alias("height"), "block_hash", F.col("timestamp").alias("observed_at"), "total_output_sats")
    spent = inputs.select("txid", "position", "prev_txid", "prev_vout", "address", "value_sats").join(heads.select("txid", "arrival"), "txid")
    made = tx.select("txid", arrival.cast("bigint").alias("arrival"), F.inline("outputs"))
    made = made.select("txid", "arrival", F.col("n").cast("int").alias("position"), F.col("n").alias("vout"), "value_sats", "address", F.col("scriptpubkey_hex").alias("script_hex"), money.is_data_carrier(F.col("script_pubkey_type"), F.col("scriptpubkey_hex")).alias("op_return"))
    heads, spent, made = cut(heads), cut(spent), cut(made)
    points = cut(store.table("followed_points").join(spent.select("prev_txid").distinct(), "prev_txid", "left_semi")) if store.has("followed_points") else None
    found, entered = watch.engine(heads, spent, made, targets, max_depth, points)
    rows = watch.described(cut(found), targets).join(heads.select("txid", F.col("height").alias("block_height"), "block_hash", "observed_at"), "txid")
    rows, found = cut_counted(watch.firsts(rows.withColumn("status", F.when(F.col("block_height").isNull(), "MEMPOOL").otherwise("CONFIRMED"))), incident_activities_detected=F.count(F.lit(1)))
    if found["incident_activities_detected"] == 0:
        return none
    store.append_new("followed_points", cut(entered), ["prev_txid", "prev_vout", "target_id"])
    return found | {"incident_alerts_emitted": store.save_activities(rows)}


def transaction_events(tx: DataFrame, inputs: DataFrame, limits: Thresholds = Thresholds(), network: str = "mainnet") -> DataFrame:
    """Canonical events of enriched transactions and their inputs."""
    context = F.struct("txid", "block_hash", "block_height", F.col("timestamp").alias("event_time"))
    values = F.array_sort(F.transform("outputs", lambda o: o["value_sats"]))
    tx = tx.withColumns({"context": context, "outputs": values})
    inputs = inputs.withColumns({"context": F.struct("txid", "block_hash", "block_height", F.col("ts").alias("event_time")), "ts": F.col("ts").cast("timestamp_ntz"), "confirmed_at": F.col("confirmed_at").cast("timestamp_ntz")})
    found = [
        detectors.large_transfer(tx, *limits.transfer),
        detectors.dormant_coins(inputs, limits.dormant_days, limits.dormant_sats, 10**8),
        detectors.consolidation(tx, *limits.consolidation),
        detectors.fan_out(tx, *limits.fan_out),
        detectors.extreme_fee(tx, *limits.fee, limits.fee_steps, limits.rate_steps),
    ]
    out = None
    for one in found:
        rows = detectors.canonical(one, network)
        out = rows if out is None else out.unionByName(rows)
    return out


def run(store: Store, blocks: DataFrame, span: replay.ReplayRange, job: str, limits: Thresholds = Thresholds(), network: str = "mainnet", every: int = 1_000) -> str:
    """Replay a range into the store, ``every`` blocks a step, going on after the last checkpoint; the job's last status.

    A job that is paused or cancelled stops at the end of a step, and one whose step lacks a block fails before it writes
    anything of the step. Everything a step writes has a key of its own, so a step that runs twice adds nothing. A step
    also reads the block before it, where there is one, for the interval of its first block. What a step met, made and found
    known is counted as its plans run (``Store.flow``).
    """
    state = store.job(job)
    if state is None:
        store.save_job(job, span, "RUNNING")
    elif state["status"] in ("COMPLETED", "CANCELLED"):
        return state["status"]
    else:
        store.save_job(job, span, "RUNNING")
    done = store.checkpoint(job)
    at = span.start if done is None else done + 1
    while at <= span.end:
        if (status := store.job(job)["status"]) != "RUNNING":
            return status
        end = min(at + every - 1, span.end)
        part = blocks.filter(F.col("height").between(max(at - 1, 0), end))
        if not chain.missing_heights(part, at, end).isEmpty():
            store.save_job(job, span, "FAILED")
            return "FAILED"
        own = F.col("height") >= at
        part, counts = cut_counted(part, blocks_observed=F.count_if(own))  # decoded once for all that a step asks of it
        known = store.lookup("outputs", spent_points(transactions_of(part)))
        known = known if known is None else cut(known)
        mine = F.col("block_height") >= at
        tx, inputs, flow = counted_enriched(*enriched(transactions_of(part), known), mine)
        events, made = cut_counted(replay.stamp(block_events(part, tx, inputs, limits, network), job).filter(mine), n=F.count(F.lit(1)))
        watched = watch_step(store, tx.filter(mine), inputs.filter(mine))
        store.append_new("outputs", outputs_of(tx.filter(mine)), ["txid", "n"])
        new = store.append_new("events", events, ["id"])
        written = store.table("events").filter((F.col("replay_job_id") == job) & F.col("block_height").between(at, end))
        store.append_new("event_metrics", metrics.extract(written).withColumnRenamed("id", "event_id"), ["event_id", "metric", "metric_definition_version"])
        store.save_observations(observations(events, job))
        store.count(f"replay/{job}", at, **counts, **flow, **watched, events_generated=new, events_deduplicated=made["n"] - new)
        store.save_checkpoint(job, end)
        at = end + 1
    store.save_job(job, span, "COMPLETED")
    return "COMPLETED"


def observations(events: DataFrame, job: str) -> DataFrame:
    """One observation for each event of a replay, also of events that were known."""
    return provenance.observe(events, "Confirmed", "historical_replay", replay_job_id=F.lit(job), confirmation_status=F.lit("confirmed"))


def created_and_known(store: Store, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return replay.split_new(events, store.table("events"), "id") if store.has("events") else (events, events.limit(0))


