"""The detectors: each takes a DataFrame of observations and returns the events found, thresholds as parameters.

A detector is one filter and one projection, so it stays inside one code-generated stage over its scan.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.identity import event_key, uuid5
from lodewell.functions.money import btc, btc_days, satoshi_days


def ladder(value: Column, steps: list[tuple[int, str]], otherwise: str) -> Column:
    """The label of the first step that the value reaches; steps run downwards."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(value >= least, label)
    return out.otherwise(otherwise)


def _event(df: DataFrame, name: str, severity: Column, *fields: Column, txid=None, block=None, height=None, title=None) -> DataFrame:
    null = F.lit(None).cast("string")
    key = event_key(F.lit(name), txid if txid is not None else null, block if block is not None else null, height if height is not None else null, title if title is not None else null)
    carried = ["context"] if "context" in df.columns else []
    return df.select(F.lit(name).alias("event_type"), key.alias("event_key"), severity.alias("severity"), *fields, *carried).withColumn("event_id", uuid5(F.col("event_key")))


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a feed may leave out."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def _rate(tx: DataFrame) -> Column:
    """The fee rate as observed, else from fee and virtual size; null without a size."""
    own = F.when(F.col("vsize") > 0, F.col("fee_sats").cast("double") / F.col("vsize"))
    return F.coalesce(F.col("fee_rate_sat_vb"), own) if "fee_rate_sat_vb" in tx.columns else own


def large_transfer(tx: DataFrame, least: int, high: int, critical: int) -> DataFrame:
    total = F.col("total_output_sats")
    return _event(
        tx.filter(total >= least), "LargeTransfer", ladder(total, [(critical, "CRITICAL"), (high, "HIGH")], "MEDIUM"),
        total, btc(total).alias("total_output_btc"), F.col("fee_sats"), _or_null(tx, "fee_rate_sat_vb", "double"), F.col("vsize"), F.col("input_count").alias("inputs_count"),
        F.col("output_count").alias("outputs_count"), txid=F.col("txid"),
    )


def long_interval(blocks: DataFrame, least: int, high: int, critical: int) -> DataFrame:
    gap = F.col("interval_seconds")
    return _event(
        blocks.filter(gap >= least), "LongBlockInterval", ladder(gap, [(critical, "CRITICAL"), (high, "HIGH")], "MEDIUM"),
        F.col("height"), gap, F.floor(gap / 60).cast("bigint").alias("interval_minutes"), _or_null(blocks, "tx_count", "bigint"), _or_null(blocks, "miner_tag", "string"),
        _or_null(blocks, "size_bytes", "bigint"), block=F.col("block_hash"),
    )


#: Fixed values: (class, least BTC for CRITICAL, HIGH, MEDIUM), then what is below.
DORMANT_SEVERITY = {
    "EARLY_BITCOIN": ((50, "CRITICAL"), (1, "HIGH")),
    "ANCIENT": ((100, "CRITICAL"), (10, "HIGH")),
    "VERY_OLD": ((200, "CRITICAL"), (50, "HIGH"), (5, "MEDIUM")),
    "DORMANT": ((500, "CRITICAL"), (100, "HIGH"), (10, "MEDIUM")),
}
DORMANT_BELOW = {"EARLY_BITCOIN": "MEDIUM", "ANCIENT": "MEDIUM", "VERY_OLD": "LOW", "DORMANT": "LOW"}


def dormant_coins(inputs: DataFrame, least_days: int, least_sats: int, unit: int, early_before: str = "2011-01-01", early_height: int = 100_000) -> DataFrame:
    """Transactions that spend outputs of at least least_days. unit: satoshis of one coin in the severity table.

    Inputs: txid, ts, block_height, confirmed_at, confirmed_height, value_sats and, the same in all rows of a transaction,
    input_count, total_input_sats, total_output_sats. Ages are whole days of each input: of its confirmation's time, else
    of 600 seconds a block since its confirmation's height, else 0. The class is that of the oldest input.
    """
    by_time = F.greatest(F.lit(0).cast("bigint"), F.expr("timestampdiff(SECOND, confirmed_at, ts)"))
    by_height = F.greatest(F.lit(0).cast("bigint"), (F.col("block_height") - F.col("confirmed_height")) * 600)
    aged = inputs.withColumn("age", F.when(F.col("confirmed_at").isNotNull(), by_time).otherwise(F.coalesce(by_height, F.lit(0).cast("bigint"))))
    old = aged.withColumn("age_days", F.floor(F.col("age") / 86_400).cast("bigint")).filter(F.col("age_days") >= least_days)
    per_tx = old.groupBy("txid").agg(
        F.count(F.lit(1)).alias("dormant_input_count"),
        F.sum("value_sats").alias("total_dormant_sats"),
        F.sum(satoshi_days(F.col("value_sats"), F.col("age_days"))).cast("decimal(38,0)").alias("coin_age_destroyed_sats_days"),
        F.max(F.struct("age", "confirmed_at", "confirmed_height")).alias("oldest"),
        F.min("age_days").alias("youngest_qualifying_age_days"),
        *[F.max(c).alias(c) for c in ("input_count", "total_input_sats", "total_output_sats")],
        *([F.max("context").alias("context")] if "context" in inputs.columns else []),
    )
    days = F.floor(F.col("oldest.age") / 86_400).cast("bigint")
    early = F.coalesce(F.col("oldest.confirmed_height") <= early_height, F.lit(False)) | F.coalesce(F.col("oldest.confirmed_at") < F.lit(early_before).cast("timestamp_ntz"), F.lit(False))
    label = F.when(early, "EARLY_BITCOIN").when(days >= 5475, "ANCIENT").when(days >= 3650, "VERY_OLD").otherwise("DORMANT")
    found = per_tx.filter(F.col("total_dormant_sats") >= least_sats).withColumn("classification", label)
    severity = None
    for name, steps in DORMANT_SEVERITY.items():
        one = ladder(F.col("total_dormant_sats"), [(n * unit, s) for n, s in steps], DORMANT_BELOW[name])
        severity = F.when(F.col("classification") == name, one) if severity is None else severity.when(F.col("classification") == name, one)
    total, destroyed = F.col("total_dormant_sats"), F.col("coin_age_destroyed_sats_days")
    return _event(
        found, "DormantCoinsMoved", severity, total, btc(total).alias("total_dormant_btc"), F.col("dormant_input_count"), F.col("input_count").alias("total_input_count"),
        days.alias("oldest_input_age_days"), F.col("oldest.age").alias("oldest_input_age_seconds"), F.col("youngest_qualifying_age_days"), F.col("total_input_sats"), F.col("total_output_sats"),
        F.when(F.col("total_input_sats") > 0, total.cast("double") / F.col("total_input_sats")).otherwise(1.0).alias("dormant_ratio"), destroyed,
        btc_days(destroyed).alias("coin_age_destroyed_btc_days"), (btc_days(destroyed) / 365.25).alias("coin_age_destroyed_btc_years"), F.col("classification"), txid=F.col("txid"),
    )


def consolidation(tx: DataFrame, least_inputs: int, most_outputs: int, many: int, some: int, high_value: int, least_sats: int = 0) -> DataFrame:
    n, m, total = F.col("input_count"), F.col("output_count"), F.col("total_input_sats")
    severity = F.when((n >= many) | (total >= high_value), "HIGH").when(n >= some, "MEDIUM").otherwise("LOW")
    found = tx.filter((n >= least_inputs) & (m <= most_outputs) & (total >= least_sats))
    return _event(found, "Consolidation", severity, n, m, (n.cast("double") / F.greatest(m, F.lit(1))).alias("input_output_ratio"), total, F.col("total_output_sats"), F.col("fee_sats"), txid=F.col("txid"))


def fan_out(tx: DataFrame, least_outputs: int, many: int, some: int, high_value: int, least_sats: int = 0) -> DataFrame:
    """Output statistics come from the sorted ``outputs`` array; without one, each is the mean."""
    n, total, outs = F.col("output_count"), F.col("total_output_sats"), F.col("outputs")
    mean = F.floor(total / F.greatest(n, F.lit(1))).cast("bigint")
    size = F.size(outs)
    at = lambda i: F.element_at(outs, i.cast("int"))
    middle = F.when(size % 2 == 1, at(F.floor(size / 2) + 1)).otherwise(F.floor((at(F.floor(size / 2)) + at(F.floor(size / 2) + 1)) / 2).cast("bigint"))
    has = F.coalesce(size, F.lit(0)) > 0
    severity = F.when((n >= many) | (total >= high_value), "HIGH").when(n >= some, "MEDIUM").otherwise("LOW")
    found = tx.filter((n >= least_outputs) & (total >= least_sats))
    return _event(
        found, "FanOut", severity, F.col("input_count"), n, (n.cast("double") / F.greatest(F.col("input_count"), F.lit(1))).alias("output_input_ratio"), total.alias("total_distributed_sats"),
        btc(total).alias("total_distributed_btc"), F.when(has, middle).otherwise(mean).alias("median_output_sats"), F.when(has, at(F.lit(1))).otherwise(mean).alias("smallest_output_sats"),
        F.when(has, at(size)).otherwise(mean).alias("largest_output_sats"), txid=F.col("txid"),
    )


def extreme_fee(tx: DataFrame, least_fee: int, least_rate: float, fees: tuple[int, int], rates: tuple[float, float]) -> DataFrame:
    fee, rate = F.col("fee_sats"), F.coalesce("rate", F.lit(0.0))
    by_fee, by_rate = fee >= least_fee, rate >= least_rate
    severity = F.when((fee >= fees[0]) | (rate >= rates[0]), "CRITICAL").when((fee >= fees[1]) | (rate >= rates[1]), "HIGH").otherwise("MEDIUM")
    trigger = F.when(by_fee & by_rate, "BOTH").when(by_fee, "HIGH_ABSOLUTE_FEE").otherwise("HIGH_FEE_RATE")
    found = tx.withColumn("rate", _rate(tx)).filter(by_fee | by_rate)
    return _event(
        found, "ExtremeFee", severity, fee, btc(fee).alias("fee_btc"), F.col("rate").alias("fee_rate_sat_vb"), F.col("vsize"), F.col("total_input_sats"), F.col("total_output_sats"),
        trigger.alias("fee_trigger_type"), txid=F.col("txid"),
    )


def replacement(replacements: DataFrame, high_delta: int, some_delta: int) -> DataFrame:
    n, delta, old = F.size("replaced_txids"), F.col("new_fee_sats") - F.col("old_fee_sats"), F.col("old_fee_sats")
    severity = F.when((delta >= high_delta) | (n >= 5), "HIGH").when((delta >= some_delta) | (n >= 2), "MEDIUM").otherwise("LOW")
    found = replacements.filter((F.col("replacement_txid") != "") & (n > 0))
    return _event(
        found, "TransactionReplacement", severity, F.col("replaced_txids"), F.col("replacement_txid"), n.cast("bigint").alias("replaced_count"), old, F.col("new_fee_sats"), delta.alias("fee_delta_sats"),
        F.when(old > 0, delta.cast("double") / old * 100.0).alias("fee_increase_percent"), _or_null(found, "old_fee_rate_sat_vb", "double"), _or_null(found, "new_fee_rate_sat_vb", "double"), txid=F.col("replacement_txid"),
    )


def reorg(reorgs: DataFrame) -> DataFrame:
    """The tips, their heights and ancestor, and the blocks on either side, as far as the observation has them."""
    fields = [("old_tip_hash", "old_tip", "string"), ("old_tip_height", "old_tip_height", "bigint"), ("new_tip_hash", "new_tip", "string"), ("new_tip_height", "new_tip_height", "bigint"), ("common_ancestor_hash", "common_ancestor", "string")]
    lists = [_or_null(reorgs, c, "array<string>") for c in ("disconnected_blocks", "connected_blocks")]
    own = [_or_null(reorgs, c, kind).alias(name) for c, name, kind in fields]
    return _event(reorgs, "ReorgDetected", ladder(F.col("depth"), [(6, "CRITICAL"), (3, "HIGH"), (2, "MEDIUM")], "LOW"), *own, F.col("depth"), *lists, _or_null(reorgs, "observed_at", "timestamp_ntz"), block=F.col("new_tip_hash"))


#: Fields of the observation that a detector's input may carry along in a struct column named context.
CONTEXT = "struct<txid: string, block_hash: string, block_height: bigint, event_time: timestamp>"
#: detectors' names and the event types they are stored under.
STORED_TYPES = {
    "LargeTransfer": "LARGE_TRANSFER", "LongBlockInterval": "LONG_BLOCK_INTERVAL", "DormantCoinsMoved": "DORMANT_COINS_MOVED", "Consolidation": "CONSOLIDATION",
    "FanOut": "FAN_OUT", "ExtremeFee": "EXTREME_FEE", "TransactionReplacement": "TRANSACTION_REPLACEMENT", "ReorgDetected": "REORG_DETECTED",
}


def canonical(found: DataFrame, network: str = "mainnet", fields: Collection[str] | None = None) -> DataFrame:
    """Events as they are stored: the detector's own fields as JSON metadata, the context as columns.

    With ``fields`` the metadata holds only those of them, so what the others are made from need not be read.
    """
    own = [c for c in found.columns if c not in ("event_type", "event_key", "event_id", "severity", "context") and (fields is None or c in fields)]
    kind = F.create_map(*[F.lit(x) for pair in STORED_TYPES.items() for x in pair])[F.col("event_type")]
    context = F.col("context").cast(CONTEXT) if "context" in found.columns else F.lit(None).cast(CONTEXT)
    rows = found.withColumn("context", context)
    return rows.select(
        F.col("event_id").alias("id"), kind.alias("event_type"), "severity", F.lit("VERIFIED_ON_CHAIN").alias("confidence"), F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" "))).alias("title"),
        F.col("context.event_time").alias("event_time"), F.col("context.block_height").alias("block_height"), F.col("context.block_hash").alias("block_hash"), F.col("context.txid").alias("txid"),
        F.lit(network).alias("network"), F.to_json(F.struct(*own)).alias("metadata"),
    )


#: Detectors that history cannot replay: their observations exist only live.
LIVE_ONLY = ("replacement", "reorg")


def run_all(found: dict[str, DataFrame], mode: str = "live") -> DataFrame:
    """The union of detectors' events, without the live-only ones in replay."""
    out = None
    for name, df in found.items():
        if mode == "historical_replay" and name in LIVE_ONLY:
            continue
        one = df.select("event_type", "event_key", "event_id", "severity")
        out = one if out is None else out.unionByName(one)
    return out
