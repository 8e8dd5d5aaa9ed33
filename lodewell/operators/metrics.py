"""The metric registry, extraction from event metadata into long form, and scaled values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (event type, metric, unit, scale, primary, lower is rarer, metadata keys in order of preference, weight).
REGISTRY = [
    ("LARGE_TRANSFER", "value_sats", "satoshis", 0, True, False, ("total_output_sats", "value_sats"), 60.0),
    ("LARGE_TRANSFER", "input_count", "count", 0, False, False, ("inputs_count", "input_count"), 15.0),
    ("LARGE_TRANSFER", "output_count", "count", 0, False, False, ("outputs_count", "output_count"), 15.0),
    ("LARGE_TRANSFER", "vsize", "count", 0, False, False, ("vsize",), 10.0),
    ("DORMANT_COINS_MOVED", "dormant_value_sats", "satoshis", 0, True, False, ("total_dormant_sats", "dormant_value_sats"), 35.0),
    ("DORMANT_COINS_MOVED", "oldest_input_age_days", "days", 0, False, False, ("oldest_input_age_days",), 30.0),
    ("DORMANT_COINS_MOVED", "coin_age_destroyed_satoshi_days", "satoshi_days", 0, False, False, ("coin_age_destroyed_sats_days", "coin_age_destroyed_satoshi_days"), 25.0),
    ("DORMANT_COINS_MOVED", "input_count", "count", 0, False, False, ("dormant_input_count", "input_count"), 10.0),
    ("CONSOLIDATION", "input_count", "count", 0, True, False, ("input_count",), 40.0),
    ("CONSOLIDATION", "output_count", "count", 0, False, True, ("output_count",), 10.0),
    ("CONSOLIDATION", "value_sats", "satoshis", 0, False, False, ("total_input_sats", "value_sats"), 20.0),
    ("CONSOLIDATION", "consolidation_ratio", "ratio", 2, False, False, ("input_output_ratio",), 30.0),
    ("FAN_OUT", "output_count", "count", 0, True, False, ("output_count",), 40.0),
    ("FAN_OUT", "distributed_value_sats", "satoshis", 0, False, False, ("total_distributed_sats",), 35.0),
    ("FAN_OUT", "median_output_sats", "satoshis", 0, False, False, ("median_output_sats",), 25.0),
    ("EXTREME_FEE", "fee_rate_sat_vb", "sat_vb", 2, True, False, ("fee_rate_sat_vb",), 60.0),
    ("EXTREME_FEE", "fee_sats", "satoshis", 0, False, False, ("fee_sats",), 40.0),
    ("LONG_BLOCK_INTERVAL", "interval_seconds", "seconds", 0, True, False, ("interval_seconds",), 100.0),
]


def fields_of(event_type: str) -> set[str]:
    """The metadata keys that the metrics of an event type read."""
    return {k for kind, *_, keys, _ in REGISTRY if kind == event_type for k in keys}


def extract(events: DataFrame) -> DataFrame:
    """Long-form metrics of events (id, event_type, network, block_height, metadata JSON): one scan, one explode.

    Scaled metrics are rounded half up to hundredths; a missing height is 0 and a missing network is mainnet.
    """
    found = []
    for kind, metric, _, scale, *_, keys, _ in REGISTRY:
        raw = F.when(F.col("event_type") == kind, F.coalesce(*[F.get_json_object("metadata", f"$.{k}") for k in keys]))
        number = F.round(raw.try_cast("double") * 100).cast("decimal(38,0)") if scale else raw.try_cast("decimal(38,0)")
        found.append(F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), number.alias("value"), F.lit(scale).alias("scale")))
    own = F.filter(F.array(*found), lambda m: (m["kind"] == F.col("event_type")) & m["value"].isNotNull())
    rows = events.select("id", "event_type", F.coalesce("network", F.lit("mainnet")).alias("network"), F.coalesce("block_height", F.lit(0)).alias("block_height"), F.explode(own).alias("m"))
    return rows.select("id", "event_type", "network", "block_height", F.col("m.metric").alias("metric"), F.concat("m.metric", F.lit("-v1")).alias("metric_definition_version"), F.col("m.value").alias("value"), F.col("m.scale").alias("scale"))


def numeric_text(value: Column, scale: Column) -> Column:
    """A scaled integer written as a decimal number."""
    text = F.lpad(value.cast("string"), F.greatest(F.length(value.cast("string")), scale + 1), "0")
    whole = F.substring(text, F.lit(1), F.length(text) - scale)
    return F.when(scale == 0, value.cast("string")).otherwise(F.concat(whole, F.lit("."), F.right(text, scale)))


def value_of_text(text: Column, scale: Column) -> Column:
    """The scaled integer that ``numeric_text`` writes so; null for what is no number or has more decimals than scale."""
    t = F.trim(text)
    whole, frac = F.regexp_extract(t, r"^(-?[0-9]+)(?:\.[0-9]*)?$", 1), F.regexp_extract(t, r"^-?[0-9]+\.([0-9]*)$", 1)
    fits = (whole != "") & (F.length(frac) <= scale)
    return F.when(fits, F.concat(whole, F.rpad(frac, scale, "0")).try_cast("decimal(38,0)"))


def latest_run(runs: DataFrame, network: str, height: int, version: str) -> DataFrame:
    """The newest completed run of a network and version that begins at or below a height."""
    fit = (F.col("network") == network) & (F.col("status") == "COMPLETED") & (F.col("start_height") <= height) & (F.col("algorithm_version") == version)
    return runs.filter(fit).orderBy(F.desc("end_height"), F.desc("completed_at")).limit(1)


def evaluation_mode(height: Column, run_end: Column) -> Column:
    return F.when(height.isNull() | (height <= run_end), "RETROSPECTIVE").otherwise("POINT_IN_TIME")
