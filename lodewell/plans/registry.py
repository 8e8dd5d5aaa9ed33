"""Registered queries over the surrogate views, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.functions import money
from lodewell.functions.identity import discriminator, observation_key, uuid5
from lodewell.functions.lineage import cut
from lodewell.operators import baseline, chain, detectors, incidents, metrics, provenance, replay, watch
from lodewell.plans import surrogate as views
from lodewell.plans.surrogate import table, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def uuid_sql(key: str) -> str:
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({key}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


# -- detectors ------------------------------------------------------------------------------------------------------

LARGE = (40_000_000, 50_000_000, 60_000_000)


def _tx(spark, d):
    return views.tx(spark, d).withColumn("fee_rate_sat_vb", F.col("fee_sats").cast("double") / F.col("vsize"))


def _large(spark, d):
    return detectors.large_transfer(_tx(spark, d), *LARGE)


@query(with_views("tx", then=f"""
SELECT 'LargeTransfer' AS event_type, 'LargeTransfer:tx:' || txid AS event_key, {uuid_sql("'LargeTransfer:tx:' || txid")} AS event_id,
  CASE WHEN total_output_sats >= 60000000 THEN 'CRITICAL' WHEN total_output_sats >= 50000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  total_output_sats, total_output_sats::DOUBLE / 100000000 AS total_output_btc, fee_sats, fee_sats::DOUBLE / vsize AS fee_rate_sat_vb, vsize, input_count AS inputs_count, output_count AS outputs_count
FROM tx WHERE total_output_sats >= 40000000"""))  # fmt: skip
def det_large_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _large(spark, d)


def _interval(spark, d):
    return detectors.long_interval(chain.block_intervals(views.blocks(spark, d), per="chain"), 20_000, 40_000, 60_000)


@query(with_views("blocks", then=f"""
SELECT 'LongBlockInterval' AS event_type, 'LongBlockInterval:block:' || block_hash AS event_key, {uuid_sql("'LongBlockInterval:block:' || block_hash")} AS event_id,
  CASE WHEN gap >= 60000 THEN 'CRITICAL' WHEN gap >= 40000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, height, gap AS interval_seconds, gap // 60 AS interval_minutes, tx_count, miner_tag, size_bytes
FROM spaced WHERE gap >= 20000"""))  # fmt: skip
def det_long_interval(spark: SparkSession, d: str) -> DataFrame:
    return _interval(spark, d)


def _dormant(spark, d):
    return detectors.dormant_coins(views.inputs(spark, d), 1825, 5_000_000, 100_000)


DORMANT_SQL = """aged AS (
  SELECT *, CASE WHEN confirmed_at IS NOT NULL THEN greatest(0, date_diff('microsecond', confirmed_at, ts) // 1000000) ELSE greatest(0, (block_height - confirmed_height) * 600) END AS secs FROM inputs),
totals AS (SELECT txid, count(*) AS n_inputs, sum(value_sats)::BIGINT AS total_in FROM inputs GROUP BY txid),
old AS (
  SELECT txid, count(*) AS n, sum(value_sats)::BIGINT AS v, sum(value_sats::HUGEINT * (secs // 86400)) AS sd, max(secs) AS oldest_secs, max(secs) // 86400 AS oldest, min(secs // 86400) AS youngest,
    arg_max(confirmed_at, (secs, coalesce(confirmed_at, TIMESTAMP '1900-01-01'), coalesce(confirmed_height, -1))) AS conf_at, arg_max(coalesce(confirmed_height, 1000000), (secs, coalesce(confirmed_at, TIMESTAMP '1900-01-01'), coalesce(confirmed_height, -1))) AS h
  FROM aged WHERE secs // 86400 >= 1825 GROUP BY txid HAVING sum(value_sats) >= 5000000),
graded AS (
  SELECT *, CASE WHEN h <= 100000 OR conf_at < TIMESTAMP '2011-01-01' THEN 'EARLY_BITCOIN' WHEN oldest >= 5475 THEN 'ANCIENT' WHEN oldest >= 3650 THEN 'VERY_OLD' ELSE 'DORMANT' END AS class FROM old JOIN totals USING (txid))"""


@query(with_views("inputs", then=", " + DORMANT_SQL + f"""
SELECT 'DormantCoinsMoved' AS event_type, 'DormantCoinsMoved:tx:' || txid AS event_key, {uuid_sql("'DormantCoinsMoved:tx:' || txid")} AS event_id,
  CASE class WHEN 'EARLY_BITCOIN' THEN CASE WHEN v >= 5000000 THEN 'CRITICAL' WHEN v >= 100000 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN 'ANCIENT' THEN CASE WHEN v >= 10000000 THEN 'CRITICAL' WHEN v >= 1000000 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN 'VERY_OLD' THEN CASE WHEN v >= 20000000 THEN 'CRITICAL' WHEN v >= 5000000 THEN 'HIGH' WHEN v >= 500000 THEN 'MEDIUM' ELSE 'LOW' END
    ELSE CASE WHEN v >= 50000000 THEN 'CRITICAL' WHEN v >= 10000000 THEN 'HIGH' WHEN v >= 1000000 THEN 'MEDIUM' ELSE 'LOW' END END AS severity,
  class AS classification, n AS dormant_input_count, v AS total_dormant_sats, v::DOUBLE / 100000000 AS total_dormant_btc, n_inputs AS total_input_count, oldest AS oldest_input_age_days, oldest_secs AS oldest_input_age_seconds,
  youngest AS youngest_qualifying_age_days, total_in AS total_input_sats, total_in - 1000 AS total_output_sats, CASE WHEN total_in > 0 THEN v::DOUBLE / total_in ELSE 1.0 END AS dormant_ratio,
  sd::VARCHAR AS coin_age_destroyed_sats_days, round(sd::DOUBLE / 100000000, 6) AS coin_age_destroyed_btc_days, round(sd::DOUBLE / 100000000 / 365.25::DOUBLE, 6) AS coin_age_destroyed_btc_years FROM graded""").replace("\n, aged", ",\naged"))  # fmt: skip
def det_dormant_coins(spark: SparkSession, d: str) -> DataFrame:
    found, years = _dormant(spark, d), ("coin_age_destroyed_btc_days", "coin_age_destroyed_btc_years")
    return found.withColumns({"coin_age_destroyed_sats_days": F.col("coin_age_destroyed_sats_days").cast("string"), **{c: F.round(c, 6) for c in years}})


def _consolidation(spark, d):
    return detectors.consolidation(views.sweep(spark, d), 12, 5, 18, 15, 100_000_000)


@query(with_views("sweep", then=f"""
SELECT 'Consolidation' AS event_type, 'Consolidation:tx:' || txid AS event_key, {uuid_sql("'Consolidation:tx:' || txid")} AS event_id,
  CASE WHEN input_count >= 18 OR total_input_sats >= 100000000 THEN 'HIGH' WHEN input_count >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  input_count, output_count, total_input_sats, total_output_sats, fee_sats, input_count::DOUBLE / greatest(output_count, 1) AS input_output_ratio FROM sweep WHERE input_count >= 12 AND output_count <= 5"""))  # fmt: skip
def det_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return _consolidation(spark, d)


FAN_OUT = (8, 12, 10, 60_000_000)


def _fan_out(spark, d):
    return detectors.fan_out(views.tx(spark, d), *FAN_OUT)


@query(with_views("tx", then=f"""
SELECT 'FanOut' AS event_type, 'FanOut:tx:' || txid AS event_key, {uuid_sql("'FanOut:tx:' || txid")} AS event_id,
  CASE WHEN output_count >= 12 OR total_output_sats >= 60000000 THEN 'HIGH' WHEN output_count >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  input_count, output_count, output_count::DOUBLE / greatest(input_count, 1) AS output_input_ratio, total_output_sats AS total_distributed_sats, total_output_sats::DOUBLE / 100000000 AS total_distributed_btc,
  outputs[1] AS smallest_output_sats, outputs[-1] AS largest_output_sats,
  CASE WHEN len(outputs) % 2 = 1 THEN outputs[len(outputs) // 2 + 1] ELSE (outputs[len(outputs) // 2] + outputs[len(outputs) // 2 + 1]) // 2 END AS median_output_sats
FROM tx WHERE output_count >= 8"""))  # fmt: skip
def det_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return _fan_out(spark, d)


FEE = (2_000_000, 6_000.0, (5_000_000, 3_000_000), (12_000.0, 9_000.0))


def _fee(spark, d):
    return detectors.extreme_fee(views.tx(spark, d), *FEE)


@query(with_views("tx", then=f"""
, rated AS (SELECT *, fee_sats::DOUBLE / vsize AS rate FROM tx)
SELECT 'ExtremeFee' AS event_type, 'ExtremeFee:tx:' || txid AS event_key, {uuid_sql("'ExtremeFee:tx:' || txid")} AS event_id,
  CASE WHEN fee_sats >= 5000000 OR rate >= 12000 THEN 'CRITICAL' WHEN fee_sats >= 3000000 OR rate >= 9000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  fee_sats, fee_sats::DOUBLE / 100000000 AS fee_btc, rate AS fee_rate_sat_vb, vsize, total_input_sats, total_output_sats,
  CASE WHEN fee_sats >= 2000000 AND rate >= 6000 THEN 'BOTH' WHEN fee_sats >= 2000000 THEN 'HIGH_ABSOLUTE_FEE' ELSE 'HIGH_FEE_RATE' END AS fee_trigger_type
FROM rated WHERE fee_sats >= 2000000 OR rate >= 6000""").replace("\n\n, rated", ",\nrated"))  # fmt: skip
def det_extreme_fee(spark: SparkSession, d: str) -> DataFrame:
    return _fee(spark, d)


def _replacement(spark, d):
    return detectors.replacement(views.replacements(spark, d), 200_000, 100_000)


@query(with_views("replacements", then=f"""
SELECT 'TransactionReplacement' AS event_type, 'TransactionReplacement:tx:' || replacement_txid AS event_key, {uuid_sql("'TransactionReplacement:tx:' || replacement_txid")} AS event_id,
  CASE WHEN new_fee_sats - old_fee_sats >= 200000 THEN 'HIGH' WHEN new_fee_sats - old_fee_sats >= 100000 THEN 'MEDIUM' ELSE 'LOW' END AS severity, old AS replaced_txids, replacement_txid,
  1::BIGINT AS replaced_count, old_fee_sats, new_fee_sats, new_fee_sats - old_fee_sats AS fee_delta_sats, CASE WHEN old_fee_sats > 0 THEN (new_fee_sats - old_fee_sats)::DOUBLE / old_fee_sats * 100.0::DOUBLE END AS fee_increase_percent,
  old_fee_sats / 100.0::DOUBLE AS old_fee_rate_sat_vb, new_fee_sats / 100.0::DOUBLE AS new_fee_rate_sat_vb FROM replacements"""))  # fmt: skip
def det_replacement(spark: SparkSession, d: str) -> DataFrame:
    return _replacement(spark, d).withColumn("replaced_txids", F.array_join("replaced_txids", ","))


def _reorg(spark, d):
    return detectors.reorg(views.reorgs(spark, d))


@query(with_views("reorgs", then=f"""
SELECT 'ReorgDetected' AS event_type, 'ReorgDetected:block:' || new_tip_hash AS event_key, {uuid_sql("'ReorgDetected:block:' || new_tip_hash")} AS event_id,
  CASE WHEN depth > 5 THEN 'CRITICAL' WHEN depth >= 3 THEN 'HIGH' WHEN depth = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, depth, old_tip_hash AS old_tip, old_tip_height, new_tip_hash AS new_tip, new_tip_height,
  common_ancestor_hash AS common_ancestor, array_to_string(disconnected_blocks, ',') AS disconnected_blocks, array_to_string(connected_blocks, ',') AS connected_blocks, observed_at FROM reorgs"""))  # fmt: skip
def det_reorg(spark: SparkSession, d: str) -> DataFrame:
    return _reorg(spark, d).withColumns({c: F.array_join(c, ",") for c in ("disconnected_blocks", "connected_blocks")})


ALL = {"large_transfer": _large, "long_interval": _interval, "dormant": _dormant, "consolidation": _consolidation, "fan_out": _fan_out, "extreme_fee": _fee, "replacement": _replacement, "reorg": _reorg}


def _found(spark, d):
    return {name: f(spark, d) for name, f in ALL.items()}


def _all_sql(names) -> str:
    one = lambda n: f"SELECT event_type, event_key, event_id, severity FROM ({ORACLES['det_' + n]})"
    return "\nUNION ALL\n".join(one(n) for n in names)


@query()
def engine_all_events(spark: SparkSession, d: str) -> DataFrame:
    return detectors.run_all(_found(spark, d))


@query()
def engine_replay_events(spark: SparkSession, d: str) -> DataFrame:
    return detectors.run_all(_found(spark, d), "historical_replay")


_NAMES = ["large_transfer", "long_interval", "dormant_coins", "consolidation", "fan_out", "extreme_fee", "replacement", "reorg"]
ORACLES["engine_all_events"] = _all_sql(_NAMES)
ORACLES["engine_replay_events"] = _all_sql(_NAMES[:-2])


# -- canonical events -----------------------------------------------------------------------------------------------


@query(with_views("canon", then="""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_time, event_id) AS p FROM canon)
SELECT user_id, event_type, max(CASE WHEN p = 1 THEN event_id END) AS first_event_id, max(CASE WHEN p = 1 THEN value END) AS first_value, count(*) AS n_seen,
  array_to_string(list_sort(list(DISTINCT network || '/' || block_height % 4)), ',') AS witnesses FROM ranked GROUP BY user_id, event_type""").replace("\n\n, ranked", ",\nranked"))  # fmt: skip
def dedup_first_with_witnesses(spark: SparkSession, d: str) -> DataFrame:
    events = views.canon(spark, d).withColumn("source", F.concat_ws("/", "network", (F.col("block_height") % 4).cast("string")))
    return provenance.dedup_first(events, ["user_id", "event_type"], ["event_time", "event_id", "value"], "source").drop("first_event_time")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS p FROM events),
walk AS (
  SELECT user_id, event_type, event_id, p, t AS last, TRUE AS fresh FROM e WHERE p = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.p, CASE WHEN e.t - w.last >= 86400 THEN e.t ELSE w.last END, e.t - w.last >= 86400
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.p = w.p + 1)
SELECT user_id, event_type, event_id FROM walk WHERE fresh""")
def dedup_ttl_one_day(spark: SparkSession, d: str) -> DataFrame:
    return provenance.dedup_ttl(table(spark, d, "events"), ["user_id", "event_type"], F.expr("unix_seconds(cast(ts AS timestamp))"), "event_id", 86_400)


def _writes(spark, d):
    c = views.canon(spark, d)
    return c.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "network", "block_height", F.col("event_type").alias("title"), F.col("value").cast("string").alias("metadata"))


@query(with_views("canon", then="""
SELECT user_id::VARCHAR AS id, arg_min(network, event_id) AS network, arg_min(block_height, event_id) AS block_height, arg_max(event_type, event_id) AS title, arg_max(value::VARCHAR, event_id) AS metadata
FROM canon GROUP BY user_id"""))  # fmt: skip
def merge_canonical(spark: SparkSession, d: str) -> DataFrame:
    return provenance.merge_events(_writes(spark, d))


OBS_KEY_SQL = "CASE WHEN observation_mode = 'historical_replay' THEN 'obs:' || id || ':replay:job-' || (user_id % 7) ELSE 'obs:' || id || ':live:core:zmq:' || kind || ':' || disc END"


@query(with_views("canon", then=f"""
, o AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'Confirmed' ELSE 'MempoolSeen' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'block-' || block_height ELSE 'mempool_seq:' || event_id END AS disc FROM canon),
k AS (SELECT *, {OBS_KEY_SQL} AS observation_key FROM o)
SELECT id AS event_id, observation_mode AS mode, kind, observation_key, {uuid_sql("observation_key")} AS observation_id FROM k""").replace("\n\n, o", ",\no"))  # fmt: skip
def observations_live(spark: SparkSession, d: str) -> DataFrame:
    c = views.canon(spark, d)
    confirmed = F.col("event_id") % 2 == 0
    disc = discriminator(F.when(confirmed, F.concat(F.lit("block-"), F.col("block_height").cast("string"))), F.when(~confirmed, F.col("event_id")), F.lit(None).cast("bigint"), F.lit(None).cast("string"))
    job = F.when(F.col("observation_mode") == "historical_replay", F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string")))
    kind = F.when(confirmed, "Confirmed").otherwise("MempoolSeen")
    key = observation_key(F.col("id"), F.col("observation_mode"), job, F.lit("core"), F.lit("zmq"), kind, disc)
    return c.select(F.col("id").alias("event_id"), F.col("observation_mode").alias("mode"), kind.alias("kind"), key.alias("observation_key"), uuid5(key).alias("observation_id"))


@query(with_views("canon", then="SELECT id, event_type, block_height, value FROM canon WHERE block_height BETWEEN 5 AND 20 AND event_type = 'purchase' ORDER BY event_time DESC, id LIMIT 200 OFFSET 10"))
def filter_events(spark: SparkSession, d: str) -> DataFrame:
    return provenance.filter_events(views.canon(spark, d), heights=(5, 20), event_type="purchase", limit=200, offset=10).select("id", "event_type", "block_height", "value")


@query(with_views("canon", then="SELECT id, observation_mode FROM canon WHERE observation_mode = 'historical_replay' OR event_type = 'error'"))
def filter_events_by_mode(spark: SparkSession, d: str) -> DataFrame:
    c = views.canon(spark, d)
    obs = c.filter("event_type = 'error'").select(F.col("id").alias("event_id"), F.lit("historical_replay").alias("mode"))
    return provenance.in_mode(c, obs, "historical_replay").select("id", "observation_mode")


@query(with_views("canon", then="SELECT id, event_type, value FROM canon WHERE event_type <> 'error'"))
def new_events_only(spark: SparkSession, d: str) -> DataFrame:
    c = views.canon(spark, d)
    return provenance.new_rows(c, c.filter("event_type = 'error'"), "id").select("id", "event_type", "value")


@query(with_views("canon", then="SELECT id, value FROM canon ORDER BY event_id DESC LIMIT 1000"))
def retention_newest(spark: SparkSession, d: str) -> DataFrame:
    return provenance.retain(views.canon(spark, d), 1000, "event_id").select("id", "value")


@query(with_views("canon", then="SELECT id, event_type, value FROM canon ORDER BY value DESC, id LIMIT 50 OFFSET 50"))
def topn_pagination(spark: SparkSession, d: str) -> DataFrame:
    return views.canon(spark, d).select("id", "event_type", "value").orderBy(F.desc("value"), "id").offset(50).limit(50)


# -- baselines ------------------------------------------------------------------------------------------------------

LONG_SQL = """, long AS (
  SELECT id, event_type, network, 'value_sats' AS metric, value, block_height FROM canon
  UNION ALL SELECT id, event_type, network, 'height_gap', block_height % 97, block_height FROM canon WHERE event_type <> 'error' OR network = 'main')"""


def _long(spark, d):
    c = views.canon(spark, d)
    gap = F.when((F.col("event_type") != "error") | (F.col("network") == "main"), F.col("block_height") % 97)
    pairs = F.array(F.struct(F.lit("value_sats").alias("metric"), F.col("value")), F.struct(F.lit("height_gap").alias("metric"), gap.cast("bigint").alias("value")))
    # one scan gives both metrics
    return c.select("id", "event_type", "network", "block_height", F.inline(F.filter(pairs, lambda x: x["value"].isNotNull())))


def _metric_views(then: str) -> str:
    return with_views("canon", then=LONG_SQL.lstrip() + "\n" + then).replace("\n, long", ",\nlong")


@query(_metric_views("SELECT id, event_type, network, metric, value, metric || '-v1' AS metric_definition_version FROM long"))
def metric_long_form(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select("id", "event_type", "network", "metric", "value", F.concat("metric", F.lit("-v1")).alias("metric_definition_version"))


@query(_metric_views("""SELECT event_type, metric, count(*) AS sample_count, any_value(c) AS candidate_count, count(*)::DOUBLE / any_value(c) AS coverage_ratio,
  CASE WHEN count(*) >= 500 AND count(*)::DOUBLE / any_value(c) >= 0.95 THEN 'HIGH' WHEN count(*) >= 100 AND count(*)::DOUBLE / any_value(c) >= 0.8 THEN 'MODERATE'
    WHEN count(*) >= 30 AND count(*)::DOUBLE / any_value(c) >= 0.5 THEN 'DEGRADED' ELSE 'INSUFFICIENT' END AS quality
FROM long JOIN (SELECT event_type, count(*) AS c FROM canon GROUP BY 1) USING (event_type) GROUP BY event_type, metric"""))
def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("event_type", "metric", "sample_count", "candidate_count", "coverage_ratio", "quality")


def _distributions(spark, d):
    candidates = views.canon(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("candidate_count"))
    return baseline.distributions(_long(spark, d), candidates, ["event_type", "metric"])


_Q = ", ".join(f"max(CASE WHEN rn = greatest(1, (n * {a} + {b} - 1) // {b}) THEN value END) AS {name}" for name, (a, b) in baseline.QUANTILES.items())
DIST_SQL = f""", ordered AS (
  SELECT *, row_number() OVER (PARTITION BY event_type, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type, metric) AS n FROM long),
dist AS (
  SELECT event_type, metric, any_value(n) AS sample_count, min(value) AS minimum, max(value) AS maximum, sum(value)::DOUBLE / any_value(n) AS mean, {_Q} FROM ordered GROUP BY event_type, metric)"""


@query(_metric_views(DIST_SQL + "\nSELECT event_type, metric, sample_count, minimum, p50, p75, p90, p95, p99, p999, maximum, mean FROM dist"))
def baseline_distributions(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("event_type", "metric", "sample_count", "minimum", "p50", "p75", "p90", "p95", "p99", "p999", "maximum", "mean")


def _rank_sql(at: str, tail: str) -> str:
    return _metric_views(f"""SELECT id, event_type, metric, value, 100.0::DOUBLE * {at} / n AS percentile, {tail} AS tail, n AS population FROM (
  SELECT *, count(*) OVER (PARTITION BY event_type, metric ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le,
    count(*) OVER (PARTITION BY event_type, metric ORDER BY value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ge, count(*) OVER (PARTITION BY event_type, metric) AS n FROM long)""")


_RANK = ("id", "event_type", "metric", "value", "percentile", "tail", "population")


@query(_rank_sql("le", "ge"))
def rank_exact_all(spark: SparkSession, d: str) -> DataFrame:
    return baseline.exact_ranks(_long(spark, d), ["event_type", "metric"]).select(*_RANK)


@query(_rank_sql("ge", "le"))
def rank_exact_lower(spark: SparkSession, d: str) -> DataFrame:
    return baseline.exact_ranks(_long(spark, d), ["event_type", "metric"], lower_is_rarer=True).select(*_RANK)


_POINTS = [(0.0, "minimum"), (50.0, "p50"), (75.0, "p75"), (90.0, "p90"), (95.0, "p95"), (99.0, "p99"), (99.9, "p999"), (100.0, "maximum")]
_CASES = " ".join(
    f"WHEN value <= {v1} THEN CASE WHEN {v1} > {v0} THEN {p0}::DOUBLE + {p1 - p0!r}::DOUBLE * (value - {v0}) / ({v1} - {v0}) ELSE {p1}::DOUBLE END" for (p0, v0), (p1, v1) in zip(_POINTS, _POINTS[1:])
)


@query(_metric_views(DIST_SQL + f""", pct AS (
  SELECT id, event_type, metric, value, minimum, maximum, sample_count, CASE WHEN value <= minimum THEN 0.0::DOUBLE WHEN value >= maximum THEN 100.0::DOUBLE {_CASES} END AS percentile FROM long JOIN dist USING (event_type, metric))
SELECT id, event_type, metric, round(percentile, 6) AS percentile, CASE WHEN value <= minimum THEN sample_count WHEN value >= maximum THEN 1 ELSE greatest(1, ceil((100.0::DOUBLE - percentile) / 100.0::DOUBLE * sample_count)) END::BIGINT AS tail FROM pct"""))
def rank_interpolated(spark: SparkSession, d: str) -> DataFrame:
    joined = _long(spark, d).join(_distributions(spark, d), ["event_type", "metric"])
    pct, tail = baseline.interpolated(F.col("value"), [(p, F.col(v)) for p, v in _POINTS], F.col("sample_count"))
    return joined.select("id", "event_type", "metric", F.round(pct, 6).alias("percentile"), tail.alias("tail"))


@query(_metric_views(DIST_SQL + f""", seen AS (SELECT * FROM long WHERE network = 'test'),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY event_type, metric ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le,
    count(*) OVER (PARTITION BY event_type, metric ORDER BY value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ge, count(*) OVER (PARTITION BY event_type, metric) AS n FROM seen),
least AS (SELECT (count(*) // 5)::BIGINT AS m FROM (SELECT * FROM seen WHERE metric = 'value_sats')),
pct AS (
  SELECT *, CASE WHEN value <= minimum THEN CASE WHEN metric = 'height_gap' THEN 100.0::DOUBLE ELSE 0.0 END WHEN value >= maximum THEN CASE WHEN metric = 'height_gap' THEN 0.0::DOUBLE ELSE 100.0 END {_CASES} END AS ip
  FROM ranked JOIN dist USING (event_type, metric)),
both_ AS (
  SELECT *, CASE WHEN n >= m THEN 'EXACT' WHEN sample_count >= m THEN 'DISTRIBUTION' ELSE 'INSUFFICIENT' END AS method FROM pct, least)
SELECT id, event_type, metric, method, round(CASE method WHEN 'EXACT' THEN 100.0::DOUBLE * CASE WHEN metric = 'height_gap' THEN ge ELSE le END / n WHEN 'DISTRIBUTION' THEN ip END, 6) AS percentile,
  (CASE method WHEN 'EXACT' THEN CASE WHEN metric = 'height_gap' THEN le ELSE ge END WHEN 'DISTRIBUTION' THEN
    CASE WHEN value <= minimum THEN sample_count WHEN value >= maximum THEN 1 ELSE greatest(1, ceil((100.0::DOUBLE - ip) / 100.0::DOUBLE * sample_count)) END END)::BIGINT AS tail,
  CASE WHEN block_height <= 15 THEN 'RETROSPECTIVE' ELSE 'POINT_IN_TIME' END AS evaluation_mode FROM both_"""))
def event_rarity(spark: SparkSession, d: str) -> DataFrame:
    """One network's events against that network where the type has a fifth of its rows, else against all."""
    seen = _long(spark, d).filter("network = 'test'")
    least = seen.filter("metric = 'value_sats'").count() // 5
    found = baseline.event_rarity(seen, _distributions(spark, d), ["event_type", "metric"], F.col("metric") == "height_gap", 15, least)
    return found.select("id", "event_type", "metric", "method", F.round("percentile", 6).alias("percentile"), "tail", "evaluation_mode")


@query(f"""SELECT id, event_type, metric, CASE WHEN population < 100 THEN 'INSUFFICIENT_DATA' WHEN percentile >= 99.9 THEN 'EXTREME' WHEN percentile >= 99 THEN 'RARE' WHEN percentile >= 95 THEN 'UNUSUAL'
  WHEN percentile >= 90 THEN 'NOTABLE' ELSE 'COMMON' END AS band, population // greatest(tail, 1) AS one_in FROM ({_rank_sql("le", "ge")})""")
def rarity_bands(spark: SparkSession, d: str) -> DataFrame:
    r = baseline.exact_ranks(_long(spark, d), ["event_type", "metric"])
    return r.select("id", "event_type", "metric", baseline.band(F.col("percentile"), F.col("population"), 100).alias("band"), baseline.one_in(F.col("population"), F.col("tail")).alias("one_in"))


@query(f"""SELECT id, event_type, count(*)::DOUBLE / 2 AS component_coverage, round(sum(round(CASE WHEN percentile >= 50 THEN w * (percentile - 50) / 50 ELSE 0.0 END, 2)), 2) AS score
FROM ({_rank_sql("le", "ge")}) JOIN (SELECT 'value_sats' AS metric, 60.0::DOUBLE AS w UNION ALL SELECT 'height_gap', 40.0) USING (metric) GROUP BY id, event_type""")
def impact_scores(spark: SparkSession, d: str) -> DataFrame:
    types = [r[0] for r in table(spark, d, "events").select("event_type").distinct().collect()]
    weights = spark.createDataFrame([(t, m, w, 2) for t in types for m, w in (("value_sats", 60.0), ("height_gap", 40.0))], "event_type string, metric string, weight double, components int")
    ranked = baseline.exact_ranks(_long(spark, d), ["event_type", "metric"])
    return baseline.impact(ranked, weights, "id", ["event_type", "metric"], least_population=1).select("id", "event_type", "component_coverage", "score")


@query(with_views("tx", then="SELECT (height * 144) // 210000 AS epoch, count(*) AS n, sum(total_output_sats)::BIGINT AS total_sats, max(fee_sats) AS max_fee_sats FROM tx GROUP BY 1"))
def halving_epoch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return views.tx(spark, d).groupBy(money.halving_epoch(F.col("height") * 144).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_output_sats").alias("total_sats"), F.max("fee_sats").alias("max_fee_sats"))


@query(with_views("canon", then="""SELECT id, event_type, value FROM canon WHERE event_id % 5 = 0 OR (observation_mode = 'historical_replay' AND event_id % 2 = 0)"""))
def filter_events_by_job(spark: SparkSession, d: str) -> DataFrame:
    """Events that a replay job observed, and those that it made."""
    c = views.canon(spark, d)
    events = c.withColumn("replay_job_id", F.when((F.col("observation_mode") == "historical_replay") & (F.col("event_id") % 2 == 0), "job-1"))
    seen = c.filter("event_id % 5 = 0").select(F.col("id").alias("event_id"), F.lit("job-1").alias("replay_job_id"))
    return provenance.in_job(events, seen, "job-1").select("id", "event_type", "value")


# -- watch ----------------------------------------------------------------------------------------------------------

STRENGTH = "CASE classification WHEN 'ON_CHAIN_VERIFIED' THEN 'DIRECT' WHEN 'OFFICIALLY_ATTRIBUTED' THEN 'STRUCTURAL' ELSE 'HEURISTIC' END"
TXID_SQL = "SELECT tx.txid, id AS target_id, 'WATCHED_TRANSACTION_CONFIRMED' AS activity_type, 'DIRECT' AS correlation, total_output_sats AS value_sats FROM tx JOIN targets t ON tx.txid = t.txid AND target_type = 'TRANSACTION'"
POINT_SQL = "SELECT s.txid, id AS target_id, 'WATCHED_OUTPOINT_SPENT' AS activity_type, 'DIRECT' AS correlation, value_sats FROM spends s JOIN targets t ON s.prev_txid = t.txid AND target_type = 'OUTPOINT'"
SPENT_SQL = f"SELECT s.txid, id AS target_id, 'WATCHED_ADDRESS_SPENT' AS activity_type, {STRENGTH} AS correlation, value_sats FROM spends s JOIN targets t ON s.address = t.address WHERE prev_txid IS NOT NULL"
RECEIVED_SQL = f"SELECT s.txid, id AS target_id, 'WATCHED_ADDRESS_RECEIVED' AS activity_type, {STRENGTH} AS correlation, out_sats AS value_sats FROM spends s JOIN targets t ON s.address = t.address"


def _txid(spark, d):
    return watch.by_txid(views.tx(spark, d), views.targets(spark, d), F.col("i.height").isNotNull())


def _inputs(spark, d):
    return views.spends(spark, d).filter("prev_txid IS NOT NULL")


def _outputs(spark, d):
    return views.spends(spark, d).withColumn("value_sats", F.col("out_sats"))


@query(with_views("tx", "targets", then=TXID_SQL))
def watch_txid(spark: SparkSession, d: str) -> DataFrame:
    return _txid(spark, d)


@query(with_views("spends", "targets", then=POINT_SQL))
def watch_outpoint(spark: SparkSession, d: str) -> DataFrame:
    return watch.by_outpoint(_inputs(spark, d), views.targets(spark, d))


@query(with_views("spends", "targets", then=SPENT_SQL))
def watch_address_spent(spark: SparkSession, d: str) -> DataFrame:
    return watch.by_address(_inputs(spark, d), views.targets(spark, d), True)


@query(with_views("spends", "targets", then=RECEIVED_SQL))
def watch_address_received(spark: SparkSession, d: str) -> DataFrame:
    return watch.by_address(_outputs(spark, d), views.targets(spark, d), False)


@query(with_views("spends", then="""SELECT txid, 'script-' || (address::BIGINT % 100) AS target_id, 'WATCHED_SCRIPT_RECEIVED' AS activity_type, 'DIRECT' AS correlation, out_sats AS value_sats
FROM spends"""))
def watch_script(spark: SparkSession, d: str) -> DataFrame:
    outputs = _outputs(spark, d).withColumn("script_hex", F.upper(F.lpad(F.hex(F.col("address").cast("bigint") % 100), 4, "0")))
    scripts = spark.range(100).select(F.concat(F.lit("script-"), F.col("id").cast("string")).alias("id"), F.lit("SCRIPT").alias("target_type"), F.lower(F.lpad(F.hex("id"), 4, "0")).alias("script_hex"), F.lit(True).alias("active"))
    return watch.by_script(outputs, scripts)


@query(with_views("replacements", "targets", then="""SELECT replacement_txid AS txid, coalesce(a.id, b.id) AS target_id FROM replacements r LEFT JOIN targets a ON a.txid = r.replacement_txid AND a.target_type = 'TRANSACTION'
LEFT JOIN targets b ON b.txid = r.old AND b.target_type = 'TRANSACTION' WHERE coalesce(a.id, b.id) IS NOT NULL"""))
def watch_replacement(spark: SparkSession, d: str) -> DataFrame:
    return watch.by_replacement(views.replacements(spark, d), views.targets(spark, d)).select("txid", "target_id")


@query(with_views("tx", "spends", "targets", then=f"""
, act AS ({TXID_SQL} UNION ALL {POINT_SQL} UNION ALL {SPENT_SQL} UNION ALL {RECEIVED_SQL})
SELECT txid, target_id, activity_type, correlation, value_sats, 'case-1:' || activity_type || ':' || txid || ':' || target_id AS dedup_key,
  CASE WHEN activity_type = 'WATCHED_OUTPOINT_SPENT' THEN CASE WHEN value_sats >= 10000000 THEN 'CRITICAL' ELSE 'HIGH' END WHEN correlation = 'HEURISTIC' THEN 'MEDIUM'
    WHEN value_sats >= 10000000 AND correlation = 'DIRECT' THEN 'CRITICAL' WHEN value_sats >= 1000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM act""").replace("\n\n, act", ",\nact"))  # fmt: skip
def watch_all_alerts(spark: SparkSession, d: str) -> DataFrame:
    found = watch_txid(spark, d).unionByName(watch_outpoint(spark, d)).unionByName(watch_address_spent(spark, d)).unionByName(watch_address_received(spark, d))
    key = watch.dedup_key(F.lit("case-1"), F.col("activity_type"), F.col("txid"), F.col("target_id"))
    return found.withColumns({"dedup_key": key, "severity": watch.alert_severity(F.col("activity_type"), F.col("correlation"), F.col("value_sats"), 100_000)})


@query(with_views("spends", then="""
, seeds AS (SELECT txid, txid AS root FROM spends WHERE watched),
one AS (SELECT s.txid, root, 1 AS depth FROM seeds e JOIN spends s ON s.prev_txid = e.txid),
two AS (SELECT s.txid, root, 2 AS depth FROM one e JOIN spends s ON s.prev_txid = e.txid),
three AS (SELECT s.txid, root, 3 AS depth FROM two e JOIN spends s ON s.prev_txid = e.txid)
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""").replace("\n\n, seeds", ",\nseeds"))
def lineage_depth3(spark: SparkSession, d: str) -> DataFrame:
    s = views.spends(spark, d)
    return watch.lineage(s.filter("watched").select("txid", F.col("txid").alias("root")), s.filter("prev_txid IS NOT NULL").select("prev_txid", "txid"))


@query(with_views("spends", then="""
, seeds AS (SELECT txid, 'out-' || prev_txid AS target_id FROM spends s WHERE prev_txid IN (SELECT txid FROM spends WHERE watched)),
one AS (SELECT s.txid, e.txid AS prev_txid, target_id, 1 AS depth, s.value_sats FROM seeds e JOIN spends s ON s.prev_txid = e.txid WHERE e.txid::BIGINT % 10 <> 0),
two AS (SELECT s.txid, e.txid AS prev_txid, target_id, 2 AS depth, s.value_sats FROM one e JOIN spends s ON s.prev_txid = e.txid WHERE e.txid::BIGINT % 10 <> 0),
three AS (SELECT s.txid, e.txid AS prev_txid, target_id, 3 AS depth, s.value_sats FROM two e JOIN spends s ON s.prev_txid = e.txid WHERE e.txid::BIGINT % 10 <> 0)
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""").replace("\n\n, seeds", ",\nseeds"))
def watch_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of orders with a number divisible by ten carry data and are not followed."""
    s = views.spends(spark, d)
    seeds = watch.by_outpoint(s, views.targets(spark, d)).select("txid", "target_id")
    outputs = s.select("txid", F.lit(0).cast("bigint").alias("vout"), (F.col("txid").cast("bigint") % 10 == 0).alias("op_return"))
    return watch.descendants(seeds, outputs, s).drop("prev_vout")


# Stages and positions of activities in SQL; a transaction here has one input and one output.
ENGINE_SQL = f"""
, down AS (
  WITH RECURSIVE seeds AS (SELECT s.txid, id AS target_id FROM spends s JOIN targets t ON s.prev_txid = t.txid AND target_type = 'OUTPOINT'),
  d AS (SELECT txid, target_id, 0 AS depth, NULL::BIGINT AS value_sats FROM seeds
    UNION ALL SELECT s.txid, d.target_id, d.depth + 1, s.value_sats FROM d JOIN spends s ON s.prev_txid = d.txid WHERE d.txid::BIGINT % 10 <> 0 AND d.depth < 3)
  SELECT txid, target_id, min(depth) AS depth, any_value(value_sats) AS value_sats FROM d WHERE depth > 0 GROUP BY txid, target_id),
act AS (
  SELECT *, NULL AS depth, 10 AS stage FROM ({TXID_SQL}) UNION ALL SELECT *, 0, 20 FROM ({POINT_SQL}) UNION ALL SELECT *, NULL, 22 FROM ({SPENT_SQL}) UNION ALL SELECT *, NULL, 31 FROM ({RECEIVED_SQL})
  UNION ALL SELECT txid, target_id, 'NEW_DESCENDANT_OBSERVED', 'STRUCTURAL', value_sats, depth, 21 FROM down),
named AS (
  SELECT act.*, classification AS confidence, 'case-1:' || activity_type || ':' || act.txid || ':' || target_id AS dedup_key,
    array_to_string(list_transform(string_split(lower(activity_type), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS words,
    CASE target_type WHEN 'OUTPOINT' THEN 'OutPoint: ' || targets.txid || ':0' WHEN 'ADDRESS' THEN 'Address: ' || address ELSE 'Tx: ' || targets.txid END AS target,
    CASE WHEN activity_type = 'WATCHED_OUTPOINT_SPENT' THEN CASE WHEN value_sats >= 10000000 THEN 'CRITICAL' ELSE 'HIGH' END WHEN correlation = 'HEURISTIC' THEN 'MEDIUM'
      WHEN value_sats >= 10000000 AND correlation = 'DIRECT' THEN 'CRITICAL' WHEN value_sats >= 1000000 THEN 'HIGH'
      WHEN activity_type = 'NEW_DESCENDANT_OBSERVED' THEN CASE WHEN value_sats >= 500000 THEN 'HIGH' ELSE 'LOW' END ELSE 'MEDIUM' END AS severity
  FROM act JOIN targets ON targets.id = act.target_id)
SELECT txid, target_id, activity_type, correlation, value_sats, depth::INTEGER AS depth, stage::INTEGER AS stage, confidence, severity, dedup_key, '[case-1] ' || words AS title, 'Incident case-1' AS incident_title,
  words || ' in ' || txid || CASE WHEN value_sats IS NULL THEN '' ELSE ', ' || value_sats || ' sats' END || CASE WHEN depth > 0 THEN ', depth ' || depth ELSE '' END || '. Target: ' || target || ' (' || confidence || ', ' || correlation || ')' AS summary,
  row_number() OVER (PARTITION BY txid ORDER BY stage // 10, stage, target_id)::INTEGER AS emitted FROM named""".replace("\n, down", ",\ndown")


@query(with_views("tx", "spends", "targets", then=ENGINE_SQL).replace("\n,\ndown", ",\ndown"))
def watch_engine(spark: SparkSession, d: str) -> DataFrame:
    """Every activity with its place in the order of emission, and the alert made of it."""
    s, targets = views.spends(spark, d), views.targets(spark, d)
    none = F.lit(None).cast("string")
    outputs = s.select("txid", "address", none.alias("script_hex"), F.lit(0).cast("bigint").alias("vout"), F.col("out_sats").alias("value_sats"), (F.col("txid").cast("bigint") % 10 == 0).alias("op_return"))
    found, _ = watch.engine(views.tx(spark, d), _inputs(spark, d).drop("out_sats", "watched"), outputs, targets)
    rows = watch.alerted(watch.described(found, targets, "case-1", btc=100_000))
    order = Window.partitionBy("txid").orderBy(F.floor(F.col("stage") / 10), "position", "stage", "target_id")
    return rows.withColumn("emitted", F.row_number().over(order)).select("txid", "target_id", "activity_type", "correlation", "value_sats", "depth", "stage", "confidence", "severity", "dedup_key", "title", "incident_title", "summary", "emitted")


@query(with_views("blocks", then="""
, came AS (SELECT chain, event_id AS arrival, b.block_hash, height, "timestamp" FROM blocks b JOIN events ON b.block_hash = event_id::VARCHAR)
SELECT chain, arrival, block_hash, CASE WHEN (height > lag(height) OVER w OR block_hash <> lag(block_hash) OVER w) AND date_diff('microsecond', lag("timestamp") OVER w, "timestamp") // 1000000 > 0
  THEN date_diff('microsecond', lag("timestamp") OVER w, "timestamp") // 1000000 END AS interval_seconds FROM came WINDOW w AS (PARTITION BY chain ORDER BY arrival)""").replace("\n\n, came", ",\ncame"))
def block_intervals_arrival(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by arrival (the events' numbers), which is not the order of their times."""
    blocks = views.blocks(spark, d).withColumn("arrival", F.col("block_hash").cast("bigint"))
    return chain.arrival_intervals(blocks, per="chain", run=2_000).select("chain", "arrival", "block_hash", F.col("interval_seconds").cast("bigint").alias("interval_seconds"))


# -- incidents and chain --------------------------------------------------------------------------------------------


def _dossiers(spark, d):
    o = table(spark, d, "orders")
    paid = F.when(F.col("o_orderstatus") == "F", money.cents("o_totalprice")).otherwise(0)
    return o.groupBy(F.col("o_custkey").alias("incident")).agg(F.sum(money.cents("o_totalprice")).alias("affected_sats"), F.sum(paid).alias("recovered_sats"))


DOSSIER_SQL = """dossiers AS (SELECT o_custkey AS incident, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS affected_sats,
  sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS recovered_sats FROM orders GROUP BY 1)"""


@query("WITH " + DOSSIER_SQL + " SELECT incident, affected_sats, recovered_sats, greatest(affected_sats - recovered_sats, 0) AS outstanding_sats, CASE WHEN affected_sats > 0 THEN recovered_sats * 100.0::DOUBLE / affected_sats ELSE 0 END AS recovered_pct FROM dossiers")
def recovery_summary(spark: SparkSession, d: str) -> DataFrame:
    return incidents.recovery(_dossiers(spark, d), "affected_sats", "recovered_sats")


@query("""SELECT o_custkey AS incident, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(CAST(round(o_totalprice * 100) AS BIGINT), (o_orderdate, o_orderkey)) AS recovered_sats FROM orders GROUP BY o_custkey""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("incident"), "o_orderdate", "o_orderkey", money.cents("o_totalprice").alias("recovered_sats"))
    return incidents.latest_snapshot(o, "incident", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT c_custkey AS incident, c_name AS title, coalesce(array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), ','), '') AS evidence
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def incident_dossier(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("incident"), F.col("c_name").alias("title"))
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("incident"), F.col("o_orderkey").alias("order"))
    nested = incidents.nest(parents, children, "incident", ["order"], "evidence")
    return nested.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x["order"].cast("string")), ","))


@query("WITH " + DOSSIER_SQL + """, bent AS (SELECT incident, affected_sats, recovered_sats * 3 AS recovered_sats, affected_sats - recovered_sats AS outstanding_sats, incident % 2 = 0 AS is_estimate FROM dossiers),
nodes AS (SELECT o_custkey AS incident, o_orderpriority AS node FROM orders), edges AS (SELECT o_custkey AS incident, o_orderstatus AS s, o_orderpriority AS t FROM orders),
late AS (SELECT o_custkey AS incident, o_orderkey AS pos, o_orderdate AS due, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS price_before, o_totalprice FROM orders)
SELECT incident, 'recovered_over_affected' AS rule, '' AS detail FROM bent WHERE recovered_sats > affected_sats
UNION ALL SELECT incident, 'outstanding_mismatch', greatest(affected_sats - recovered_sats, 0)::VARCHAR FROM bent WHERE NOT is_estimate AND outstanding_sats <> greatest(affected_sats - recovered_sats, 0)
UNION ALL SELECT DISTINCT incident, 'dangling_edge', s FROM edges WHERE (incident, s) NOT IN (SELECT incident, node FROM nodes)
UNION ALL SELECT incident, 'duplicate_node', node FROM nodes GROUP BY incident, node HAVING count(*) > 1
UNION ALL SELECT o_custkey, 'duplicate_evidence', o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1
UNION ALL SELECT o_custkey, 'self_attributed_identity', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT incident, 'timeline_order', pos::VARCHAR FROM late WHERE due < before
UNION ALL SELECT incident, 'update_order', pos::VARCHAR FROM late WHERE o_totalprice < price_before""")
def incident_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("incident", F.col("o_custkey"))
    bent = _dossiers(spark, d).withColumns({"recovered_sats": F.col("recovered_sats") * 3, "outstanding_sats": F.col("affected_sats") - F.col("recovered_sats"), "is_estimate": F.col("incident") % 2 == 0})
    return incidents.violations(
        bent,
        o.select("incident", F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("target")),
        o.select("incident", F.col("o_orderpriority").alias("node")),
        o.select("incident", F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("at")),
        o.select("incident", F.col("o_orderstatus").alias("id")),
        o.select("incident", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "clerk").alias("attributed_sender"), F.when(F.col("o_orderpriority") == "1-URGENT", "ON_CHAIN_VERIFIED").otherwise("HEURISTIC").alias("confidence")),
        o.select("incident", F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("at")),
    )


@query(with_views("spends", then="""SELECT txid, coalesce(value_sats, -1) AS total_input_sats, value_sats IS NOT NULL AS resolved, CASE WHEN value_sats IS NULL THEN 0 ELSE greatest(0, value_sats - out_sats) END AS fee_sats,
  CASE WHEN value_sats IS NOT NULL THEN greatest(0, value_sats - out_sats)::DOUBLE / 140 END AS fee_rate_sat_vb FROM spends"""))
def utxo_enrich_fee(spark: SparkSession, d: str) -> DataFrame:
    s = views.spends(spark, d)
    outputs = s.select("txid", F.lit(0).cast("bigint").alias("n"), F.col("out_sats").alias("value_sats"), F.lit(None).cast("timestamp_ntz").alias("confirmed_at"), F.lit(None).cast("bigint").alias("confirmed_height"))
    joined = chain.enrich_inputs(s.select("prev_txid", "prev_vout", "txid", "out_sats"), outputs)
    return chain.fees(joined.withColumn("vsize", F.lit(140)), "txid", "out_sats", "vsize").withColumn("total_input_sats", F.coalesce("total_input_sats", F.lit(-1)))


@query(with_views("blocks", then="SELECT chain, height, greatest(0, gap) AS interval_seconds FROM spaced WHERE height > 0"))
def block_intervals_replay(spark: SparkSession, d: str) -> DataFrame:
    out = chain.block_intervals(views.blocks(spark, d), live=False, per="chain")
    return out.filter("height > 0").select("chain", "height", "interval_seconds")


@query("SELECT h AS height FROM (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events))) AS h) WHERE h NOT IN (SELECT event_id FROM events WHERE event_type <> 'error')")
def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0]
    return chain.missing_heights(e.filter("event_type <> 'error'").select(F.col("event_id").alias("height")), 0, last)


def _seqs(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.pmod(F.lit(4294967200) + F.floor(F.col("event_id") / 40) + F.col("event_id") % 3 - F.when(F.col("event_id") % 11 == 0, 9).otherwise(0), F.lit(1 << 32)).alias("seq"))


@query("""
WITH RECURSIVE m AS (
  SELECT user_id, event_id, (4294967200 + event_id // 40 + event_id % 3 - CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END) % 4294967296 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
w AS (
  SELECT user_id, event_id, p, s AS last, 'Initial' AS state, NULL::BIGINT AS missed FROM m WHERE p = 1
  UNION ALL SELECT m.user_id, m.event_id, m.p, CASE WHEN dd = 0 OR dd >= 2147483648 THEN last ELSE m.s END, CASE WHEN dd = 0 THEN 'Duplicate' WHEN dd = 1 THEN 'Consecutive' WHEN dd < 2147483648 THEN 'Gap' ELSE 'Stale' END,
    CASE WHEN dd > 1 AND dd < 2147483648 THEN dd - 1 END FROM (SELECT m.*, w.last, (m.s - w.last + 4294967296) % 4294967296 AS dd FROM w JOIN m ON m.user_id = w.user_id AND m.p = w.p + 1) m)
SELECT user_id, event_id, state, coalesce(missed, 0) AS missed FROM w""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return chain.sequence_states(_seqs(spark, d), "user_id", "event_id", "seq").withColumn("missed", F.coalesce("missed", F.lit(0)))


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, (CASE WHEN event_id >= 1 THEN floor(log2(event_id)) END)::BIGINT AS height FROM events WHERE event_id >= 1),
w AS (
  SELECT o.event_id AS reorg, o.event_id AS a, n.event_id AS b, o.height AS ah, n.height AS bh, 0 AS disconnected, 0 AS connected FROM e o JOIN e n ON n.event_id = o.event_id - 37 WHERE o.event_type = 'error'
  UNION ALL SELECT reorg, CASE WHEN ah >= bh THEN a // 2 ELSE a END, CASE WHEN bh >= ah THEN b // 2 ELSE b END, CASE WHEN ah >= bh THEN ah - 1 ELSE ah END, CASE WHEN bh >= ah THEN bh - 1 ELSE bh END,
    disconnected + (ah >= bh)::INT, connected + (bh >= ah)::INT FROM w WHERE a <> b)
SELECT reorg, a::VARCHAR AS ancestor, ah AS ancestor_height, disconnected, connected FROM w WHERE a = b""")
def reorg_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """A header tree in which every block's parent is its number halved."""
    e = table(spark, d, "events").filter("event_id >= 1").select("event_id", "event_type")
    headers = e.select(F.col("event_id").cast("string").alias("hash"), F.when(F.col("event_id") > 1, F.floor(F.col("event_id") / 2).cast("string")).alias("prev"), F.floor(F.log2("event_id")).cast("bigint").alias("height"))
    tips = e.filter("event_type = 'error' AND event_id > 37").select(F.col("event_id").alias("reorg"), F.col("event_id").cast("string").alias("old_tip"), (F.col("event_id") - 37).cast("string").alias("new_tip"))
    return chain.common_ancestor(headers, tips, 40)


@query("""SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * 1000000 AS sats, CASE WHEN p_partkey % 10 = 0 THEN 'negative' END AS error FROM (SELECT *, p_retailprice FROM part) WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, -1, 'negative' FROM part WHERE p_partkey % 10 = 0""")
def sats_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("%s%d.%02d", F.when(F.col("p_partkey") % 10 == 0, "-").otherwise(""), F.floor(money.cents("p_retailprice") / 100).cast("bigint"), (money.cents("p_retailprice") % 100).cast("bigint"))
    p = table(spark, d, "part").select("p_partkey", text.alias("t"))
    return p.select("p_partkey", F.coalesce(money.btc_to_sats(F.col("t")), F.lit(-1)).alias("sats"), money.parse_error(F.col("t")).alias("error"))


# -- provenance, registry and control -------------------------------------------------------------------------------


@query(with_views("canon", then="SELECT id AS event_id, observation_mode AS mode, block_height FROM canon WHERE event_type <> 'error'"))
def observations_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = views.canon(spark, d)
    return provenance.backfill(c, c.filter("event_type = 'error'").select(F.col("id").alias("event_id"))).drop("observed_at")


@query(with_views("canon", then="""SELECT a.id, coalesce(array_to_string(list(b.id ORDER BY b.event_id) FILTER (WHERE b.id IS NOT NULL), ','), '') AS observations
FROM canon a LEFT JOIN canon b ON b.event_id // 10 = a.event_id GROUP BY a.id"""))
def event_with_observations(spark: SparkSession, d: str) -> DataFrame:
    c = views.canon(spark, d)
    obs = c.select(F.floor(F.col("event_id") / 10).cast("string").alias("event_id"), F.col("event_id").alias("n"))
    out = provenance.with_observations(c.select("id"), obs, ["n"])
    return out.select("id", F.coalesce(F.array_join(F.transform("observations", lambda x: x["n"].cast("string")), ","), F.lit("")).alias("observations"))


@query(with_views("canon", then="""SELECT id, 'Witnessed' AS kind, unnest(['core', 'node-' || (user_id % 3)]) AS witness FROM canon WHERE event_type = 'error'
UNION ALL SELECT id, CASE WHEN event_id % 2 = 0 THEN 'Confirmed' ELSE 'MempoolSeen' END, '' FROM canon WHERE event_type <> 'error'"""))
def live_witnesses(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit("core"), F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")))
    c = views.canon(spark, d).withColumns({"witnesses": F.when(F.col("event_type") == "error", names), "block_hash": F.when(F.col("event_id") % 2 == 0, F.col("id"))})
    return provenance.witnesses_of(c).withColumn("witness", F.coalesce("witness", F.lit("")))


@query(with_views("canon", then="SELECT event_type, observation_mode AS mode, count(*) AS n, count(DISTINCT user_id) AS users, max(block_height) AS last_height FROM canon GROUP BY 1, 2"))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.canon(spark, d).groupBy("event_type", F.col("observation_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.max("block_height").alias("last_height"))


@query(with_views("targets", then="""SELECT id, target_type, CASE target_type WHEN 'OUTPOINT' THEN 'OutPoint: ' || txid || ':0' WHEN 'ADDRESS' THEN 'Address: ' || address ELSE 'Tx: ' || txid END AS target_summary, classification, TRUE AS active FROM targets"""))
def watch_public_targets(spark: SparkSession, d: str) -> DataFrame:
    return watch.public_targets(views.targets(spark, d))


CLASSES = ("ON_CHAIN_VERIFIED", "OFFICIALLY_ATTRIBUTED", "HIGH_CONFIDENCE", "REPORTED", "HEURISTIC", "UNVERIFIED")


@query("""WITH c AS (SELECT o_orderkey AS claim, ['ownership', 'fact', 'sender'][o_orderkey % 3 + 1] AS kind, o_orderkey % 2 = 0 AS self,
  ['ON_CHAIN_VERIFIED', 'OFFICIALLY_ATTRIBUTED', 'HIGH_CONFIDENCE', 'REPORTED', 'HEURISTIC', 'UNVERIFIED'][o_custkey % 6 + 1] AS class FROM orders)
SELECT claim, CASE WHEN kind = 'ownership' AND class NOT IN ('ON_CHAIN_VERIFIED', 'OFFICIALLY_ATTRIBUTED') THEN 'ownership_not_definitive' WHEN kind = 'fact' AND class <> 'ON_CHAIN_VERIFIED' THEN 'fact_without_chain_backing'
  WHEN kind = 'sender' AND self AND class = 'ON_CHAIN_VERIFIED' THEN 'self_attributed_identity' ELSE '' END AS violation FROM c""")
def incident_claims(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    claims = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim"), pick(("ownership", "fact", "sender"), F.col("o_orderkey") % 3).alias("kind"), (F.col("o_orderkey") % 2 == 0).alias("self_attributed"), pick(CLASSES, F.col("o_custkey") % 6).alias("classification")
    )
    return incidents.claim_errors(claims).select("claim", F.coalesce("violation", F.lit("")).alias("violation"))


@query("SELECT o_custkey AS node, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY o_custkey")
def graph_first_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("label"))
    return incidents.first_nodes(nodes, "node", "pos")


#: The registry's metrics of the detectors' events, as (event type, query, metric, SQL of the value, by height or null).
_EXTRACTED = [
    ("LARGE_TRANSFER", "large_transfer", {"value_sats": "total_output_sats", "input_count": "inputs_count", "output_count": "outputs_count", "vsize": "vsize"}),
    ("DORMANT_COINS_MOVED", "dormant_coins", {"dormant_value_sats": "total_dormant_sats", "oldest_input_age_days": "oldest_input_age_days", "coin_age_destroyed_satoshi_days": "coin_age_destroyed_sats_days", "input_count": "dormant_input_count"}),
    ("CONSOLIDATION", "consolidation", {"input_count": "input_count", "output_count": "output_count", "value_sats": "total_input_sats", "consolidation_ratio": "printf('%.2f', floor(input_output_ratio * 100 + 0.5) / 100)"}),
    ("FAN_OUT", "fan_out", {"output_count": "output_count", "distributed_value_sats": "total_distributed_sats", "median_output_sats": "median_output_sats"}),
    ("EXTREME_FEE", "extreme_fee", {"fee_rate_sat_vb": "printf('%.2f', floor(fee_rate_sat_vb * 100 + 0.5) / 100)", "fee_sats": "fee_sats"}),
    ("LONG_BLOCK_INTERVAL", "long_interval", {"interval_seconds": "interval_seconds"}),
]


def _extracted_sql() -> str:
    one = lambda kind, name, metric, value: f"SELECT event_id AS id, '{kind}' AS event_type, 'mainnet' AS network, 0::BIGINT AS block_height, '{metric}' AS metric, '{metric}-v1' AS metric_definition_version, ({value})::VARCHAR AS value_text FROM ({ORACLES['det_' + name]})"
    return "\nUNION ALL\n".join(one(kind, name, metric, value) for kind, name, found in _EXTRACTED for metric, value in found.items())


@query(_extracted_sql())
def metric_extraction(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the stored events of the six types that have any."""
    # the transactions that one of three detectors may take are found in one pass and written, the detectors read them
    rate = F.col("fee_sats").cast("double") / F.col("vsize")
    may = (F.col("total_output_sats") >= LARGE[0]) | (F.col("output_count") >= FAN_OUT[0]) | (F.col("fee_sats") >= FEE[0]) | (rate >= FEE[1])
    tx = cut(views.tx_where(spark, d, may).drop("ts", "height"))
    found = [
        detectors.large_transfer(tx.withColumn("fee_rate_sat_vb", rate), *LARGE), _interval(spark, d), _dormant(spark, d), _consolidation(spark, d), detectors.fan_out(tx, *FAN_OUT), detectors.extreme_fee(tx, *FEE),
    ]
    kinds = ("LARGE_TRANSFER", "LONG_BLOCK_INTERVAL", "DORMANT_COINS_MOVED", "CONSOLIDATION", "FAN_OUT", "EXTREME_FEE")
    out = None
    for kind, events in zip(kinds, found):
        rows = detectors.canonical(events, fields=metrics.fields_of(kind))
        out = rows if out is None else out.unionByName(rows)
    return metrics.extract(out).withColumn("value_text", metrics.numeric_text(F.col("value"), F.col("scale"))).drop("value", "scale")


@query("""SELECT o_orderkey AS run, o_custkey AS end_height FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_custkey - 10 <= 500 ORDER BY o_custkey DESC, o_orderdate DESC, o_orderkey LIMIT 1""")
def latest_compatible_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("run"), F.when(F.col("o_custkey") % 2 == 0, "main").otherwise("test").alias("network"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"),
        (F.col("o_custkey") - 10).alias("start_height"), F.col("o_custkey").alias("end_height"), F.col("o_orderdate").alias("completed_at"), F.lit("v2").alias("algorithm_version"),
    )
    return metrics.latest_run(runs, "main", 500, "v2").select("run", "end_height")


@query(with_views("canon", then="SELECT id, CASE WHEN block_height <= 15 THEN 'RETROSPECTIVE' ELSE 'POINT_IN_TIME' END AS evaluation_mode FROM canon"))
def evaluation_modes(spark: SparkSession, d: str) -> DataFrame:
    return views.canon(spark, d).select("id", metrics.evaluation_mode(F.col("block_height"), F.lit(15)).alias("evaluation_mode"))


@query(with_views("canon", then="SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM canon GROUP BY user_id"))
def upsert_last(spark: SparkSession, d: str) -> DataFrame:
    return provenance.last_by(views.canon(spark, d).select("user_id", "event_id", "value"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query(with_views("tx", then="SELECT txid, height FROM tx WHERE height > 124 AND height <= 400"))
def replay_resume(spark: SparkSession, d: str) -> DataFrame:
    span = replay.ReplayRange(100, 400)
    done = spark.range(1, 2).select((F.col("id") * 24 + 100).alias("completed_height"))
    return replay.remaining(views.tx(spark, d).select("txid", "height"), span, done)


@query(with_views("tx", then="SELECT txid, CASE WHEN height < 100 THEN 0.0 ELSE least(100.0, 100.0::DOUBLE * (height - 100 + 1) / 301) END AS percent FROM tx"))
def replay_progress(spark: SparkSession, d: str) -> DataFrame:
    return views.tx(spark, d).select("txid", money.progress_percent(F.lit(100), F.lit(400), F.col("height")).alias("percent"))
