"""Chain-shaped views over the star-schema tables, each with its SQL twin. Amounts are hundredths; days count from 1995."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.functions.money import cents


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _day(c: str):
    return F.datediff(F.col(c), F.lit("1995-01-01").cast("date")).cast("bigint")


def tx(spark: SparkSession, d: str) -> DataFrame:
    price = cents("l_extendedprice")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("i"), F.sum(price).alias("total"),
        F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("fee"), F.array_sort(F.collect_list(price)).alias("outputs"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("txid"), F.col("o_orderdate").alias("ts"), _day("o_orderdate").alias("height"), zero("i").alias("input_count"), zero("n").alias("output_count"),
        zero("total").alias("total_output_sats"), zero("total").alias("total_input_sats"), zero("fee").alias("fee_sats"), (zero("n") * 40 + 100).alias("vsize"), "outputs",
    )


def tx_where(spark: SparkSession, d: str, where: Column) -> DataFrame:
    """The rows of ``tx`` that meet a condition on output_count, total_output_sats, fee_sats and vsize.

    The lines are shuffled once, and suppliers and outputs are gathered of the transactions found only. The condition must not
    hold for a transaction without lines.
    """
    price, order = cents("l_extendedprice"), Window.partitionBy("l_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", price.alias("price"), cents(F.col("l_extendedprice") * F.col("l_discount")).alias("fee"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    known = lines.withColumns({"output_count": F.count(F.lit(1)).over(order), "total_output_sats": zero(F.sum("price").over(order)), "fee_sats": zero(F.sum("fee").over(order))})
    found = known.withColumn("vsize", F.col("output_count") * 40 + 100).filter(where).groupBy("l_orderkey").agg(
        *[F.first(c).alias(c) for c in ("output_count", "total_output_sats", "fee_sats", "vsize")], F.count_distinct("l_suppkey").alias("input_count"), F.array_sort(F.collect_list("price")).alias("outputs"),
    )
    joined = table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("txid"), F.col("o_orderdate").alias("ts"), _day("o_orderdate").alias("height"), "input_count", "output_count",
        "total_output_sats", F.col("total_output_sats").alias("total_input_sats"), "fee_sats", "vsize", "outputs",
    )


SQL = {}
SQL["tx"] = """li AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS i, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS total,
    sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS fee, list_sort(list(CAST(round(l_extendedprice * 100) AS BIGINT))) AS outputs
  FROM lineitem GROUP BY l_orderkey),
tx AS (
  SELECT o_orderkey::VARCHAR AS txid, o_orderdate AS ts, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS height, coalesce(i, 0)::BIGINT AS input_count,
    coalesce(n, 0)::BIGINT AS output_count, coalesce(total, 0)::BIGINT AS total_output_sats, coalesce(total, 0)::BIGINT AS total_input_sats, coalesce(fee, 0)::BIGINT AS fee_sats, (coalesce(n, 0) * 40 + 100)::BIGINT AS vsize, outputs
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)"""


def sweep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(
        F.count(F.lit(1)).alias("input_count"), F.count_distinct("l_returnflag").alias("output_count"), F.sum(cents("l_extendedprice")).alias("total_input_sats"),
        F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("fee_sats"),
    ).select(F.concat_ws("/", F.col("l_suppkey").cast("string"), "m").alias("txid"), "input_count", "output_count", "total_input_sats", (F.col("total_input_sats") - F.col("fee_sats")).alias("total_output_sats"), "fee_sats")


SQL["sweep"] = """sweep AS (
  SELECT l_suppkey::VARCHAR || '/' || strftime(l_shipdate, '%Y-%m') AS txid, count(*)::BIGINT AS input_count, count(DISTINCT l_returnflag)::BIGINT AS output_count,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS total_input_sats, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS fee_sats,
    total_input_sats - fee_sats AS total_output_sats FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y-%m'))"""


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh order is confirmed by height only; a transaction's totals are those of all its inputs."""
    by_height = F.col("o_orderkey") % 7 == 0
    o = table(spark, d, "orders").select("o_orderkey", F.when(~by_height, F.col("o_orderdate")).alias("confirmed_at"), F.when(by_height, _day("o_orderdate") * 144).alias("confirmed_height"))
    whole = Window.partitionBy("txid")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("txid"), F.col("l_shipdate").alias("ts"), (_day("l_shipdate") * 144).alias("block_height"), "confirmed_at",
        "confirmed_height", cents("l_extendedprice").alias("value_sats"),
    ).withColumns({"input_count": F.count(F.lit(1)).over(whole), "total_input_sats": F.sum("value_sats").over(whole), "total_output_sats": F.sum("value_sats").over(whole) - 1000})


SQL["inputs"] = """inputs AS (
  SELECT l_suppkey::VARCHAR || '/' || strftime(l_shipdate, '%Y-%m-%d') AS txid, l_shipdate AS ts, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS confirmed_at,
    CASE WHEN o_orderkey % 7 = 0 THEN date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 144 END AS confirmed_height, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 144 AS block_height,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS value_sats FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events are a chain of its own: height counts within the user, so no window spans the table."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("chain"), (F.row_number().over(w) - 1).cast("bigint").alias("height"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("block_hash"),
        (F.col("event_id") % 3000).alias("tx_count"), F.concat(F.lit("pool-"), (F.col("event_id") % 5).cast("string")).alias("miner_tag"), (F.col("event_id") * 7 % 4_000_000).alias("size_bytes"),
    )


SQL["blocks"] = """blocks AS (
  SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS height, ts AS "timestamp", event_id::VARCHAR AS block_hash,
    event_id % 3000 AS tx_count, 'pool-' || event_id % 5 AS miner_tag, event_id * 7 % 4000000 AS size_bytes FROM events),
spaced AS (
  SELECT *, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY chain ORDER BY height), "timestamp") // 1000000 AS gap FROM blocks)"""


def replacements(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    fee = F.round("o_totalprice").cast("bigint")
    rows = table(spark, d, "orders").select(F.lag(F.col("o_orderkey").cast("string")).over(w).alias("old"), F.lag(fee).over(w).alias("old_fee_sats"), F.col("o_orderkey").cast("string").alias("replacement_txid"), fee.alias("new_fee_sats"))
    rates = [(F.col(c) / 100.0).alias(c.replace("sats", "rate_sat_vb")) for c in ("old_fee_sats", "new_fee_sats")]
    return rows.filter("old IS NOT NULL").select(F.array("old").alias("replaced_txids"), "replacement_txid", "old_fee_sats", "new_fee_sats", *rates)


SQL["replacements"] = """replacements AS (
  SELECT * FROM (SELECT lag(o_orderkey::VARCHAR) OVER w AS old, lag(CAST(round(o_totalprice) AS BIGINT)) OVER w AS old_fee_sats, o_orderkey::VARCHAR AS replacement_txid,
    CAST(round(o_totalprice) AS BIGINT) AS new_fee_sats FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE old IS NOT NULL)"""


def reorgs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts", (k % 8).alias("depth"))
    side = lambda name, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(name), F.col("event_id").cast("string"), F.lit("-"), i.cast("string")))
    return e.select(
        F.concat(F.lit("old-"), F.col("event_id").cast("string")).alias("old_tip_hash"), F.col("user_id").alias("old_tip_height"), F.col("event_id").cast("string").alias("new_tip_hash"), (F.col("user_id") + 1).alias("new_tip_height"),
        F.concat(F.lit("base-"), F.col("event_id").cast("string")).alias("common_ancestor_hash"), "depth", side("d", F.col("depth") + 1).alias("disconnected_blocks"), side("c", F.col("depth") + 2).alias("connected_blocks"), F.col("ts").alias("observed_at"),
    )


SQL["reorgs"] = """reorgs AS (
  SELECT 'old-' || event_id AS old_tip_hash, user_id AS old_tip_height, event_id::VARCHAR AS new_tip_hash, user_id + 1 AS new_tip_height, 'base-' || event_id AS common_ancestor_hash,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS depth, list_transform(range(1, depth + 2), lambda i: 'd' || event_id || '-' || i) AS disconnected_blocks,
    list_transform(range(1, depth + 3), lambda i: 'c' || event_id || '-' || i) AS connected_blocks, ts AS observed_at FROM events WHERE event_type = 'error')"""


def canon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), "event_id", "event_type", F.col("ts").alias("event_time"), cents("value").alias("value"), F.when(F.col("user_id") % 2 == 0, "main").otherwise("test").alias("network"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("block_height"), "user_id", F.when(F.col("event_id") % 3 == 0, "historical_replay").otherwise("live").alias("observation_mode"),
    )


SQL["canon"] = """canon AS (
  SELECT event_id::VARCHAR AS id, event_id, event_type, ts AS event_time, CAST(round(value * 100) AS BIGINT) AS value, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'test' END AS network,
    date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS block_height, user_id, CASE WHEN event_id % 3 = 0 THEN 'historical_replay' ELSE 'live' END AS observation_mode FROM events)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    classes = F.array(*map(F.lit, ("ON_CHAIN_VERIFIED", "OFFICIALLY_ATTRIBUTED", "HIGH_CONFIDENCE", "REPORTED", "HEURISTIC", "UNVERIFIED")))
    null = F.lit(None).cast("string")
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("addr-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("ADDRESS").alias("target_type"), null.alias("txid"), F.col("c_custkey").cast("string").alias("address"),
        F.element_at(classes, F.col("c_nationkey") % 6 + 1).alias("classification"),
    )
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(
        F.concat(F.lit("tx-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("TRANSACTION").alias("target_type"), F.col("o_orderkey").cast("string").alias("txid"), null.alias("address"), F.lit("ON_CHAIN_VERIFIED").alias("classification"),
    )
    both = c.unionByName(o)
    points = o.withColumns({"id": F.concat(F.lit("out-"), "txid"), "target_type": F.lit("OUTPOINT")})
    return both.unionByName(points).withColumns({"vout": F.lit(0).cast("bigint"), "active": F.lit(True)})


SQL["targets"] = """targets AS (
  SELECT 'addr-' || c_custkey AS id, 'ADDRESS' AS target_type, NULL AS txid, c_custkey::VARCHAR AS address,
    ['ON_CHAIN_VERIFIED', 'OFFICIALLY_ATTRIBUTED', 'HIGH_CONFIDENCE', 'REPORTED', 'HEURISTIC', 'UNVERIFIED'][c_nationkey % 6 + 1] AS classification FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'tx-' || o_orderkey, 'TRANSACTION', o_orderkey::VARCHAR, NULL, 'ON_CHAIN_VERIFIED' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
  UNION ALL SELECT 'out-' || o_orderkey, 'OUTPOINT', o_orderkey::VARCHAR, NULL, 'ON_CHAIN_VERIFIED' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')"""


def spends(spark: SparkSession, d: str) -> DataFrame:
    """Each order of a customer spends output 0 of the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    value = cents("o_totalprice")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("txid"), F.lag(F.col("o_orderkey").cast("string")).over(w).alias("prev_txid"), F.lit(0).cast("bigint").alias("prev_vout"),
        F.lag(value).over(w).alias("value_sats"), value.alias("out_sats"), F.col("o_custkey").cast("string").alias("address"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("watched"),
    )
    return rows


SQL["spends"] = """spends AS (
  SELECT o_orderkey::VARCHAR AS txid, lag(o_orderkey::VARCHAR) OVER w AS prev_txid, lag(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS value_sats,
    CAST(round(o_totalprice * 100) AS BIGINT) AS out_sats, o_custkey::VARCHAR AS address, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS watched FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def with_views(*names: str, then: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + then
