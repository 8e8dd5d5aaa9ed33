"""JSON of nodes and public interfaces to observations, by from_json and projections only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.functions.money import SATS_PER_BTC
from lodewell.sources.schemas import BY_TYPE

_WS_BLOCK = "struct<id: string, height: bigint, timestamp: bigint, tx_count: bigint, size: bigint, weight: bigint, previousblockhash: string>"
_WS_TX = "struct<txid: string, fee: bigint, vsize: double, value: bigint>"
_WS_RBF = "struct<txid: string, replaced_txid: string, replaced: array<string>, fee: bigint, newFee: bigint, oldFee: bigint>"
ENVELOPE = f"block {_WS_BLOCK}, blocks array<{_WS_BLOCK}>, mempoolInfo struct<size: bigint, bytes: bigint, total_fee: double, mempoolminfee: double>, tx {_WS_TX}, transactions array<{_WS_TX}>, rbfTransaction {_WS_RBF}, rbfTransactions array<{_WS_RBF}>"


def route(observations: DataFrame, kind: str) -> DataFrame:
    """Records of one type from tagged rows of {type, payload}; unknown fields are left out."""
    rows = observations.filter(F.lower("type") == kind)
    return rows.select(F.from_json("payload", BY_TYPE[kind]).alias("o")).select("o.*")


def websocket_messages(frames: DataFrame) -> DataFrame:
    """One row for each observation of an envelope, in the fixed order of its members: kind, pos, json."""
    e = frames.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), F.to_json(c).alias("json")))
    many = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast(e.schema[c].dataType)), lambda x: F.struct(F.lit(kind).alias("kind"), F.to_json(x).alias("json")))
    members = F.concat(
        one("block", F.col("block")), many("block", "blocks"), one("mempool", F.col("mempoolInfo")), one("transaction", F.col("tx")), many("transaction", "transactions"),
        one("replacement", F.col("rbfTransaction")), many("replacement", "rbfTransactions"),
    )
    return e.select(F.posexplode(F.filter(members, lambda x: x["json"].isNotNull()))).select("pos", "col.kind", "col.json")


def websocket_blocks(messages: DataFrame) -> DataFrame:
    b = messages.filter("kind = 'block'").select(F.from_json("json", _WS_BLOCK).alias("b")).select("b.*")
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, F.col("size") * 4).otherwise(F.col("weight"))
    return b.select(F.col("id").alias("block_hash"), "height", F.timestamp_seconds("timestamp").alias("timestamp"), F.coalesce("previousblockhash", F.lit("")).alias("previous_block_hash"), "tx_count", F.col("size").alias("size_bytes"), weight.alias("weight"))


def websocket_replacements(messages: DataFrame) -> DataFrame:
    r = messages.filter("kind = 'replacement'").select(F.from_json("json", _WS_RBF).alias("r")).select("r.*")
    old, new = F.coalesce("oldFee", F.lit(0)), F.coalesce("newFee", "fee", F.lit(0))
    replaced = F.coalesce("replaced", F.when(F.col("replaced_txid").isNotNull(), F.array("replaced_txid")), F.array().cast("array<string>"))
    return r.select(replaced.alias("replaced_txids"), F.col("txid").alias("replacement_txid"), old.alias("old_fee_sats"), new.alias("new_fee_sats"), (new - old).alias("fee_delta_sats"))


def websocket_mempool(messages: DataFrame) -> DataFrame:
    m = messages.filter("kind = 'mempool'").select(F.from_json("json", "size bigint, bytes bigint, total_fee double, mempoolminfee double").alias("m")).select("m.*")
    fine = (F.col("total_fee") >= 0) & (F.col("total_fee") <= 21_000_000)
    return m.select(F.col("size").alias("count"), F.col("bytes").alias("vsize_bytes"), F.when(fine, F.round(F.col("total_fee") * SATS_PER_BTC)).otherwise(0).cast("bigint").alias("total_fee_sats"))


def recent_transactions(rows: DataFrame) -> DataFrame:
    """Short transaction records: four weight units a virtual byte, inputs worth value and fee, one input and output."""
    t = rows.select(F.from_json("value", "txid string, fee bigint, vsize double, value bigint").alias("t")).select("t.*")
    vsize = F.ceil("vsize").cast("bigint")
    return t.select("txid", F.col("fee").alias("fee_sats"), vsize.alias("vsize"), (vsize * 4).alias("weight"), (F.col("value") + F.col("fee")).alias("total_input_sats"), F.col("value").alias("total_output_sats"), F.lit(1).cast("bigint").alias("input_count"), F.lit(1).cast("bigint").alias("output_count"))


_REST_BLOCK = "struct<id: string, height: bigint, timestamp: bigint, tx_count: bigint, size: bigint, weight: bigint, previousblockhash: string, difficulty: double, extras: struct<pool: struct<name: string>>>"
_REST_TX = (
    "struct<txid: string, fee: bigint, size: bigint, weight: bigint, vin: array<struct<txid: string, vout: bigint, sequence: bigint, is_coinbase: boolean, prevout: struct<value: bigint, scriptpubkey_address: string>>>, "
    "vout: array<struct<value: bigint, scriptpubkey_type: string, scriptpubkey_address: string, scriptpubkey: string>>, status: struct<confirmed: boolean, block_height: bigint, block_hash: string, block_time: bigint>>"
)


def rest_blocks(rows: DataFrame) -> DataFrame:
    b = rows.select(F.from_json("value", _REST_BLOCK).alias("b")).filter("b.id IS NOT NULL").select("b.*")
    return b.select(
        F.col("id").alias("block_hash"), "height", F.timestamp_seconds("timestamp").alias("timestamp"), F.coalesce("previousblockhash", F.lit("")).alias("previous_block_hash"), "tx_count",
        F.col("size").alias("size_bytes"), "weight", "difficulty", F.col("extras.pool.name").alias("miner_tag"),
    )


def rest_transactions(rows: DataFrame) -> DataFrame:
    """Whole transaction records, with the value of the outputs that inputs spend."""
    t = rows.select(F.from_json("value", _REST_TX).alias("t")).filter("t.txid IS NOT NULL").select("t.*")
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    vsize = F.floor((F.col("weight") + 3) / 4).cast("bigint")
    inputs = F.transform(
        "vin",
        lambda i: F.struct(i["txid"].alias("txid"), i["vout"].alias("vout"), i["sequence"].alias("sequence"), i["prevout"]["value"].alias("prev_out_value_sats"), i["prevout"]["scriptpubkey_address"].alias("prev_out_address"), i["is_coinbase"].alias("is_coinbase")),
    )
    outputs = F.transform(
        "vout",
        lambda o, n: F.struct(o["value"].alias("value_sats"), n.cast("bigint").alias("n"), o["scriptpubkey_type"].alias("script_pubkey_type"), o["scriptpubkey_address"].alias("address"), o["scriptpubkey"].alias("scriptpubkey_hex")),
    )
    total = lambda column, pick: F.aggregate(column, zero, lambda s, x: s + F.coalesce(pick(x), zero))
    return t.select(
        "txid", F.timestamp_seconds("status.block_time").alias("timestamp"), F.col("status.block_hash").alias("block_hash"), F.coalesce("status.block_height", none).alias("block_height"), F.col("fee").alias("fee_sats"), "size", "weight",
        vsize.alias("vsize"), F.when(vsize > 0, F.col("fee").cast("double") / vsize).alias("fee_rate_sat_vb"), total("vin", lambda i: i["prevout"]["value"]).alias("total_input_sats"), total("vout", lambda o: o["value"]).alias("total_output_sats"),
        F.size("vin").cast("bigint").alias("input_count"), F.size("vout").cast("bigint").alias("output_count"), inputs.alias("inputs"), outputs.alias("outputs"), F.exists("vin", lambda i: i["sequence"] < 4294967294).alias("is_rbf"),
        F.coalesce("status.confirmed", F.lit(False)).alias("confirmed"),
    )


def rest_mempool(rows: DataFrame) -> DataFrame:
    m = rows.select(F.from_json("value", "count bigint, vsize bigint, total_fee bigint").alias("m")).filter("m.count IS NOT NULL").select("m.*")
    return m.select("count", F.col("vsize").alias("vsize_bytes"), F.coalesce("total_fee", F.lit(0)).alias("total_fee_sats"))
