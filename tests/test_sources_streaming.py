"""Decoders on known bytes, mappers on small JSON, streams against their batch forms."""

import struct

from pyspark.sql import functions as F

from lodewell.operators import chain, provenance, replay
from lodewell.sources import decoders, mappers
from lodewell.streaming import stateful

GENESIS_TX = bytes.fromhex(
    "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e"
    "206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f3"
    "5504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000"
)
HEADER = bytes.fromhex("0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c")


def test_genesis_block(spark):
    tx = decoders.decode_transaction(GENESIS_TX)
    assert tx["txid"] == "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"
    assert (tx["size"], tx["weight"], tx["total_output_sats"], tx["is_rbf"], tx["inputs"][0]["is_coinbase"]) == (204, 816, 5_000_000_000, False, True)
    df = spark.createDataFrame([(bytearray(HEADER + b"\1" + GENESIS_TX),), (bytearray(b"short"),)], "body binary")
    r = decoders.blocks(df).collect()
    assert len(r) == 1 and r[0]["block_hash"] == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f" and r[0]["tx_count"] == 1
    assert decoders.transactions(spark.createDataFrame([(bytearray(GENESIS_TX),), (bytearray(GENESIS_TX + b"x"),)], "body binary")).count() == 1


def test_addresses():
    assert decoders.address(bytes.fromhex("76a914" + "62e907b15cbf27d5425399ebf6f0fb50ebb88f18" + "88ac")) == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    assert decoders.address(bytes.fromhex("0014751e76e8199196d454941c45d1b3a323f1433bd6")) == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert decoders.address(bytes.fromhex("512079be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798")) == "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"
    assert decoders.script_type(b"\x6a\x01\x02") == "op_return" and decoders.address(b"\x6a") is None


def test_frames_and_sequences(spark):
    df = spark.createDataFrame([([bytearray(b"rawtx"), bytearray(b"x"), bytearray(struct.pack("<I", 4294967295))],), ([bytearray(b"rawtx"), bytearray(b"x")],), ([bytearray(b"other"), bytearray(b"x"), bytearray(b"\0\0\0\0")],)], "parts array<binary>")
    assert [r["seq"] for r in decoders.frames(df, "rawtx").collect()] == [4294967295]
    bodies = [bytes(range(32)) + b"C", bytes(32) + b"A" + struct.pack("<Q", 77), bytes(32) + b"A"]
    rows = decoders.sequence_events(spark.createDataFrame([(bytearray(b),) for b in bodies], "body binary")).collect()
    assert [(r["label"], r["mempool_sequence"]) for r in rows] == [("C", None), ("A", 77)] and rows[0]["hash"] == bytes(range(32)).hex()


def test_envelope(spark):
    text = '{"blocks": [{"id": "h", "height": 7, "timestamp": 60, "size": 10, "weight": 0}], "block": {"id": "g"}, "rbfTransaction": {"txid": "n", "replaced_txid": "o", "fee": 9}, "mempoolInfo": {"size": 1, "total_fee": 0.5}, "new": 1}'
    m = mappers.websocket_messages(spark.createDataFrame([(text,), ("not json",)], "value string"))
    assert [r["kind"] for r in m.orderBy("pos").collect()] == ["block", "block", "mempool", "replacement"]
    assert {r["block_hash"]: r["weight"] for r in mappers.websocket_blocks(m).collect()} == {"g": None, "h": 40}
    r = mappers.websocket_replacements(m).first()
    assert (r["replaced_txids"], r["new_fee_sats"], r["fee_delta_sats"]) == (["o"], 9, 9)
    assert mappers.websocket_mempool(m).first()["total_fee_sats"] == 50_000_000


def run(stream, path, tmp_path):
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"k{i % 3}", i * 7 % 100 + i, i, (4294967290 + i * 2 - i % 4) % 2**32) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[2]))[part * 20 : part * 20 + 20], "k string, t bigint, id bigint, s bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    run(stateful.dedup_stream(source, "k", "t", "id", 30), str(tmp_path / "out"), tmp_path)
    got = {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"] for r in provenance.dedup_ttl(whole, ["k"], F.col("t"), "id", 30).collect()}


def test_sequence_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate((5, 5, 6, 9, 7, 10))], "k string, i bigint, s bigint")
    df.write.parquet(str(tmp_path / "in"))
    run(stateful.sequence_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "i", "s"), str(tmp_path / "out"), tmp_path)
    got = {r["i"]: r["state"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["i"]: r["state"] for r in chain.sequence_states(df, "k", "i", "s").collect()}


def test_sink_and_replay(spark, tmp_path):
    sink = stateful.append_new(str(tmp_path / "t"), "id")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, x string")
    for n in (0, 0, 1):
        sink(batch, n)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    span = replay.ReplayRange(10, 70)
    span.check(tip=70)
    blocks = spark.range(100).withColumnRenamed("id", "height")
    assert replay.remaining(blocks, span, spark.createDataFrame([(34,)], "completed_height bigint")).count() == 36
    created, existing = replay.split_new(batch.withColumnRenamed("id", "event_id"), spark.createDataFrame([(2,)], "event_id bigint"))
    assert (created.count(), existing.count()) == (1, 1)
