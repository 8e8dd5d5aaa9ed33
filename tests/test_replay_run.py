"""Node readers against a local server, and whole replays of small chains."""

import base64
import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodewell import __main__ as command
from lodewell.operators import baseline, dossier, watch
from lodewell.operators.replay import ReplayRange
from lodewell.plans import replay_run
from lodewell.plans.store import Store
from lodewell.sources import decoders, landing, mappers
from lodewell.sources.node import BlockSource, NodeError, Rest, Rpc, checked_url
from lodewell.streaming import live

BTC = 10**8


def number(n: int) -> bytes:
    return bytes([n]) if n < 0xFD else b"\xfd" + struct.pack("<H", n)


def raw_tx(spent: list[tuple[str, int]], values: list[int], note: bytes = b"\x01\x01") -> bytes:
    out = struct.pack("<I", 2) + number(max(1, len(spent)))
    for txid, vout in spent:
        out += bytes.fromhex(txid)[::-1] + struct.pack("<I", vout) + b"\0" + b"\xff" * 4
    if not spent:
        out += bytes(32) + b"\xff" * 4 + number(len(note)) + note + b"\xff" * 4
    out += number(len(values)) + b"".join(struct.pack("<q", v) + b"\x16\x00\x14" + bytes(20) for v in values)
    return out + bytes(4)


def raw_block(previous: str, seconds: int, txs: list[bytes]) -> bytes:
    return struct.pack("<I", 2) + bytes.fromhex(previous)[::-1] + bytes(32) + struct.pack("<III", seconds, 0, 0) + number(len(txs)) + b"".join(txs)


def chain_of(n: int = 4) -> list[bytes]:
    """Block 0 pays 200 BTC; block 1 spends it at a fee of 1 BTC into 60 outputs, two hours later; the rest are small."""
    first = raw_tx([], [200 * BTC])
    txid = decoders.decode_transaction(first)["txid"]
    spend = raw_tx([(txid, 0)], [199 * BTC // 60] * 59 + [199 * BTC - 59 * (199 * BTC // 60)])
    out = [raw_block("00" * 32, 1_400_000_000, [first])]
    for i in range(1, n):
        previous = decoders.decode_block(out[-1])["block_hash"]
        out.append(raw_block(previous, 1_400_000_000 + (7300 if i == 1 else 7300 + 60 * i), [raw_tx([], [BTC], b"\x01" + bytes([i])), *([spend] if i == 1 else [])]))
    return out


@pytest.fixture(scope="module")
def node():
    chain, seen = chain_of(), {"logins": [], "busy": 2}
    names = [decoders.decode_block(b)["block_hash"] for b in chain]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/busy":
                seen["busy"] -= 1
                return self.answer(503 if seen["busy"] >= 0 else 200, b"fine")
            parts = self.path.strip("/").split("/")
            if parts[0] == "block-height":
                return self.answer(200, names[int(parts[1])].encode())
            if parts[0] == "block" and parts[-1] == "raw":
                return self.answer(200, chain[names.index(parts[1])])
            if self.path == "/blocks/tip/height":
                return self.answer(200, str(len(chain) - 1).encode())
            self.answer(404, b"")

        def do_POST(self):
            seen["logins"].append(self.headers.get("Authorization"))
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            p = sent["params"]
            found = {
                "getblockchaininfo": lambda: {"chain": "main", "blocks": len(chain) - 1}, "getnetworkinfo": lambda: {"version": 1}, "getblockhash": lambda: names[p[0]],
                "getblock": lambda: chain[names.index(p[0])].hex(), "getblockheader": lambda: {"previousblockhash": names[names.index(p[0]) - 1]},
            }.get(sent["method"])
            if found is None:
                return self.answer(500, json.dumps({"error": {"message": "no such method"}, "result": None}).encode())
            self.answer(200, json.dumps({"result": found(), "error": None}).encode())

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", chain, names, seen
    server.shutdown()


def test_clients(node):
    url, chain, names, seen = node
    rpc = Rpc(url, user="u", password="p")
    assert rpc.capabilities("mainnet")["blocks"] == 3 and rpc.raw_block(2) == (names[2], chain[2]) and seen["logins"][-1].startswith("Basic ")
    with pytest.raises(NodeError, match="no such method"):
        rpc.chain_tips()
    with pytest.raises(NodeError, match="not on test"):
        rpc.capabilities("testnet")
    rest = Rest(url, wait=0.001)
    assert rest.get("busy") == b"fine" and rest.tip() == 3
    with pytest.raises(NodeError, match="404"):
        rest.get("nothing")
    with pytest.raises(NodeError, match="more than"):
        Rest(url, most=10).raw_block(1)
    with pytest.raises(ValueError):
        checked_url("file:///etc/hosts")


@pytest.mark.parametrize("kind", ["rpc", "rest"])
def test_block_source(spark, node, kind):
    url, chain, names, _ = node
    spark.dataSource.register(BlockSource)
    rows = spark.read.format("lodewell_blocks").options(url=url, kind=kind, start=0, end=3, slice=2).load()
    assert rows.rdd.getNumPartitions() == 2
    assert {r["height"]: (r["block_hash"], bytes(r["body"])) for r in rows.collect()} == {i: (n, b) for i, (n, b) in enumerate(zip(names, chain))}


def test_tip_stream(spark, node, tmp_path):
    spark.dataSource.register(BlockSource)
    stream = spark.readStream.format("lodewell_blocks").options(url=node[0], start=1).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["height"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3]


def test_replay_from_the_command_line(spark, node, tmp_path, capsys):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "store")
    command.main(["fetch", "--url", node[0], "--start", "0", "--end", "3", "--into", raw], spark)
    for _ in range(2):  # the second time there is nothing left to do
        command.main(["replay", "--blocks", raw, "--start", "0", "--end", "3", "--job", "j", "--store", root], spark)
    assert capsys.readouterr().out.split() == ["COMPLETED", "COMPLETED"]
    store = Store(spark, root)
    events = store.table("events").collect()
    assert sorted((r["event_type"], r["severity"], r["block_height"]) for r in events) == [
        ("EXTREME_FEE", "CRITICAL", 1), ("FAN_OUT", "HIGH", 1), ("LARGE_TRANSFER", "MEDIUM", 0), ("LARGE_TRANSFER", "MEDIUM", 1), ("LONG_BLOCK_INTERVAL", "CRITICAL", 1),
    ]
    fee = next(json.loads(r["metadata"]) for r in events if r["event_type"] == "EXTREME_FEE")
    assert fee["fee_sats"] == BTC and fee["fee_trigger_type"] == "BOTH"
    assert store.table("observations").count() == 5 and store.table("outputs").count() == 64
    flow = {"blocks_observed": 4, "transactions_observed": 5, "transactions_enriched": 1, "utxo_lookup_failures": 0, "events_generated": 5, "events_deduplicated": 0, "incident_activities_detected": 0, "incident_alerts_emitted": 0}
    assert {r["name"]: r["value"] for r in store.flow("replay/j").collect()} == flow
    assert store.table("event_metrics").filter("metric = 'fee_sats'").first()["value"] == BTC
    command.main(["baseline", "--start", "0", "--end", "3", "--store", root], spark)
    run = capsys.readouterr().out.strip()
    assert store.baseline_run(2).first()["run"] == run and store.rarity(run).filter("method <> 'INSUFFICIENT'").isEmpty()
    one = store.rarity(run, least=2).filter("event_type = 'LARGE_TRANSFER' AND metric = 'value_sats'").orderBy("value").collect()
    assert [(r["method"], r["percentile"], r["tail"]) for r in one] == [("EXACT", 50.0, 2), ("EXACT", 100.0, 1)]
    assert {r["event_type"] for r in store.impact(run, least=1).filter("score IS NOT NULL").collect()} >= {"LARGE_TRANSFER", "EXTREME_FEE"}
    command.main(["rarity", "--run", run, "--store", root], spark)


def test_replay_in_steps_equals_one_step(spark, node, tmp_path):
    rows = [(i, n, bytearray(b)) for i, (n, b) in enumerate(zip(node[2], node[1]))]
    raw = spark.createDataFrame(rows, "height bigint, block_hash string, body binary")
    blocks = decoders.blocks(raw).drop("height").join(raw.select("height", "block_hash"), "block_hash")
    store = Store(spark, str(tmp_path))
    store.save_job("j", ReplayRange(0, 3), "PENDING")
    store.set_job("j", "PAUSED")
    assert replay_run.run(store, blocks, ReplayRange(0, 3), "j", every=1) == "COMPLETED"
    assert {r["id"] for r in store.table("events").collect()} == {r["id"] for r in replay_run.detect(blocks).collect()}
    assert store.checkpoint("j") == 3
    told = {r["name"]: r["value"] for r in store.flow().collect()}
    assert (told["blocks_observed"], told["transactions_observed"], told["transactions_enriched"], told["events_generated"], told["events_deduplicated"]) == (4, 5, 1, 5, 0)
    with pytest.raises(ValueError):
        store.set_job("j", "CANCELLED")
    new, known = replay_run.created_and_known(store, replay_run.detect(blocks))
    assert (new.count(), known.count()) == (0, 5)


def test_incidents(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    make = lambda title, as_of, nodes: store.save_incident(
        spark.createDataFrame([("case-a", title)], "id string, title string"), spark.createDataFrame([("case-a", as_of, 5)], "incident_id string, as_of string, recovered_sats bigint"),
        {"evidence": spark.createDataFrame([("case-a", n) for n in nodes], "incident_id string, node string")},
    )
    make("one", "2024-01-01", ["x", "y"])
    make("two", "2024-02-01", ["z"])
    make("two", "2024-02-01", ["z", "a"])
    store.replace_of("dossiers", spark.createDataFrame([("case-b", "other", "case-b")], "id string, title string, incident_id string"), "incident_id")
    r = store.dossier("case-a", {"evidence": ["node"]}).first()
    assert r["title"] == "two" and [x["node"] for x in r["evidence"]] == ["a", "z"] and r["as_of"] == "2024-02-01"
    assert store.table("incident_snapshots").count() == 2 and store.table("dossiers").count() == 2


def test_dossier_is_saved_and_read_back_whole(spark, tmp_path):
    store, case = Store(spark, str(tmp_path)), dossier.example()
    case.save(store)
    r = dossier.assemble(store, "example-2031").first()
    assert [b["height"] for b in r["blocks"]] == [1_000_000, 1_000_400] and [u["id"] for u in r["updates"]] == ["u2", "u1"]
    assert [s["id"] for s in r["sources"]] == ["s1", "s2"] and [e["id"] for e in r["evidence"]] == ["v1", "v2"] and r["timeline"][0]["evidence_ids"] == ["v1"]
    assert len(r["facts"]) == 1 and len(r["reported_claims"]) == 2 and len(r["unverified_claims"]) == 2 and r["heights"] == [1_000_400, 1_000_000] and len(r["txids"]) == 2
    assert (r["affected_sats"], r["recovered_sats"], r["outstanding_sats"]) == (125_000_000_000, 40_000_000_000, 85_000_000_000)
    case.lists["findings"].clear()
    case.lists["nodes"].append({"node": "other"})
    case.recovery("2031-03-05T00:00:00Z", 125_000_000_000, 50_000_000_000).save(store)
    dossier.Dossier("other", "t", "s", "LOW").save(store)
    both = {r["incident_id"]: r for r in dossier.assemble(store).collect()}
    assert both["example-2031"]["findings"] == [] and len(both["example-2031"]["nodes"]) == 4 and both["example-2031"]["recovered_sats"] == 50_000_000_000
    assert both["other"]["claims"] == [] and both["other"]["affected_sats"] is None
    assert dossier.example_targets(spark).groupBy("target_type").count().count() == 3


def test_dossier_that_breaks_rules_is_not_saved(spark, tmp_path):
    case = dossier.Dossier("c", "t", "s", "LOW").recovery("2031-01-02T00:00:00Z", 5, 9, outstanding_sats=3)
    for at in ("2031-01-02T00:00:00Z", "2031-01-01T00:00:00Z"):
        case.add("timeline", id=at, happened_at=at).add("updates", id=at, happened_at=at).add("nodes", node="n").add("evidence", id="v")
    case.add("edges", source="n", target="m").add("messages", txid="x", attributed_sender="me", confidence="ON_CHAIN_VERIFIED")
    rules = {r["rule"]: r["detail"] for r in case.violations(spark).collect()}
    assert rules == {
        "recovered_over_affected": "", "outstanding_mismatch": "0", "dangling_edge": "m", "duplicate_node": "n", "duplicate_evidence": "v",
        "timeline_order": "1", "update_order": "1", "self_attributed_identity": "x",
    }
    with pytest.raises(ValueError, match="dangling_edge m"):
        case.save(Store(spark, str(tmp_path)))
    assert not Store(spark, str(tmp_path)).has("dossiers")
    assert "timeline_order" not in {r["rule"] for r in case.sort_timeline().violations(spark).collect()}
    with pytest.raises(ValueError, match="have no colour"):
        case.add("nodes", colour="red")


def test_descendants_and_activities(spark, tmp_path):
    outputs = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False), ("c", 0, False), ("d", 0, False)], "txid string, vout bigint, op_return boolean")
    inputs = spark.createDataFrame([("b", "a", 0, 10), ("x", "a", 1, 0), ("c", "b", 0, 9), ("d", "c", 0, 8), ("e", "d", 0, 7)], "txid string, prev_txid string, prev_vout bigint, value_sats bigint")
    found = watch.descendants(spark.createDataFrame([("a", "t")], "txid string, target_id string"), outputs, inputs, 3)
    assert sorted((r["txid"], r["depth"]) for r in found.collect()) == [("b", 1), ("c", 2), ("d", 3)]
    rows = spark.createDataFrame([("case", "WATCHED_OUTPOINT_SPENT", "t1", "DIRECT", None, "k1", "HIGH", "2024-01-01")], "incident_id string, activity_type string, txid string, correlation string, value_sats bigint, dedup_key string, severity string, observed_at string")
    assert watch.timeline(rows).first()["title"] == "Watched Outpoint Spent"
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        store.save_activities(rows)
    assert store.activities().count() == 1 and store.alerts("case").count() == 1
    seen = rows.withColumns({"status": F.lit("MEMPOOL"), "block_height": F.lit(None).cast("bigint"), "dedup_key": F.lit("k2")})
    store.save_activities(seen)
    store.save_activities(seen.withColumns({"status": F.lit("CONFIRMED"), "block_height": F.lit(7).cast("bigint"), "observed_at": F.lit("2025-01-01")}))
    r = store.activity_by_key("k2").first()
    assert (r["status"], r["block_height"], r["observed_at"]) == ("CONFIRMED", 7, "2024-01-01") and store.alerts("case").count() == 2


def test_live_detection_of_landed_frames(spark, node, tmp_path):
    """Frames land as files; a stream decodes them, takes spent values from the stored outputs, and stores events once."""
    store, blocks = Store(spark, str(tmp_path / "store")), blocks_of(spark, node)
    store.append("outputs", replay_run.outputs_of(replay_run.transactions_of(blocks.filter("height = 0"))))
    raw = raw_tx([(decoders.decode_block(node[1][0])["transactions"][0]["txid"], 0)], [199 * BTC])
    line = lambda parts: json.dumps({"topic": "rawtx", "parts": [base64.b64encode(p).decode() for p in parts], "received_at": "2024-01-01T00:00:00Z"})
    folder = tmp_path / "frames"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([line([b"rawtx", raw, struct.pack("<I", 7)]), line([b"rawtx", raw]), line([b"rawtx", raw[:20], struct.pack("<I", 8)])]))
    source = landing.LandedFrames(str(folder), "rawtx")
    assert source.healthy(spark) and source.kind == "transaction"
    for n in range(2):  # the second stream reads the folder anew
        q = source.read(spark).writeStream.foreachBatch(live.sink(store)).option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        q.processAllAvailable()
        q.stop()
    events = {r["event_type"]: json.loads(r["metadata"]) for r in store.table("events").collect()}
    assert set(events) == {"LARGE_TRANSFER", "EXTREME_FEE", "DORMANT_COINS_MOVED"} and events["EXTREME_FEE"]["fee_sats"] == BTC and store.table("events").count() == 3
    assert [r["mode"] for r in store.all_observations().collect()] == ["live"] * 3
    told = {r["name"]: r["value"] for r in store.flow("live/transactions").collect()}
    assert (told["transactions_observed"], told["utxo_lookup_failures"], told["events_generated"], told["events_deduplicated"]) == (1, 0, 0, 3)  # batch 0 came again
    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "a.txt").write_text('{"tx": {"txid": "t", "fee": 5}}\nnot json\n')
    assert [r["kind"] for r in landing.LandedEnvelopes(str(tmp_path / "ws"), stream=False).read(spark).collect()] == ["transaction"]


def test_watch_targets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "id string, incident_id string, target_type string, txid string, vout bigint, address string, script_hex string, classification string, active boolean"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    store.seed_targets(make(("a", "c", "OUTPOINT", "t", 0, None, None, "REPORTED", True), ("b", "c", "OUTPOINT", "t", 0, None, None, "REPORTED", True), ("d", "c", "ADDRESS", None, None, "x", None, "REPORTED", True)))
    store.seed_targets(make(("e", "c", "ADDRESS", None, None, "x", None, "REPORTED", True), ("f", "c", "OUTPOINT", "t", 1, None, None, "REPORTED", True)))
    assert store.watch_targets("c").count() == 3
    store.save_watch_targets(make(("d", "c", "ADDRESS", None, None, "x", None, "ON_CHAIN_VERIFIED", False)))
    assert {r["id"]: (r["classification"], r["active"]) for r in store.watch_targets().collect()}["d"] == ("ON_CHAIN_VERIFIED", False)
    assert store.public_watch_targets("c").count() == 3


def blocks_of(spark, node):
    raw = spark.createDataFrame([(i, n, bytearray(b)) for i, (n, b) in enumerate(zip(node[2], node[1]))], "height bigint, block_hash string, body binary")
    return decoders.blocks(raw).drop("height").join(raw.select("height", "block_hash"), "block_hash")


def test_replay_sees_the_block_before_its_range(spark, node, tmp_path):
    store = Store(spark, str(tmp_path))
    assert replay_run.run(store, blocks_of(spark, node), ReplayRange(1, 3), "j") == "COMPLETED"
    assert "LONG_BLOCK_INTERVAL" in {r["event_type"] for r in store.table("events").collect()} and store.table("events").filter("block_height < 1").isEmpty()


def test_replay_fails_where_a_block_is_missing(spark, node, tmp_path):
    store, blocks = Store(spark, str(tmp_path)), blocks_of(spark, node)
    assert replay_run.run(store, blocks.filter("height <> 2"), ReplayRange(0, 3), "j", every=1) == "FAILED"
    assert store.checkpoint("j") == 1 and store.job("j")["status"] == "FAILED"
    assert replay_run.run(store, blocks, ReplayRange(0, 3), "j", every=1) == "COMPLETED" and store.checkpoint("j") == 3


def test_scenario(spark):
    targets = spark.createDataFrame([("w", "TRANSACTION", "a", None, None, None, None, True), ("s", "SCRIPT", None, None, "0014", None, None, True)], "id string, target_type string, txid string, vout bigint, script_hex string, address string, classification string, active boolean")
    tx = spark.createDataFrame([("a", 5, 12 * BTC)], "txid string, height bigint, total_output_sats bigint")
    inputs = spark.createDataFrame([], "txid string, prev_txid string, prev_vout bigint, address string, value_sats bigint")
    outputs = spark.createDataFrame([("a", "0014", None, BTC)], "txid string, script_hex string, address string, value_sats bigint")
    replaced = spark.createDataFrame([("n", ["o", "a"])], "replacement_txid string, replaced_txids array<string>")
    got = {(r["txid"], r["activity_type"]): r["severity"] for r in watch.simulate(tx, inputs, outputs, replaced, targets, "case").collect()}
    assert got == {("a", "WATCHED_TRANSACTION_CONFIRMED"): "HIGH", ("a", "WATCHED_SCRIPT_RECEIVED"): "MEDIUM", ("n", "TRANSACTION_REPLACEMENT"): "MEDIUM"}


def test_rest_mappers(spark):
    tx = {"txid": "t", "fee": 100, "size": 150, "weight": 401, "vin": [{"txid": "p", "vout": 1, "sequence": 1, "prevout": {"value": 600}}], "vout": [{"value": 500, "scriptpubkey": "6a"}], "status": {"confirmed": True, "block_height": 7, "block_time": 60}}
    r = mappers.rest_transactions(spark.createDataFrame([(json.dumps(tx),), ("bad",)], "value string")).collect()
    assert len(r) == 1 and (r[0]["vsize"], r[0]["total_input_sats"], r[0]["total_output_sats"], r[0]["is_rbf"], r[0]["block_height"]) == (101, 600, 500, True, 7)
    b = mappers.rest_blocks(spark.createDataFrame([('{"id": "h", "height": 1, "timestamp": 60, "extras": {"pool": {"name": "m"}}}',)], "value string")).first()
    assert (b["miner_tag"], b["previous_block_hash"]) == ("m", "")
    assert mappers.rest_mempool(spark.createDataFrame([('{"count": 2, "vsize": 5}',)], "value string")).first()["total_fee_sats"] == 0


def test_rarity_falls_back_to_the_distribution(spark):
    rows = spark.createDataFrame([("a", "T", "m", 5, 1), ("b", "T", "m", 9, 50)], "id string, event_type string, metric string, value bigint, block_height bigint")
    many = spark.range(1, 201).select(F.lit("T").alias("event_type"), F.lit("m").alias("metric"), (F.col("id") % 10).alias("value"))
    dists = baseline.distributions(many, many.groupBy("event_type").agg(F.count(F.lit(1)).alias("candidate_count")), ["event_type", "metric"])
    got = {r["id"]: r for r in baseline.event_rarity(rows, dists, ["event_type", "metric"], F.lit(False), 10).collect()}
    assert (got["b"]["method"], got["b"]["percentile"], got["b"]["tail"], got["b"]["evaluation_mode"]) == ("DISTRIBUTION", 100.0, 1, "POINT_IN_TIME")
    assert got["a"]["evaluation_mode"] == "RETROSPECTIVE" and 0 < got["a"]["percentile"] < 100
