"""The watch engine: a stream in any batches equals the table, steps of a replay equal one step."""

import random

import pytest
from pyspark.sql import functions as F

from lodewell.operators import watch
from lodewell.operators.replay import ReplayRange
from lodewell.plans import replay_run
from lodewell.plans.store import Store
from lodewell.sources import decoders
from lodewell.streaming import watching
from test_live_chain import streamed
from test_replay_run import BTC, raw_block, raw_tx

TARGETS = "id string, target_type string, txid string, vout bigint, script_hex string, address string, classification string, active boolean"
TX = (
    "arrival bigint, txid string, height bigint, total_output_sats bigint, inputs array<struct<prev_txid: string, prev_vout: bigint, value_sats: bigint, address: string>>, "
    "outputs array<struct<vout: bigint, value_sats: bigint, op_return: boolean, address: string, script_hex: string>>"
)


def graph(seed: int, n: int = 40):
    """Transactions that spend earlier outputs, some of them more than one; a few outputs carry data."""
    draw, free, rows = random.Random(seed), [], []
    for i in range(n):
        spent = draw.sample(free, min(len(free), draw.choice([0, 1, 1, 2, 3])))
        free = [p for p in free if p not in spent]
        outputs = [(v, draw.randint(1, 500), draw.random() < 0.15, draw.choice(["A", "B", None]), draw.choice(["AA", "0b", None])) for v in range(draw.randint(1, 3))]
        rows.append((i, f"t{i}", draw.choice([None, i]), 9, [(t, v, value, draw.choice(["A", None])) for t, v, value in spent], outputs))
        free += [(f"t{i}", o[0], o[1]) for o in outputs]
    return rows


def flat(df):
    inputs = df.select("arrival", "txid", F.posexplode("inputs").alias("position", "i")).select("arrival", "txid", "position", "i.*")
    outputs = df.select("arrival", "txid", F.posexplode("outputs").alias("position", "o")).select("arrival", "txid", "position", "o.*")
    return df, inputs, outputs


@pytest.fixture
def targets(spark):
    rows = [("p0", "OUTPOINT", "T0", 0, None, None, "HEURISTIC", True), ("p1", "OUTPOINT", "t3", 0, None, None, "HEURISTIC", True), ("p2", "OUTPOINT", "t0", 0, None, None, "DISPUTED", True), ("gone", "OUTPOINT", "t1", 0, None, None, "HEURISTIC", False)]
    rows += [("tx", "TRANSACTION", "t5", None, None, None, "ON_CHAIN_VERIFIED", True), ("s", "SCRIPT", None, None, "aa", None, "HEURISTIC", True), ("a", "ADDRESS", None, None, None, "A", "OFFICIALLY_ATTRIBUTED", True)]
    return spark.createDataFrame(rows, TARGETS)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("arrival", "txid", "target_id", "activity_type", "correlation", "value_sats", "depth", "stage", "position").collect())


def plain_descendants(rows, points, deepest):
    """One transaction at a time, as a follower meets them."""
    held, out = {}, []
    for arrival, txid, _, _, inputs, outputs in rows:
        entered = {}
        for position, (prev, vout, value, _) in enumerate(inputs):
            for target, (t, v) in points.items():
                if (t.lower(), v) == (prev, vout):
                    out.append((arrival, txid, target, 0, position, value))
                    entered[target] = 1
            for target, depth in held.pop((prev, vout), {}).items():
                out.append((arrival, txid, target, depth, position, value))
                if depth < deepest:
                    entered[target] = min(entered.get(target, 9), depth + 1)
        for target, depth in entered.items():
            for v, _, data, *_ in outputs:
                if not data:
                    held.setdefault((txid, v), {})[target] = depth
    return sorted(out)


@pytest.mark.parametrize(("seed", "deepest"), [(1, 3), (2, 5)])
def test_engine_equals_one_transaction_at_a_time(spark, targets, seed, deepest):
    rows = graph(seed)
    tx, inputs, outputs = flat(spark.createDataFrame(rows, TX))
    got, _ = watch.engine(tx, inputs, outputs, targets, deepest)
    below = [(r["arrival"], r["txid"], r["target_id"], r["depth"], r["position"], r["value_sats"]) for r in got.filter("depth IS NOT NULL").collect()]
    want = plain_descendants(rows, {"p0": ("T0", 0), "p1": ("t3", 0), "p2": ("t0", 0)}, deepest)
    assert sorted(below) == want and max(r[3] for r in want) >= 2


def test_stream_in_any_batches_equals_the_table(spark, targets, tmp_path):
    rows = graph(1)
    whole = found(watch.engine(*flat(spark.createDataFrame(rows, TX)), targets)[0])
    for name, cuts in (("one", []), ("many", [3, 4, 11, 25])):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = streamed(spark, lambda s: watching.activities(s, targets), parts, TX, tmp_path / name)
        assert found(got) == whole


def test_transactions_that_come_again_are_told_once(spark, targets, tmp_path):
    rows = graph(1, 16)
    got = streamed(spark, lambda s: watching.followed(s, targets), [rows[:9], rows[2:9], rows[9:], rows[5:]], TX, tmp_path)
    once = watch.engine(*flat(spark.createDataFrame(rows, TX)), targets)[0].filter("depth IS NOT NULL")
    assert got.count() == once.count() > 0


def chain_with_a_trail():
    """Five blocks: an output is spent, its change is spent, and again; one transaction carries data."""
    first = raw_tx([], [50 * BTC])
    names, blocks = [decoders.decode_transaction(first)["txid"]], [raw_block("00" * 32, 1_400_000_000, [first])]
    for i in range(1, 5):
        spend = raw_tx([(names[-1], 0)], [(50 - i) * BTC, BTC])
        names.append(decoders.decode_transaction(spend)["txid"])
        blocks.append(raw_block(decoders.decode_block(blocks[-1])["block_hash"], 1_400_000_000 + 600 * i, [raw_tx([], [BTC], b"\x01" + bytes([i])), spend]))
    return names, blocks


def test_replays_match_watch_targets(spark, tmp_path):
    """Stage by stage, in steps of two blocks and in one step: the same activities and alerts."""
    names, raw = chain_with_a_trail()
    blocks = decoders.blocks(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "at bigint, body binary"), stated="at")
    rows = [("p", "OUTPOINT", names[0], 0, None, None, "ON_CHAIN_VERIFIED", True, "case", "CASE-7", None), ("t", "TRANSACTION", names[4], None, None, None, "HEURISTIC", True, "case", "CASE-7", "the last")]
    rows.append(("a", "ADDRESS", None, None, None, decoders.address(b"\x00\x14" + bytes(20)), "OFFICIALLY_ATTRIBUTED", True, "case", "CASE-7", None))
    seen = {}
    for every in (2, 10):
        store = Store(spark, str(tmp_path / str(every)))
        store.save_watch_targets(spark.createDataFrame(rows, TARGETS + ", incident_id string, case_id string, label string"))
        assert replay_run.run(store, blocks, ReplayRange(0, 4), "job", every=every) == "COMPLETED"
        fields = ["activity_type", "txid", "target_id", "depth", "value_sats", "status", "block_height", "correlation", "severity", "dedup_key"]
        seen[every] = sorted(str(tuple(r)) for r in store.activities().select(fields).collect())
        kinds = {(r["activity_type"], r["txid"], r["depth"]) for r in store.activities().collect()}
        assert {("WATCHED_OUTPOINT_SPENT", names[1], 0), *[("NEW_DESCENDANT_OBSERVED", names[d + 1], d) for d in (1, 2, 3)], ("WATCHED_TRANSACTION_CONFIRMED", names[4], None)} <= kinds
        assert ("WATCHED_ADDRESS_SPENT", names[1], None) in kinds and ("WATCHED_ADDRESS_RECEIVED", names[0], None) in kinds
        alert = store.alerts("case").filter(F.col("title").contains("Outpoint")).first()
        assert alert["title"] == "[CASE-7] Watched Outpoint Spent" and alert["incident_title"] == "Incident CASE-7" and alert["txid"] == names[1] and alert["value_sats"] == 50 * BTC
        assert "OutPoint: " in alert["summary"] and {"case_id", "confidence", "correlation", "observed_at", "activity_id", "severity"} <= set(store.alerts("case").columns)
        assert store.alerts("case", limit=100).count() == len(seen[every])
        assert store.flow("replay/job").filter("name = 'incident_alerts_emitted'").first()["value"] == len(seen[every])
    assert seen[2] == seen[10]
