"""Following a chain live: a node that switches branches, late and repeated blocks, arrival intervals, life cycles of observations."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodewell import __main__ as command
from lodewell.operators import chain, provenance
from lodewell.plans.store import Store
from lodewell.sources import decoders
from lodewell.sources.node import BlockSource, branch_point
from lodewell.streaming import live, stateful, tip
from test_replay_run import BTC, raw_block, raw_tx


class Node:
    """A node whose active chain can be changed; it keeps the blocks of all branches."""

    def __init__(self) -> None:
        self.blocks, self.active = {}, []
        owner = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def do_POST(self):
                sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                body = json.dumps({"result": owner.answer(sent["method"], *sent["params"]), "error": None}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def grow(self, n: int, mark: int, pays: int = BTC, upon: int | None = None) -> None:
        """n blocks upon a height of the active chain (its tip), which become the active chain's end; ``mark`` tells branches apart."""
        base = len(self.active) - 1 if upon is None else upon
        found = self.active[: base + 1]
        for i in range(base + 1, base + 1 + n):
            raw = raw_block(found[-1] if found else "00" * 32, 1_400_000_000 + 600 * i + mark, [raw_tx([], [pays], b"\x01" + bytes([i, mark]))])
            found.append(decoders.decode_block(raw)["block_hash"])
            self.blocks[found[-1]] = raw
        self.active = found

    def answer(self, method: str, *p):
        return {
            "getblockchaininfo": lambda: {"chain": "main", "blocks": len(self.active) - 1},
            "getblockhash": lambda: self.active[p[0]],
            "getblock": lambda: self.blocks[p[0]].hex(),
            "getblockheader": lambda: {"previousblockhash": decoders.decode_block(self.blocks[p[0]])["previous_block_hash"]} if p[1] else self.blocks[p[0]][:80].hex(),
        }[method]()


@pytest.fixture
def node():
    one = Node()
    yield one
    one.server.shutdown()


def test_branch_points():
    old = {5: "a", 6: "b", 7: "c"}
    assert branch_point(old, {6: "b", 7: "c", 8: "d"}, None) == 7
    assert branch_point(old, {6: "x", 7: "y"}, {5: "a"}.get) == 5
    assert branch_point(old, {5: "a", 6: "b"}, None) == 6  # the tip fell back
    assert branch_point(old, {5: "x", 6: "y", 7: "z"}, None) == 4  # forked below all that is remembered


def test_a_stream_reads_both_branches(spark, node, tmp_path):
    """The offset's hashes take a stream back to the common ancestor, also after a restart from its checkpoint."""
    node.grow(6, 0)
    old = list(node.active)
    spark.dataSource.register(BlockSource)

    def read():
        q = spark.readStream.format("lodewell_blocks").options(url=node.url, start=1, slice=2, depth=5).load().writeStream.format("parquet").option("path", str(tmp_path / "o"))
        q = q.option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return [(r["height"], r["block_hash"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()]

    assert sorted(read()) == list(enumerate(old))[1:]
    node.grow(4, 7, upon=3)
    assert sorted(read()) == sorted([*list(enumerate(old))[1:], *list(enumerate(node.active))[4:]])
    assert len(read()) == 9  # nothing new, nothing twice


def follow(store, node, tmp_path, **more):
    for q in live.follow(store, str(tmp_path / "ckpt"), node.url, once=False, start=0, **more):
        q.processAllAvailable()
        q.stop()


def test_a_switch_of_branches_is_one_reorganisation(spark, node, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    node.grow(5, 0, pays=200 * BTC)
    old = list(node.active)
    follow(store, node, tmp_path)
    node.grow(3, 9, pays=300 * BTC, upon=2)
    follow(store, node, tmp_path)
    follow(store, node, tmp_path)
    reorgs = store.table("events").filter("event_type = 'REORG_DETECTED'").collect()
    assert len(reorgs) == 1 and reorgs[0]["severity"] == "MEDIUM"
    told = json.loads(reorgs[0]["metadata"])
    assert (told["old_tip"], told["new_tip"], told["common_ancestor"], told["depth"]) == (old[4], node.active[5], old[2], 2)
    assert told["disconnected_blocks"] == [old[4], old[3]] and told["connected_blocks"] == node.active[5:2:-1]
    paid = store.table("events").filter("event_type = 'LARGE_TRANSFER'")
    assert {r["block_hash"] for r in paid.collect()} == {*old, *node.active}  # events of both branches
    seen = store.all_observations().filter("kind = 'ReorgedOut'").collect()
    assert {r["block_hash"] for r in seen} == {old[3], old[4]} and {r["confirmation_status"] for r in seen} == {"reorged_out"}
    assert {r["event_id"] for r in seen} <= {r["id"] for r in paid.collect()}
    confirmed = store.all_observations().filter("kind = 'Confirmed'")
    assert confirmed.count() == confirmed.select("id").distinct().count() == 9  # one a block and the reorganisation's own
    assert store.table("headers").count() == 8


def test_run_from_the_command_line(spark, node, tmp_path):
    node.grow(3, 0, pays=200 * BTC)
    arguments = ["run", "--url", node.url, "--store", str(tmp_path / "s"), "--checkpoint", str(tmp_path / "c"), "--start", "0", "--once"]
    for _ in range(2):
        command.main(arguments, spark)
    assert Store(spark, str(tmp_path / "s")).table("events").count() == 3


def folded(blocks):
    headers, out = tip.Headers(), []
    for name, parent, height in blocks:
        out.append({"block_hash": name, **headers.add(name, parent, height)})
    return headers, out


MAIN = [(f"a{i}", f"a{i - 1}" if i else None, i) for i in range(8)]
SIDE = [("b3", "a2", 3), ("b4", "b3", 4), ("b5", "b4", 5)]


def test_late_and_repeated_blocks_change_nothing():
    headers, out = folded([*MAIN, *SIDE, *MAIN, *SIDE])
    assert headers.tip == "a7" and [x["kind"] for x in out] == ["FIRST"] + ["NEXT"] * 7 + ["SIDE"] * 3 + ["KNOWN"] * 11
    headers, out = folded([*MAIN[:5], *SIDE, *MAIN[5:]])  # the branch leads by one, then the first chain again
    moved = [x for x in out if x["kind"] == "REORG"]
    assert [(x["old_tip_hash"], x["new_tip_hash"], x["depth"], x["common_ancestor_hash"]) for x in moved] == [("a4", "b5", 2, "a2"), ("b5", "a6", 3, "a2")] and headers.tip == "a7"


def test_parents_that_come_late():
    """Whatever the order of arrival, the tip is the end of the branch with most work."""
    draw = random.Random(4)
    for _ in range(50):
        blocks = [*MAIN[1:], ("b3", "a2", 3), ("b4", "b3", 4)]
        draw.shuffle(blocks)
        headers, out = folded([MAIN[0], *blocks])
        assert headers.tip == "a7"
        assert {x["kind"] for x in out} <= {"FIRST", "NEXT", "REORG", "GAP", "SIDE"}
    headers, out = folded([MAIN[0], MAIN[2], MAIN[3], MAIN[1]])
    assert [x["kind"] for x in out] == ["FIRST", "GAP", "SIDE", "NEXT"] and out[1]["missing_from"] == 1 and out[3]["connected_blocks"] == ["a3", "a2", "a1"]


def test_the_list_of_headers_is_bounded():
    headers = tip.Headers(keep=10)
    for i in range(1000):
        headers.add(f"h{i}", f"h{i - 1}", i)
        assert len(headers.known) <= 10
    assert headers.add("old", "h900", 901) == {"kind": "OLD"}
    assert headers.add("far", "x", 2000)["kind"] == "SKIPPED" and headers.tip == "far"
    deep = tip.Headers(keep=5)
    for i in range(20):
        deep.add(f"h{i}", f"h{i - 1}", i)
    moves = [deep.add(f"n{i}", f"n{i - 1}", i) for i in range(15, 22)]  # its ancestor lies below what is kept
    assert [m["kind"] for m in moves] == ["SIDE"] * 5 + ["REORG", "NEXT"] and moves[5]["common_ancestor_hash"] is None and moves[5]["depth"] == 5


def streamed(spark, operator, batches, schema, folder):
    """What a streaming operator gives for batches, one file and micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    q = operator(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_moves_of_a_stream_equal_a_fold(spark, tmp_path):
    blocks = [*MAIN[:5], *SIDE, *MAIN[2:], ("c9", "c8", 9)]
    rows = [[(name, parent, height, f"2024-01-01 00:{i:02d}:00")] for i, (name, parent, height) in enumerate(blocks)]
    schema = "block_hash string, previous_block_hash string, height bigint, seen string"
    got = streamed(spark, lambda s: tip.moves(s.withColumn("timestamp", F.to_timestamp("seen"))), rows[:4] + [sum(rows[4:8], [])] + rows[8:], schema, tmp_path)
    _, want = folded(blocks)
    fields = ["block_hash", "kind", "old_tip_hash", "new_tip_hash", "common_ancestor_hash", "depth", "disconnected_blocks", "connected_blocks", "missing_from", "missing_to"]
    as_text = lambda rows: sorted(str([x.get(f) for f in fields]) for x in rows)
    assert as_text(r.asDict() for r in got.collect()) == as_text(want)
    assert [r["depth"] for r in tip.reorgs(got).orderBy("new_tip_height").collect()] == [2, 3]
    assert [(r["missing_from"], r["missing_to"], r["action"]) for r in tip.gaps(got).collect()] == [(8, 8, "RECONCILE")]


def plain_intervals(rows):
    out, last = {}, None
    for arrival, name, height, seconds in rows:
        fresh = last and (height > last[1] or name != last[0]) and seconds > last[2]
        out[arrival] = seconds - last[2] if fresh else None
        last = (name, height, seconds)
    return out


def test_intervals_by_arrival(spark, tmp_path):
    """Out-of-order and repeated blocks: batch, stream and fold agree."""
    draw = random.Random(9)
    rows, height = [], 0
    for arrival in range(1, 61):
        height += draw.choice([1, 1, 1, 0, -1])
        rows.append(rows[-1][:0] + (arrival, *rows[-1][1:]) if rows and draw.random() < 0.2 else (arrival, f"h{arrival}", height, 1000 + 600 * height + draw.randint(-900, 900)))
    schema = "arrival bigint, block_hash string, height bigint, s bigint"
    stamped = lambda df: df.withColumn("timestamp", F.timestamp_seconds("s"))
    want = plain_intervals(rows)
    batch = chain.arrival_intervals(stamped(spark.createDataFrame(rows, schema)), run=7)
    assert {r["arrival"]: r["interval_seconds"] for r in batch.collect()} == want
    got = streamed(spark, lambda s: tip.arrival_intervals(stamped(s)), [rows[:1], rows[1:30], rows[30:31], rows[31:]], schema, tmp_path)
    assert {r["arrival"]: r["interval_seconds"] for r in got.collect()} == want


def test_headers_by_built_in_functions(spark):
    raw = raw_block("ab" * 31 + "01", 1_400_000_123, [raw_tx([], [BTC])])
    r = decoders.headers(spark.createDataFrame([(bytearray(raw),), (bytearray(b"short"),)], "body binary")).selectExpr("previous_block_hash", "unix_seconds(timestamp) AS s").collect()
    assert [tuple(x) for x in r] == [("ab" * 31 + "01", 1_400_000_123)]


def test_life_cycle_of_an_observation(spark, tmp_path):
    """Mempool, confirmed, reorganised out, back in the mempool: one event, four observations; repeats change nothing."""
    store = Store(spark, str(tmp_path))
    event = spark.createDataFrame([("e", "2024-01-01", None, None)], "id string, t string, block_height bigint, block_hash string").withColumn("event_time", F.to_timestamp("t"))
    inside = event.withColumns({"block_height": F.lit(7).cast("bigint"), "block_hash": F.lit("a")})
    gone = spark.createDataFrame([("a",)], "block_hash string").withColumn("gone_at", F.to_timestamp(F.lit("2024-01-02")))
    for _ in range(2):
        store.save_observations(live.observations(store, event) if not store.has("observations") else live.observations(store, event.filter("false")))
        store.save_observations(live._confirmed(inside))
        store.save_observations(live._reorged_out(store.all_observations(), gone))
    store.save_observations(live.observations(store, event))
    assert sorted((r["kind"], r["confirmation_status"]) for r in store.observations("e").collect()) == [
        ("Confirmed", "confirmed"), ("MempoolSeen", "reentered"), ("MempoolSeen", "unconfirmed"), ("ReorgedOut", "reorged_out"),
    ]


def test_observations_take_the_last_source(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = lambda n, status, height: spark.createDataFrame([("o", "e", n, status, height)], "id string, event_id string, source_sequence bigint, confirmation_status string, block_height bigint").selectExpr(
        "id", "event_id", "'live' AS mode", "'Confirmed' AS kind", "concat('p', source_sequence) AS provider", "'t' AS transport", "CAST(null AS string) AS replay_job_id", "timestamp'2024-01-01' AS observed_at",
        "timestamp'2024-01-01' AS bitcoin_time", "block_height", "'b' AS block_hash", "confirmation_status", "source_sequence", "CAST(null AS bigint) AS mempool_sequence", "CAST(null AS string) AS witness",
    )
    store.save_observations(one(1, "seen", 5))
    store.save_observations(one(2, "confirmed", 9))
    r = store.observations("e").collect()
    assert [(x["provider"], x["source_sequence"], x["confirmation_status"], x["block_height"]) for x in r] == [("p2", 2, "confirmed", 5)]


def plain_dedup(rows, ttl):
    """(first events, witnesses and number of each) of rows in the order of time."""
    held, out = {}, []
    for key, seconds, order, witness in sorted(rows, key=lambda r: (r[1], r[2])):
        entry = held.get(key)
        if entry is None or seconds - entry[1] >= ttl:
            entry = held[key] = [key, seconds, order, 0, set()]
            out.append(entry)
        entry[3] += 1
        entry[4] |= {witness} - {None}
    return out


def test_dedup_with_state_that_expires(spark, tmp_path):
    """First events and their witnesses equal a fold and the batch operator; the state does not grow with the stream."""
    draw = random.Random(8)
    rows = [(f"k{draw.randint(0, 3)}" if i % 3 else f"once{i}", i * 5 + draw.randint(0, 4), i, draw.choice(["a", "b", "c", None])) for i in range(400)]
    schema, ttl = "k string, t bigint, id bigint, w string", 60
    for n in range(8):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    spark.createDataFrame([("end", 10_000, 999, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "8"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stateful.expiring_dedup(source, "k", "t", "id", "w", ttl).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), plain_dedup(rows, ttl)
    first = {(r["key"], r["seconds"], r["ord"]) for r in got.filter("kind = 'FIRST' AND key <> 'end'").collect()}
    assert first == {(k, t, o) for k, t, o, _, _ in want}
    batch = provenance.dedup_ttl(spark.createDataFrame(rows, schema), ["k"], F.col("t"), "id", ttl)
    assert {r["id"] for r in batch.collect()} == {o for _, _, o in first}
    closed = {(r["key"], r["first_order"]): (r["n_seen"], r["witnesses"]) for r in got.filter("kind = 'CLOSED'").collect()}
    assert closed == {(k, o): (n, sorted(w)) for k, t, o, n, w in want}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len({k for k, *_ in rows}) > 130 and max(held) < 130  # entries, timers and their index of the keys of one window
