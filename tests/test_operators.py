"""Golden vectors of the chain operators."""

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from lodewell.functions import money
from lodewell.functions.identity import uuid5
from lodewell.operators import baseline, chain, detectors, metrics, provenance, replay, watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sats_from_text(spark):
    cases = {".5": 50_000_000, "0.00000001": 1, "21000000": 2_100_000_000_000_000, " 1.5 ": 150_000_000, "1.123456789": 112_345_678, "21000001": None, "-1": None, "1.2.3": None, "": None, "abc": None, ".": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want bigint").withColumn("got", money.btc_to_sats(F.col("t")))
    assert {r["t"]: r["got"] for r in df.collect()} == cases
    assert one(spark, money.parse_error(F.lit("-1"))) == "negative"


def test_small_expressions(spark):
    assert one(spark, money.vsize_of_weight(F.lit(5))) == 2 and one(spark, money.vsize_of_weight(F.lit(9))) == 3
    assert one(spark, money.halving_epoch(F.lit(209_999))) == 0 and one(spark, money.halving_epoch(F.lit(210_000))) == 1
    assert one(spark, money.fee_rate(F.lit(10), F.lit(0))) is None
    assert one(spark, money.satoshi_days(F.lit(2_100_000_000_000_000), F.lit(6600))) == 2_100_000_000_000_000 * 6600


def test_event_id_is_uuid5(spark):
    assert one(spark, uuid5(F.lit("LargeTransfer:tx:tx_123"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "LargeTransfer:tx:tx_123"))


def metric_rows(spark, values):
    return spark.createDataFrame([("T", "m", v) for v in values], "event_type string, metric string, value bigint")


def test_quantiles(spark):
    cand = spark.createDataFrame([("T", 10)], "event_type string, candidate_count bigint")
    r = baseline.distributions(metric_rows(spark, range(10, 101, 10)), cand, ["event_type", "metric"]).first()
    assert (r["p50"], r["p75"], r["p90"], r["p95"], r["p99"], r["p999"], r["mean"]) == (50, 80, 90, 100, 100, 100, 55.0)


def test_rank_ties(spark):
    rows = baseline.exact_ranks(metric_rows(spark, [10, 10, 10, 20, 20, 30]), ["event_type", "metric"]).collect()
    got = {r["value"]: (round(r["percentile"], 2), r["tail"]) for r in rows}
    assert got == {10: (50.0, 6), 20: (83.33, 3), 30: (100.0, 1)}
    rows = baseline.exact_ranks(metric_rows(spark, [10, 10, 10, 20, 20, 30]), ["event_type", "metric"], lower_is_rarer=True).collect()
    assert {r["value"]: r["tail"] for r in rows} == {10: 3, 20: 5, 30: 6}


def test_bands_and_impact(spark):
    assert one(spark, baseline.band(F.lit(99.0), F.lit(5), 100)) == "INSUFFICIENT_DATA"
    ranked = spark.createDataFrame([("e", "T", "a", 99.94, 1000), ("e", "T", "b", 95.0, 1000)], "id string, event_type string, metric string, percentile double, population bigint")
    weights = spark.createDataFrame([("T", "a", 60.0, 4), ("T", "b", 15.0, 4)], "event_type string, metric string, weight double, components int")
    assert baseline.impact(ranked, weights, "id", ["event_type", "metric"]).first()["score"] == 73.43
    few = baseline.impact(ranked.filter("metric = 'a'"), weights, "id", ["event_type", "metric"]).first()
    assert few["score"] is None and few["component_coverage"] == 0.25


DORMANT = "txid string, ts timestamp_ntz, block_height bigint, confirmed_at timestamp_ntz, confirmed_height bigint, value_sats bigint, input_count bigint, total_input_sats bigint, total_output_sats bigint"


def test_dormant_mixes_ages(spark):
    day = lambda y: dt.datetime(y, 1, 1)
    rows = [("t", day(2018), None, day(2011), None, 600, 2, 1000, 990), ("t", day(2018), None, day(2017), None, 400, 2, 1000, 990), ("u", day(2013), None, day(2011), None, 900, 1, 900, 900)]
    found = detectors.dormant_coins(spark.createDataFrame(rows, DORMANT), 1825, 100, 1).collect()
    assert [(r["event_key"], r["total_dormant_sats"], r["dormant_input_count"], r["total_input_count"], r["dormant_ratio"]) for r in found] == [("DormantCoinsMoved:tx:t", 600, 1, 2, 0.6)]
    days = (day(2018) - day(2011)).days
    assert (found[0]["coin_age_destroyed_sats_days"], found[0]["coin_age_destroyed_btc_days"], found[0]["oldest_input_age_seconds"]) == (600 * days, 600 * days / 10**8, days * 86_400)


def test_dormant_by_height(spark):
    """An input without a time ages 600 seconds a block; the class is that of the oldest input, not of the least height."""
    now = dt.datetime(2024, 1, 1)
    rows = [("h", now, 500_000, None, 150_000, 10, 2, 30, 30), ("h", now, 500_000, dt.datetime(2016, 1, 1), 90_000, 20, 2, 30, 30), ("young", now, 500_000, None, 499_000, 10, 1, 10, 10), ("none", now, None, None, 1, 10, 1, 10, 10)]
    found = detectors.dormant_coins(spark.createDataFrame(rows, DORMANT), 1825, 1, 1).collect()
    assert [(r["event_key"], r["dormant_input_count"], r["classification"]) for r in found] == [("DormantCoinsMoved:tx:h", 2, "EARLY_BITCOIN")]
    found = detectors.dormant_coins(spark.createDataFrame(rows[:1], DORMANT), 1825, 1, 1).first()
    assert (found["oldest_input_age_seconds"], found["classification"]) == (350_000 * 600, "DORMANT")


def test_dormant_event_has_all_its_metrics(spark):
    from lodewell.operators import metrics

    rows = [("t", dt.datetime(2018, 1, 1), 500_000, dt.datetime(2011, 1, 1), None, 600, 1, 600, 600)]
    events = detectors.canonical(detectors.dormant_coins(spark.createDataFrame(rows, DORMANT), 1825, 100, 1))
    assert {r["metric"] for r in metrics.extract(events).collect()} == {m for kind, m, *_ in metrics.REGISTRY if kind == "DORMANT_COINS_MOVED"}


def test_interpolation_where_lower_is_rarer(spark):
    points = [(0.0, F.lit(10)), (50.0, F.lit(20)), (100.0, F.lit(40))]
    df = spark.createDataFrame([(5,), (15,), (50,)], "v bigint")
    for lower, want in ((False, [0.0, 25.0, 100.0]), (True, [100.0, 25.0, 0.0]), (F.lit(True), [100.0, 25.0, 0.0])):
        assert [r[0] for r in df.select(baseline.interpolated(F.col("v"), points, F.lit(8), lower)[0].alias("p"), "v").orderBy("v").collect()] == want


def test_ranks_over_many_partitions(spark):
    """One group with many distinct values next to small ones, range-partitioned and added up."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rows = [("T", "m", (i * 7919) % 1000) for i in range(3000)] + [("U", "m", 5)] * 4 + [("V", "m", i) for i in range(3)]
    df = spark.createDataFrame(rows, "event_type string, metric string, value bigint")
    got = {(r["event_type"], r["value"]): (r["le"], r["ge"], r["population"]) for r in baseline.value_ranks(df, ["event_type", "metric"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {(k, v): (sum(x <= v for kk, _, x in rows if kk == k), sum(x >= v for kk, _, x in rows if kk == k), sum(kk == k for kk, _, x in rows)) for k, _, v in set(rows)}


def test_event_without_its_primary_metric(spark):
    rows = spark.createDataFrame([("a", "T", "m", 5, "EXACT", 50.0, 1, 200, "COMMON", "RETROSPECTIVE"), ("a", "T", "other", 5, "EXACT", 50.0, 1, 200, "COMMON", "RETROSPECTIVE")], "id string, event_type string, metric string, value bigint, method string, percentile double, tail bigint, sample_count bigint, band string, evaluation_mode string")
    events = spark.createDataFrame([("a", "T", 5), ("b", "T", 99)], "id string, event_type string, block_height bigint")
    got = {(r["id"], r["metric"]): r for r in baseline.with_primary(rows, events, {"T": "m"}, 10).collect()}
    assert got["a", "m"]["is_primary"] and not got["a", "other"]["is_primary"] and len(got) == 3
    assert (got["b", "m"]["value"], got["b", "m"]["percentile"], got["b", "m"]["band"], got["b", "m"]["evaluation_mode"]) == (0, None, "INSUFFICIENT_DATA", "POINT_IN_TIME")


def test_amounts_from_doubles(spark):
    df = spark.createDataFrame([(0.1,), (-1.0,), (float("nan"),), (float("inf"),), (2.2e7,), (None,)], "x double")
    assert [r[0] for r in df.select(money.float_to_sats(F.col("x"))).collect()] == [10_000_000, None, None, None, None, None]
    assert one(spark, money.btc_days(F.lit(250_000_000))) == 2.5


def test_tips_and_gaps(spark):
    assert chain.tip_continuity(10, 11) == ("NEXT", range(11, 12)) and chain.tip_continuity(10, 14)[0] == "GAP" and chain.tip_continuity(10, 500) == ("SKIPPED", range(500, 501)) and chain.tip_continuity(10, 9)[0] == "BEHIND"
    tips = spark.createDataFrame([("a", 9, 0, "active"), ("b", 8, 1, "valid-fork"), ("c", 8, 3, "headers-only"), ("d", 7, 2, "invalid")], "hash string, height bigint, branchlen bigint, status string")
    assert [r["hash"] for r in chain.competing_tips(tips).collect()] == ["c", "b"]
    states = spark.createDataFrame([(1, "Gap", 5), (2, "Gap", 101), (3, "Stale", None)], "i bigint, state string, missed bigint")
    assert {r["i"]: r["action"] for r in chain.gap_requests(states, "i").collect()} == {1: "RECONCILE", 2: "SKIP"}


def test_reorg_severity(spark):
    df = spark.createDataFrame([(str(n), n) for n in (0, 1, 2, 3, 5, 6)], "new_tip_hash string, depth bigint")
    assert [r["severity"] for r in detectors.reorg(df).orderBy("depth").collect()] == ["LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_sequences_wrap_and_stale(spark):
    seqs = [5, 5, 6, 9, 7, 4294967295, 10, 11]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(seqs)], "k string, i bigint, s bigint")
    states = [r["state"] for r in chain.sequence_states(df, "k", "i", "s").orderBy("i").collect()]
    assert states == ["Initial", "Duplicate", "Consecutive", "Gap", "Stale", "Stale", "Consecutive", "Consecutive"]
    df = spark.createDataFrame([("k", 0, 4294967295), ("k", 1, 0), ("k", 2, 3)], "k string, i bigint, s bigint")
    assert [(r["state"], r["missed"]) for r in chain.sequence_states(df, "k", "i", "s").orderBy("i").collect()] == [("Initial", None), ("Consecutive", None), ("Gap", 2)]


def test_lineage_stops_at_depth(spark):
    spends = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "prev_txid string, txid string")
    seeds = spark.createDataFrame([("a", "a")], "txid string, root string")
    assert sorted((r["txid"], r["depth"]) for r in watch.lineage(seeds, spends, 3).collect()) == [("b", 1), ("c", 2), ("d", 3)]


def test_outpoint_needs_its_index(spark):
    inputs = spark.createDataFrame([("s", "T", 1, 5), ("u", "t", 0, 5)], "txid string, prev_txid string, prev_vout bigint, value_sats bigint")
    targets = spark.createDataFrame([("x", "OUTPOINT", "t", 0, True)], "id string, target_type string, txid string, vout bigint, active boolean")
    assert [r["txid"] for r in watch.by_outpoint(inputs, targets).collect()] == ["u"]


def test_merge_keeps_first_but_for_text(spark):
    writes = spark.createDataFrame([("a", 1, "live", "old"), ("a", 2, "replay", "new")], "id string, seq bigint, mode string, title string")
    r = provenance.merge_events(writes).first()
    assert (r["mode"], r["title"]) == ("live", "new")


def test_ttl_is_not_extended(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate((0, 50, 99, 100, 150, 200))], "k string, i bigint, t bigint")
    assert sorted(r["i"] for r in provenance.dedup_ttl(df, ["k"], F.col("t"), "i", 100).collect()) == [0, 3, 5]


def test_alert_rules_in_order(spark):
    s = lambda a, c, v: one(spark, watch.alert_severity(F.lit(a), F.lit(c), F.lit(v)))
    assert s("WATCHED_OUTPOINT_SPENT", "DIRECT", 1) == "HIGH"
    assert s("WATCHED_ADDRESS_SPENT", "HEURISTIC", 10**12) == "MEDIUM"
    assert s("NEW_DESCENDANT_OBSERVED", "STRUCTURAL", 600_000_000) == "HIGH"
    assert s("NEW_DESCENDANT_OBSERVED", "STRUCTURAL", 6) == "LOW"


def test_interval_across_runs_with_missing_blocks(spark):
    from pyspark.sql import functions as F

    from lodewell.operators import chain

    rows = [(99_998, 1_000), (300_000, 61_000), (300_001, 61_600)]
    blocks = spark.createDataFrame(rows, "height bigint, t bigint").select("height", F.timestamp_seconds("t").alias("timestamp"), F.lit(1).alias("c"))
    for per in (None, "c"):
        got = {r["height"]: r["interval_seconds"] for r in chain.block_intervals(blocks, per=per).collect()}
        assert got == {99_998: None, 300_000: 60_000, 300_001: 600}


def test_numbers_written_and_read_back(spark):
    rows = [("0", 0), ("17", 0), ("2.35", 2), ("0.05", 2), ("-1.20", 2), ("7", 2), ("7.5", 2), ("1.234", 2), ("x", 0), ("", 0), (None, 0)]
    got = spark.createDataFrame(rows, "t string, s int").withColumn("v", metrics.value_of_text(F.col("t"), F.col("s")))
    values = {r["t"]: None if r["v"] is None else int(r["v"]) for r in got.collect()}
    assert values == {"0": 0, "17": 17, "2.35": 235, "0.05": 5, "-1.20": -120, "7": 700, "7.5": 750, "1.234": None, "x": None, "": None, None: None}
    again = got.filter("t IN ('17', '2.35', '0.05')").withColumn("back", metrics.numeric_text(F.col("v"), F.col("s"))).collect()
    assert all(r["back"] == r["t"] for r in again)


def test_replayed_events_are_stamped(spark):
    rows = [("a", 5, "h", '{"fee_sats":1}'), ("b", None, None, "{}")]
    df = spark.createDataFrame(rows, "id string, block_height bigint, block_hash string, metadata string").withColumn("event_time", F.timestamp_seconds(F.lit(60)))
    got = {r["id"]: json.loads(r["metadata"]) for r in replay.stamp(df, "j").collect()}
    assert got["a"] == {"fee_sats": 1, "observation_mode": "historical_replay", "replay_job_id": "j", "historical_height": 5, "historical_block_hash": "h", "historical_timestamp": "1970-01-01T00:01:00.000Z"}
    assert set(got["b"]) == {"observation_mode", "replay_job_id", "historical_timestamp"}
