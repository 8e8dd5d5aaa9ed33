"""The store's questions over small tables."""

import pytest
from pyspark.sql import functions as F

from lodewell.operators import metrics
from lodewell.plans import replay_run
from lodewell.plans.store import Store, event_type


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(f"e{i}", "LARGE_TRANSFER", i, f"2024-01-{i % 28 + 1:02d} 00:00:00", "live", '{"total_output_sats": %d, "vsize": "x"}' % (i % 100)) for i in range(200)]
    events = spark.createDataFrame(rows, "id string, event_type string, block_height bigint, event_time string, observation_mode string, metadata string")
    events = events.withColumns({"event_time": F.to_timestamp("event_time"), "network": F.lit("mainnet")})
    store.append("events", events)
    store.append("observations", events.filter("block_height < 5").select(F.concat(F.lit("o"), "id").alias("id"), F.col("id").alias("event_id"), F.lit("historical_replay").alias("mode"), F.col("event_time").alias("observed_at")))
    store.append("event_metrics", metrics.extract(events).withColumnRenamed("id", "event_id"))
    assert store.query_events(event_type="large_transaction", heights=(10, 19)).count() == 10
    assert store.query_events(mode="historical_replay").count() == 5
    assert len(store.event("e1").first()["observations"]) == 1 and store.observations("e9").count() == 0
    store.append_new("observations", store.table("observations"), "id")
    assert store.table("observations").count() == 5
    run = store.save_baseline(0, 199)
    r = store.event_rarity("e50", run).first()
    assert (r["percentile"], r["tail"], r["sample_count"], r["band"], r["evaluation_mode"], r["one_in"]) == (51.0, 100, 200, "COMMON", "RETROSPECTIVE", 2)
    assert store.rarity(run).filter("id = 'e50'").first()["percentile"] == 51.0
    early = store.save_baseline(0, 49)
    assert store.event_rarity("e50", early).first()["band"] == "INSUFFICIENT_DATA"
    d = store.event_detail("e50", run).first()
    assert d["primary"]["metric"] == "value_sats" and d["primary"]["percentile"] == 51.0 and d["secondary"] == [] and d["impact"] is None and d["component_coverage"] == 0.25
    assert {r["baseline_run_id"] for r in store.distributions("large_transaction", "value_sats").collect()} == {run, early}
    store.save_event_texts(spark.createDataFrame([("e1", "new title", None, "{}")], "id string, title string, description string, metadata string"))
    assert store.events().filter("id = 'e1'").first()["metadata"] == "{}" and store.events().count() == 200
    assert store.create_baseline(0, 199).first()["p50"] == 49
    assert event_type("fanout") == "FAN_OUT" and store.create_replay(1, 5).first()["status"] == "PENDING"


def test_extraction_of_scaled_metrics(spark):
    df = spark.createDataFrame([("a", "CONSOLIDATION", '{"input_count": 30, "input_output_ratio": 2.345}'), ("b", "REORG_DETECTED", "{}")], "id string, event_type string, metadata string")
    df = df.withColumns({"network": F.lit(None).cast("string"), "block_height": F.lit(None).cast("bigint")})
    out = metrics.extract(df).withColumn("text", metrics.numeric_text(F.col("value"), F.col("scale")))
    got = {r["metric"]: (r["text"], r["network"], r["block_height"]) for r in out.collect()}
    assert got["input_count"] == ("30", "mainnet", 0) and got["consolidation_ratio"][0] in ("2.35", "2.34") and len(got) == 2


def test_runs_and_events_of_one_network_and_of_a_job(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(f"e{i}", "LARGE_TRANSFER", i % 50, "mainnet" if i < 50 else "testnet", None if i % 2 else "job", '{"total_output_sats": %d}' % i) for i in range(200)]
    events = spark.createDataFrame(rows, "id string, event_type string, block_height bigint, network string, replay_job_id string, metadata string")
    events = events.withColumns({"event_time": F.timestamp_seconds(F.col("block_height")), "block_hash": F.lit("b"), "observation_mode": F.lit("live")})
    store.append("events", events)
    store.append("event_metrics", metrics.extract(events).withColumnRenamed("id", "event_id"))
    row = store.create_baseline(0, 49).filter("metric = 'value_sats'").first()
    assert (row["sample_count"], row["candidate_count"], row["coverage_ratio"]) == (50, 50, 1.0)  # candidates of the other network do not count
    run = store.save_baseline(0, 49)
    assert store.rarity(run, least=10, event_id="e10").filter("metric = 'value_sats'").count() == 1
    with pytest.raises(ValueError, match="testnet"):
        store.rarity(run, least=10, event_id="e60")
    store.save_observations(replay_run.observations(events.filter("id IN ('e1', 'e3')"), "job"))
    assert store.query_events(job="job", limit=1000).count() == 102 and store.query_events(job="other").count() == 0
