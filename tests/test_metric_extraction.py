"""Metric extraction reads each table as few times as it can, and what it leaves out changes no result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodewell.operators import detectors, metrics
from lodewell.plans import registry
from lodewell.plans import surrogate as views

LINES = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double, l_returnflag string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_totalprice double, o_orderstatus string, o_orderpriority string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    day = lambda n: dt.datetime(1995, 1, 1) + dt.timedelta(days=n)
    lines = [(k, None if i == 3 else s % 4, 1, day(k * 300 + i), None if (k, i) == (5, 0) else 60_000.0 * k + i, 0.05 * (i % 3), "ANR"[i % 3]) for k in range(12) for i, s in enumerate(range(k, k + 2 * k))]
    lines += [(99, 1, 1, day(1), 900_000.0, 0.1, "A"), (None, 1, 1, day(1), 900_000.0, 0.1, "A")]  # without an order
    orders = [(k, k, day(k), 1.0, "F", "1-URGENT") for k in [*range(12), 50, 7]]  # 50 has no line, 7 comes twice
    events = [(i, day(i), i % 2, "view", 1.0, "{}") for i in range(9)]
    for name, rows, schema in (("lineitem", lines, LINES), ("orders", orders, ORDERS), ("events", events, EVENTS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("where", ["output_count >= 8", "total_output_sats >= 40000000", "fee_sats >= 2000000 OR fee_sats / vsize >= 6000", "output_count = 10"])
def test_transactions_of_a_condition(spark, tables, where):
    want = views.tx(spark, tables).filter(where)
    got = views.tx_where(spark, tables, F.expr(where)).select(want.columns)
    assert rows(want) == rows(got) != []


def test_metrics_need_their_own_fields_only(spark, tables):
    names = {"large_transfer": "LARGE_TRANSFER", "long_interval": "LONG_BLOCK_INTERVAL", "dormant": "DORMANT_COINS_MOVED", "consolidation": "CONSOLIDATION", "fan_out": "FAN_OUT", "extreme_fee": "EXTREME_FEE"}
    want = []
    for name, kind in names.items():
        found = registry.ALL[name](spark, tables)
        whole = rows(metrics.extract(detectors.canonical(found)))
        assert rows(metrics.extract(detectors.canonical(found, fields=metrics.fields_of(kind)))) == whole
        want += whole
    got = registry.metric_extraction(spark, tables)
    assert got.count() == len(want) and {r["event_type"] for r in got.select("event_type").collect()} >= {"LARGE_TRANSFER", "FAN_OUT", "EXTREME_FEE"}


def test_metric_extraction_reads_the_lines_once_for_its_transactions(spark, tables):
    plan = registry.metric_extraction(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    reads = [x for x in plan.splitlines() if "Relation [l_orderkey" in x]
    assert len(reads) == 2  # sweeps and inputs; the transactions of three detectors come from a written table
    assert not any("Window" in x and "txid" in x for x in plan.splitlines())  # totals of inputs are no metric
