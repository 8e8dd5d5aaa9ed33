"""Keyed tables: versions, merges, look-ups that read what they ask for, writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from lodewell.plans.store import Store
from lodewell.plans.versions import Keyed, Versions

TABLES = {"new": Keyed(("k",)), "merge": Keyed(("k",), "merge", ("b",)), "whole": Keyed(("k",), "whole")}


def made(spark, path, bucket_rows=1_000_000):
    return Versions(spark, str(path), TABLES.get, bucket_rows)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, tables, name, data, replaced=None):
    shape = "k bigint, a string, b string"
    return tables.put({name: spark.createDataFrame(data, shape)}, replaced=replaced)


def test_writes_of_a_key_meet_as_their_table_says(spark, tmp_path):
    t = made(spark, tmp_path)
    for name in ("new", "merge"):
        put(spark, t, name, [(1, "x", "x"), (2, "x", "x")])
        put(spark, t, name, [(2, "y", "y"), (3, "y", "y")])
    assert rows(t.read("new")) == [(1, "x", "x"), (2, "x", "x"), (3, "y", "y")]
    assert rows(t.read("merge")) == [(1, "x", "x"), (2, "x", "y"), (3, "y", "y")]
    put(spark, t, "whole", [(1, "x", "1"), (1, "x", "2"), (2, "x", "1")])
    put(spark, t, "whole", [(1, "y", "3")], spark.createDataFrame([(1,), (2,)], "k bigint"))
    assert rows(t.read("whole")) == [(1, "y", "3")]
    assert rows(t.read("whole", version=5)) == [(1, "x", "1"), (1, "x", "2"), (2, "x", "1")]
    assert t.read("merge", version=2) is None and t.read("none") is None
    put(spark, t, "new", [])
    assert t.read("new").count() == 3


@pytest.mark.parametrize("name", sorted(TABLES))
def test_many_writes_equal_a_plain_fold_and_are_few_runs(spark, tmp_path, name):
    t, want = made(spark, tmp_path, bucket_rows=4), {}
    for n in range(9):
        data = [(k, f"a{n}", f"b{n}") for k in range(n, n + 5)]
        put(spark, t, name, data)
        for k, a, b in data:
            old = want.get(k)
            want[k] = (k, a, b) if old is None or name == "whole" else old if name == "new" else (k, old[1], b)
    runs = t.state()["tables"][name]
    assert rows(t.read(name)) == sorted(want.values()) and len(runs) < 6 and max(r["buckets"] for r in runs) > 1
    t.compact(name, all_runs=True)
    assert rows(t.read(name)) == sorted(want.values()) and len(t.state()["tables"][name]) == 1
    asked = spark.createDataFrame([(1,), (12,), (99,)], "k int")  # of another integer type than the table's
    assert rows(t.lookup(name, asked)) == [want[1], want[12]]
    t.vacuum(keep=1, unseen_seconds=0)
    assert len(t.numbers()) == 1 and rows(t.read(name)) == sorted(want.values())


def bytes_read(spark, df):
    """Sizes of the files that a plan's scans choose."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.execute().count()
        leaves, total = plan.collectLeaves(), 0
        for i in range(leaves.size()):
            got = leaves.apply(i).metrics().get("filesSize")
            if got.isDefined() and "k#" in leaves.apply(i).toString() and "__bucket" in leaves.apply(i).toString():
                total += got.get().value()
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_look_up_reads_no_more_of_a_longer_table(spark, tmp_path):
    sizes = {}
    for n in (2_000, 32_000):
        t = made(spark, tmp_path / str(n), bucket_rows=500)
        t.put({"new": spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.lit("").alias("b"))})
        asked = spark.createDataFrame([(17,), (1234,)], "k bigint")
        found = t.lookup("new", asked)
        assert [r[0] for r in rows(found)] == [17, 1234]
        sizes[n] = (bytes_read(spark, found), bytes_read(spark, t.read("new")))
    assert 0 < sizes[32_000][0] < 1.5 * sizes[2_000][0] and sizes[32_000][1] > 8 * sizes[2_000][1], sizes


def test_writers_at_once_lose_nothing_and_write_no_key_twice(spark, tmp_path):
    failed = []

    def write(first):
        try:
            mine = made(spark, tmp_path)
            for n in range(3):
                put(spark, mine, "new", [(k, str(first), "") for k in range(n * 4, n * 4 + 6)])
                put(spark, mine, "merge", [(first * 10 + n, str(first), str(n))])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    t = made(spark, tmp_path)
    assert not failed and [r[0] for r in rows(t.read("new"))] == list(range(14))
    assert [r[0] for r in rows(t.read("merge"))] == [i * 10 + n for i in range(3) for n in range(3)]
    assert t.numbers() == list(range(1, len(t.numbers()) + 1))


def test_an_incident_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))

    def save(title, nodes):
        store.save_incident(
            spark.createDataFrame([("c", title)], "id string, title string"), spark.createDataFrame([("c", title)], "incident_id string, as_of string"),
            {"evidence": spark.createDataFrame([("c", n) for n in nodes], "incident_id string, node int"), "messages": spark.createDataFrame([], "incident_id string, text string")},
        )

    def seen():
        r = store.dossier("c", {"evidence": ["node"], "messages": ["text"]}).first()
        return r["title"], [e["node"] for e in r["evidence"]]

    save("one", [1, 2])
    pinned = store.at()
    assert seen() == ("one", [1, 2])
    monkeypatch.setattr(store.versions, "_publish", lambda state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        save("two", [3])
    assert seen() == ("one", [1, 2])
    monkeypatch.undo()
    save("three", [])
    assert seen()[0] == "three" and store.table("incident_evidence").isEmpty() and store.table("incident_snapshots").count() == 2
    assert pinned.table("incident_evidence").count() == 2 and pinned.dossier("c", {"evidence": ["node"]}).first()["title"] == "one"
