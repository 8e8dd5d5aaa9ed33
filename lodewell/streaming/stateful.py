"""Arrival-ordered state over streams: dedup with a time to live and state that expires, sequence checks, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: the class name of Spark's store for states of several variables.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams with states of several variables need Spark's store for them; one that a session names itself stays."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").rsplit(".", 1)[-1] == "HDFSBackedStateStoreProvider":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def dedup_stream(events: DataFrame, key: str, seconds: str, order: str, ttl: int) -> DataFrame:
    """Events of a stream let through when ttl has passed since the last one let through, for each key.

    Within a batch a key's events are taken in (seconds, order); the state is one number a key.
    """
    kinds = dict(events.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([seconds, order])
        keep = []
        for t in rows[seconds]:
            fresh = last is None or t - last >= ttl
            keep.append(fresh)
            last = int(t) if fresh else last
        state.update((last,))
        yield rows.loc[keep, [key, seconds, order]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, seconds, order))
    return events.select(key, seconds, order).groupBy(key).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


#: Rows of expiring_dedup.
DEDUP = "key string, kind string, first_seconds bigint, first_order bigint, seconds bigint, ord bigint, n_seen bigint, witnesses array<string>"


class _Expiring(StatefulProcessor):
    """One entry a key: the event let through, who witnessed it, and a timer at the end of its time to live."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "first_seconds bigint, first_order bigint, last_order bigint, n_seen bigint, witnesses string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        fresh = held
        out = []
        for r in pd.concat(list(rows)).sort_values(["seconds", "ord"]).itertuples():
            t, o = int(r.seconds), int(r.ord)
            known = set(held[4].split("\n")) - {""} if held else set()
            if held is None or t - held[0] >= self.ttl:
                if held is not None:
                    out.append(self._row(key[0], "CLOSED", held))
                held = (t, o, o, 1, r.witness or "")
                out.append(self._row(key[0], "FIRST", held, t, o))
            else:
                new = r.witness and r.witness not in known
                held = (held[0], held[1], o, held[3] + 1, "\n".join(sorted(known | ({r.witness} if r.witness else set()))))
                if new:
                    out.append(self._row(key[0], "WITNESS", held, t, o))
        self.entry.update(held)
        if fresh is None or fresh[0] != held[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[0] + self.ttl) * 1000)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            held = self.entry.get()
            if (held[0] + self.ttl) * 1000 <= timerValues.getCurrentWatermarkInMs():
                self.entry.clear()
                yield self._frame([self._row(key[0], "CLOSED", held)])

    @staticmethod
    def _row(key, kind, held, seconds=None, order=None) -> tuple:
        return (key, kind, held[0], held[1], held[0] if seconds is None else seconds, held[2] if order is None else order, held[3], [w for w in held[4].split("\n") if w])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DEDUP.split(", ")])

    def close(self) -> None:
        pass


def expiring_dedup(events: DataFrame, key: str, seconds: str, order: str, witness: str, ttl: int, late: int = 0) -> DataFrame:
    """Dedup over a stream whose state ends: rows FIRST, WITNESS and CLOSED of each key.

    FIRST is an event let through, as ``dedup_stream`` has it. WITNESS is a later one within ``ttl`` seconds of it that
    another witness saw: it joins the first one's witnesses. CLOSED is told when the time of a first one is over, with all
    its witnesses and how many events it stands for; its entry leaves the state then, by a timer of event time, which lags
    the greatest time seen by ``late`` seconds. So the state holds the keys seen within ttl + late, however long the stream.
    """
    keyed_state(events.sparkSession)
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(seconds).cast("bigint").alias("seconds"), F.col(order).cast("bigint").alias("ord"), F.col(witness).cast("string").alias("witness"),
        F.timestamp_seconds(F.col(seconds)).alias("at"),
    )
    rows = rows.withWatermark("at", f"{late} seconds")
    return rows.groupBy("key").transformWithStateInPandas(_Expiring(ttl), DEDUP, "Append", "EventTime")


def sequence_stream(messages: DataFrame, key: str, order: str, seq: str) -> DataFrame:
    """Initial, Consecutive, Duplicate, Gap or Stale for each message, with 32-bit wrap-around."""
    kinds = dict(messages.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for s in rows[seq]:
            diff = None if last is None else (int(s) - last) % (1 << 32)
            kind = "Initial" if diff is None else "Duplicate" if diff == 0 else "Consecutive" if diff == 1 else "Gap" if diff < 1 << 31 else "Stale"
            out.append((kind, diff - 1 if kind == "Gap" else 0))
            if kind not in ("Duplicate", "Stale"):
                last = int(s)
        state.update((last,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "state": [x[0] for x in out], "missed": [x[1] for x in out]})

    return messages.select(key, order, seq).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, state string, missed bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def append_new(path: str, key: str):
    """A foreachBatch sink that appends rows whose key is not stored yet; a batch that runs twice adds nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            stored = spark.read.parquet(path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        (rows if stored is None else rows.join(stored, key, "left_anti")).write.mode("append").parquet(path)

    return sink
