"""Canonical events and their observations: conservative merge, dedup, retention, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.functions.identity import discriminator, observation_key, uuid5
from lodewell.operators import folds

MUTABLE = ("title", "description", "metadata")


def merge_events(writes: DataFrame, key: str = "id", order: str = "seq", mutable: tuple[str, ...] = MUTABLE) -> DataFrame:
    """One row a key: the first write's columns, but the last write's for the mutable ones. One partial aggregation."""
    fixed = [c for c in writes.columns if c not in (*mutable, key, order)]
    changing = [c for c in mutable if c in writes.columns]
    merged = writes.groupBy(key).agg(F.min(F.struct(order, *fixed)).alias("first"), F.max(F.struct(order, *changing)).alias("last"))
    return merged.select(key, *[F.col(f"first.{c}") for c in fixed], *[F.col(f"last.{c}") for c in changing])


#: Columns of a stored observation; the last write of an id gives REFRESHED, its first write the rest.
OBSERVATION = (
    "id string, event_id string, mode string, kind string, provider string, transport string, replay_job_id string, observed_at timestamp, bitcoin_time timestamp, block_height bigint, block_hash string, "
    "confirmation_status string, source_sequence bigint, mempool_sequence bigint, witness string"
)
REFRESHED = ("provider", "transport", "witness", "confirmation_status", "source_sequence", "mempool_sequence")


def observe(events: DataFrame, kind: str | Column, mode: str = "live", transport: str = "rpc", **given: Column) -> DataFrame:
    """An observation of each event (id, event_time, block_height, block_hash): what ``given`` does not set is null or the event's own.

    Ids come from the natural key, so an observation that is made again is the same one.
    """
    kinds = dict(part.split() for part in OBSERVATION.split(", "))
    own = {"event_id": F.col("id"), "mode": F.lit(mode), "kind": F.lit(kind) if isinstance(kind, str) else kind, "provider": F.lit("node"), "transport": F.lit(transport)}
    own |= {"observed_at": F.col("event_time"), "bitcoin_time": F.col("event_time"), "block_height": F.col("block_height"), "block_hash": F.col("block_hash")} | given
    rows = events.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items() if c != "id"])
    told = discriminator(F.col("block_hash"), F.col("mempool_sequence"), F.col("source_sequence"), F.col("confirmation_status"))
    key = observation_key(F.col("event_id"), F.col("mode"), F.col("replay_job_id"), F.col("provider"), F.col("transport"), F.col("kind"), told)
    return rows.select(uuid5(key).alias("id"), *rows.columns)


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, "r.*")


def new_rows(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return df.join(existing.select(key), key, "left_anti")


def dedup_first(events: DataFrame, key: list[str], order: list[str], witness: str) -> DataFrame:
    """The first event of each key, how many there were, and the witnesses once each in name order."""
    return events.groupBy(*key).agg(
        F.min(F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("n_seen"), F.array_join(F.array_sort(F.collect_set(F.col(witness).cast("string"))), ",").alias("witnesses")
    ).select(*key, *[F.col(f"f.{c}").alias(f"first_{c}") for c in order], "n_seen", "witnesses")


def dedup_ttl(events: DataFrame, key: list[str], seconds: Column, order: str, ttl: int, per_task: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """Events let through when ttl has passed since the last one let through; dropped ones do not extend it.

    Events without a time are let through. A key of over ``per_task`` events is spread over all tasks (see ``folds``).
    """
    rows = events.select(*key, order, seconds.alias("__seconds"))
    told = folds.ordered_fold(rows, key, ["__seconds", order], "__seconds", [order], T.StructType().add("__fresh", T.BooleanType()), folds.spaced(ttl), per_task, parts)
    return told.filter("__fresh").drop("__fresh")


def retain(df: DataFrame, n: int, order: str) -> DataFrame:
    """The newest n rows."""
    return df.orderBy(F.desc(order)).limit(n)


def filter_events(events: DataFrame, *, heights=None, times=None, event_type=None, severity=None, txid=None, block_hash=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Events that meet every given predicate, newest first, ties by id. Limits are held to 1..1000."""
    if heights:
        events = events.filter(F.col("block_height").between(*heights))
    if times:
        events = events.filter(F.col("event_time").between(*times))
    for name, value in (("event_type", event_type), ("severity", severity), ("txid", txid), ("block_hash", block_hash)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    return events.orderBy(F.desc("event_time"), "id").offset(offset).limit(min(max(limit, 1), 1000))


def in_mode(events: DataFrame, observations: DataFrame, mode: str) -> DataFrame:
    """Events observed in a mode, or marked so themselves."""
    seen = observations.filter(F.col("mode") == mode).select(F.col("event_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    return events.join(seen, "id", "left").filter(F.coalesce("seen", F.lit(False)) | (F.col("observation_mode") == mode)).drop("seen")


def in_job(events: DataFrame, observations: DataFrame, job: str) -> DataFrame:
    """Events that a replay job observed, also those that were known before it, or that it made."""
    seen = observations.filter(F.col("replay_job_id") == job).select(F.col("event_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    return events.join(seen, "id", "left").filter(F.coalesce("seen", F.lit(False)) | F.coalesce(F.col("replay_job_id") == job, F.lit(False))).drop("seen")


def backfill(events: DataFrame, observations: DataFrame) -> DataFrame:
    """One observation for each event that has none, from the event's own columns."""
    bare = events.join(observations.select(F.col("event_id").alias("id")), "id", "left_anti")
    return bare.select(F.col("id").alias("event_id"), F.coalesce("observation_mode", F.lit("live")).alias("mode"), F.col("event_time").alias("observed_at"), "block_height")


def with_observations(events: DataFrame, observations: DataFrame, fields: list[str]) -> DataFrame:
    """Events with the array of their observations in the order of the fields."""
    lists = observations.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("observations"))
    return events.join(lists, "id", "left")


def witnesses_of(events: DataFrame) -> DataFrame:
    """Live observations: one for each witness, or one of the event itself where it has none."""
    has = F.size(F.coalesce("witnesses", F.array().cast("array<string>"))) > 0
    own = F.array(F.struct(F.when(F.col("block_hash").isNotNull(), "Confirmed").otherwise("MempoolSeen").alias("kind"), F.lit(None).cast("string").alias("witness")))
    each = F.transform("witnesses", lambda w: F.struct(F.lit("Witnessed").alias("kind"), w.alias("witness")))
    return events.select("id", F.inline(F.when(has, each).otherwise(own)))


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), most))
