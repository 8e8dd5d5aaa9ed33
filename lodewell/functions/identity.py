"""Deterministic ids: version 5 UUIDs over natural keys, built from sha1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the object-identifier namespace of RFC 4122.
NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(key: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_key(event_type: Column, txid: Column, block_hash: Column, height: Column, title: Column) -> Column:
    """The natural key of an event: its type and the first of transaction, block, height and title."""
    part = lambda name, c: F.concat(F.lit(f":{name}:"), c.cast("string"))
    return F.concat(event_type, F.coalesce(part("tx", txid), part("block", block_hash), part("height", height), part("title", title)))


def observation_key(event_id: Column, mode: Column, job: Column, provider: Column, transport: Column, kind: Column, discriminator: Column) -> Column:
    live = F.concat_ws(":", F.lit("obs"), event_id, mode, provider, transport, kind, discriminator)
    return F.when((mode == "historical_replay") & job.isNotNull(), F.concat_ws(":", F.lit("obs"), event_id, F.lit("replay"), job)).otherwise(live)


def discriminator(block_hash: Column, mempool_sequence: Column, source_sequence: Column, status: Column) -> Column:
    return F.coalesce(block_hash, F.concat(F.lit("mempool_seq:"), mempool_sequence.cast("string")), F.concat(F.lit("source_seq:"), source_sequence.cast("string")), status, F.lit(""))
