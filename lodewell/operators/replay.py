"""Replay jobs over height ranges: validation, slices, resume from checkpoints, created and existing events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SPAN = 100_000
ACTIVE = ("PENDING", "RUNNING", "PAUSED")


@dataclass(frozen=True)
class ReplayRange:
    start: int
    end: int

    def check(self, tip: int | None = None, pruned_below: int = 0, max_span: int = MAX_SPAN, syncing: bool = False, chain: str = "main") -> None:
        """A node that still loads its chain is refused, but on regtest."""
        if syncing and chain != "regtest":
            raise ValueError("the node is still loading its chain")
        if self.start > self.end:
            raise ValueError("the start lies above the end")
        if self.end - self.start + 1 > max_span:
            raise ValueError(f"more than {max_span} blocks")
        if self.start < pruned_below:
            raise ValueError("blocks of the range are pruned")
        if tip is not None and self.end > tip:
            raise ValueError("the end lies above the tip")


def remaining(blocks: DataFrame, span: ReplayRange, checkpoints: DataFrame) -> DataFrame:
    """Blocks of a range above the last checkpoint."""
    done = checkpoints.agg(F.max("completed_height")).first()[0]
    return blocks.filter(F.col("height").between(span.start if done is None else max(span.start, done + 1), span.end))



def stamp(events: DataFrame, job: str) -> DataFrame:
    """Events of a replay: its mode and job, also in the metadata, with the height, hash and time of the block replayed."""
    own = F.struct(
        F.lit("historical_replay").alias("observation_mode"), F.lit(job).alias("replay_job_id"), F.col("block_height").alias("historical_height"),
        F.col("block_hash").alias("historical_block_hash"), F.col("event_time").alias("historical_timestamp"),
    )
    marked = {"observation_mode": F.lit("historical_replay"), "replay_job_id": F.lit(job)}
    if "metadata" in events.columns:
        body = F.regexp_extract("metadata", r"^\{(.*)\}$", 1)
        more = F.regexp_extract(F.to_json(own), r"^\{(.*)\}$", 1)
        marked["metadata"] = F.when(F.col("metadata").rlike(r"^\{.*\}$"), F.concat(F.lit("{"), F.concat_ws(",", F.nullif(body, F.lit("")), more), F.lit("}"))).otherwise(F.col("metadata"))
    return events.withColumns(marked)


def split_new(found: DataFrame, stored: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(created, existing) events of a run."""
    keys = stored.select(key)
    return found.join(keys, key, "left_anti"), found.join(keys, key, "left_semi")
