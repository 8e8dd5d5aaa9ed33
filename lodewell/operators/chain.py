"""Blocks in order: intervals, sequence gaps, missing heights, common ancestors; inputs joined with what they spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.functions.lineage import cut
from lodewell.operators import folds

#: Steps of an ancestor walk between two checkpoints.
STEPS = 4


def block_intervals(blocks: DataFrame, live: bool = True, per: str | None = None) -> DataFrame:
    """interval_seconds since the block before. Live intervals must be positive; replayed ones are 0 at least.

    Without ``per`` the heights are cut into runs of 100 000 blocks, each of which also sees the last block before it
    (the highest of the last run that has any), so no window spans the chain.
    """
    run = F.floor(F.col("height") / 100_000).cast("bigint")
    base = blocks.withColumn("run", run).withColumn("own", F.lit(True))
    keys = [per] if per else []
    last = base.filter("height IS NOT NULL").groupBy(*keys, "run").agg(F.max_by(F.struct(*base.columns), "height").alias("last"))
    # a row for each run that has blocks, which goes to the next run that has any
    edge = last.withColumn("next", F.lead("run").over(Window.partitionBy(*keys).orderBy("run"))).filter("next IS NOT NULL")
    edge = edge.select("last.*", "next").withColumn("run", F.col("next")).withColumn("own", F.lit(False)).drop("next")
    w = Window.partitionBy(*keys, "run").orderBy("height")
    diff = F.expr("timestampdiff(SECOND, before, timestamp)")
    out = base.unionByName(edge).withColumn("before", F.lag("timestamp").over(w)).filter("own")
    return out.withColumn("interval_seconds", F.when(diff > 0, diff) if live else F.greatest(F.lit(0), diff)).drop("run", "own", "before")


def arrival_intervals(blocks: DataFrame, order: str = "arrival", per: str | None = None, run: int = 100_000) -> DataFrame:
    """interval_seconds since the block that arrived before, whatever its height, as a live follower sees it.

    ``order`` numbers the arrivals (any integers, unique within ``per``). A block that comes again right after itself, and
    one that is not later than the one before it, has none. Runs of ``run`` numbers are windowed apart and each also sees
    the last arrival before it, so no window spans the stream.
    """
    keys = [per] if per else []
    base = blocks.withColumns({"run": F.floor(F.col(order) / run).cast("bigint"), "own": F.lit(True)})
    last = base.groupBy(*keys, "run").agg(F.max_by(F.struct(*base.columns), order).alias("last"))
    edge = last.withColumn("next", F.lead("run").over(Window.partitionBy(*keys).orderBy("run"))).filter("next IS NOT NULL")
    edge = edge.select("last.*", "next").withColumn("run", F.col("next")).withColumn("own", F.lit(False)).drop("next")
    before = F.lag(F.struct("timestamp", "block_hash", "height")).over(Window.partitionBy(*keys, "run").orderBy(order))
    out = base.unionByName(edge).withColumn("before", before).filter("own")
    diff = F.expr("timestampdiff(SECOND, before.timestamp, timestamp)")
    fresh = (F.col("height") > F.col("before.height")) | (F.col("block_hash") != F.col("before.block_hash"))
    return out.withColumn("interval_seconds", F.when(fresh & (diff > 0), diff)).drop("run", "own", "before")


def missing_heights(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Heights of a range that no block has."""
    return blocks.sparkSession.range(start, end + 1).select(F.col("id").alias("height")).join(blocks.select("height"), "height", "left_anti")


def sequence_states(messages: DataFrame, key: str, order: str, seq: str, per_task: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """Initial, consecutive, duplicate, gap or stale, against the last accepted number, with 32-bit wrap-around.

    Stale and duplicate numbers do not advance the state; a message without a number has no state. A key of over
    ``per_task`` messages is spread over all tasks (see ``folds``).
    """
    told = T.StructType().add("state", T.StringType()).add("missed", T.LongType())
    return folds.ordered_fold(messages.select(key, order, seq), [key], [order], seq, [order], told, folds.numbered(), per_task, parts)


def gap_requests(states: DataFrame, order: str, most: int = 100) -> DataFrame:
    """What sequence gaps ask for: heights or messages to be read again, or nothing where more than ``most`` are missing."""
    return states.filter("state = 'Gap'").withColumn("action", F.when(F.col("missed") <= most, "RECONCILE").otherwise("SKIP"))


def tip_continuity(known: int, tip: int, most: int = 100) -> tuple[str, range]:
    """(state, heights to read) of a new tip after the last one known: CURRENT, NEXT, GAP, SKIPPED (over ``most``) or BEHIND."""
    if tip == known:
        return "CURRENT", range(0)
    if tip < known:
        return "BEHIND", range(0)
    return ("NEXT" if tip == known + 1 else "GAP", range(known + 1, tip + 1)) if tip - known <= most else ("SKIPPED", range(tip, tip + 1))


def competing_tips(tips: DataFrame) -> DataFrame:
    """Of a node's chain tips (hash, height, branchlen, status) the forks that were or may be valid, the longest first."""
    return tips.filter((F.col("status") != "active") & F.col("status").isin("valid-fork", "valid-headers", "headers-only") & (F.col("branchlen") > 0)).orderBy(F.desc("branchlen"), F.desc("height"), "hash")


def enrich_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with the value, confirmation and (where outputs have it) address of the output that they spend; null where it is not known."""
    spent = outputs.select(F.col("txid").alias("prev_txid"), F.col("n").alias("prev_vout"), "value_sats", "confirmed_at", "confirmed_height", *[c for c in ("address",) if c in outputs.columns])
    return inputs.join(spent, ["prev_txid", "prev_vout"], "left")


def fees(enriched: DataFrame, by: str, total_output: str, vsize: str) -> DataFrame:
    """Fee and fee rate of transactions whose every input is known; 0 and null otherwise."""
    t = enriched.groupBy(by).agg(F.sum("value_sats").alias("total_input_sats"), F.every(F.col("value_sats").isNotNull()).alias("resolved"), F.max(total_output).alias("o"), F.max(vsize).alias("v"))
    fee = F.when(F.col("resolved"), F.greatest(F.lit(0), F.col("total_input_sats") - F.col("o"))).otherwise(0).cast("bigint")
    return t.select(by, "total_input_sats", "resolved", fee.alias("fee_sats"), F.when(F.col("resolved") & (F.col("v") > 0), fee.cast("double") / F.col("v")).alias("fee_rate_sat_vb"))


def common_ancestor(headers: DataFrame, tips: DataFrame, max_depth: int = 100) -> DataFrame:
    """For each (reorg, old_tip, new_tip) the highest common ancestor and how many blocks either side is above it.

    The higher end steps to its parent, both if they are level, until they meet; pairs that do not meet within
    max_depth steps are left out. A step is two equi-joins of the reorgs with the headers, so the chain's length does
    not matter. Every STEPS steps the pairs are checkpointed, which cuts the lineage, and the met ones counted out.
    """
    ends = {x: headers.select(F.col("hash").alias(x), F.col("prev").alias(f"{x}_up")) for x in ("a", "b")}
    at = lambda tip, x: headers.select(F.col("hash").alias(tip), F.col("height").alias(f"{x}_height"))
    walk = tips.join(at("old_tip", "a"), "old_tip").join(at("new_tip", "b"), "new_tip")
    walk = walk.select("reorg", F.col("old_tip").alias("a"), F.col("new_tip").alias("b"), "a_height", "b_height", F.lit(0).alias("disconnected"), F.lit(0).alias("connected"))
    met = walk.filter("a = b")
    walk = walk.filter("a <> b")
    apart = F.col("a") != F.col("b")
    down = {"a": apart & (F.col("a_height") >= F.col("b_height")), "b": apart & (F.col("b_height") >= F.col("a_height"))}
    for step in range(1, max_depth + 1):
        walk = walk.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(
            "reorg", *[F.when(down[x], F.col(f"{x}_up")).otherwise(F.col(x)).alias(x) for x in "ab"], *[(F.col(f"{x}_height") - down[x].cast("int")).alias(f"{x}_height") for x in "ab"],
            (F.col("disconnected") + down["a"].cast("int")).alias("disconnected"), (F.col("connected") + down["b"].cast("int")).alias("connected"),
        ).filter("a IS NOT NULL AND b IS NOT NULL")
        if step % STEPS == 0 or step == max_depth:
            whole = cut(walk)
            met, walk = met.unionByName(whole.filter("a = b")), whole.filter("a <> b")
            if walk.isEmpty():
                break
    return met.select("reorg", F.col("a").alias("ancestor"), F.col("a_height").cast("bigint").alias("ancestor_height"), "disconnected", "connected")
