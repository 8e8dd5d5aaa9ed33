"""The tip of a chain followed over a stream of blocks: extensions, reorganisations, gaps, and blocks that change nothing.

The state of a chain is a list of its recent headers and the hash of its tip. A block is judged by its header alone, so
what is shuffled is a row of a few hashes a block, and one key a chain is one block in minutes.

Rules. The first block is the tip. A branch becomes the chain's when it has more work above the common ancestor than the
blocks that it replaces (``work`` of a block, or 1 where there is none); with equal work what came first stays. So a
reorganisation is told once, by the block that decides it, and those after it extend the new branch. Blocks known
already, and blocks of branches that do not win, change nothing. A block whose parent has not come waits in the list; when
the parent comes they are judged together, so the order of arrival within ``keep`` heights does not matter for the tip.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodewell.streaming.stateful import keyed_state

#: Heights below the tip whose headers are kept, and so the depth of the deepest reorganisation with a known ancestor.
KEEP = 100
MOVES = (
    "network string, kind string, block_hash string, height bigint, old_tip_hash string, old_tip_height bigint, new_tip_hash string, new_tip_height bigint, common_ancestor_hash string, "
    "depth bigint, disconnected_blocks array<string>, connected_blocks array<string>, missing_from bigint, missing_to bigint, observed_at timestamp"
)
_EMPTY = {"old_tip_hash": None, "old_tip_height": None, "new_tip_hash": None, "new_tip_height": None, "common_ancestor_hash": None, "depth": None, "disconnected_blocks": None, "connected_blocks": None, "missing_from": None, "missing_to": None}


class Headers:
    """Recent headers {hash: (parent, height, work)} and the tip among them."""

    def __init__(self, known: dict[str, tuple[str | None, int, float]] | None = None, tip: str | None = None, keep: int = KEEP) -> None:
        self.known, self.tip, self.keep = known or {}, tip, keep

    def _branch(self, top: str, stop: set[str]) -> tuple[list[str], str | None]:
        """Known blocks from top down, and the block of ``stop`` that they stand on (None if the parents end before)."""
        out: list[str] = []
        at: str | None = top
        while at is not None and at in self.known and at not in stop:
            out.append(at)
            at = self.known[at][0]
        return out, at if at in stop else None

    def add(self, name: str, parent: str | None, height: int, work: float = 1.0) -> dict:
        """What a block does: FIRST, KNOWN, OLD, NEXT, REORG, GAP, SKIPPED or SIDE, with the fields of MOVES that apply."""
        if name in self.known:
            return {"kind": "KNOWN"}
        if self.tip is None:
            self.known[name], self.tip = (parent, height, work), name
            return {"kind": "FIRST", "new_tip_hash": name, "new_tip_height": height}
        top = self.known[self.tip][1]
        if height <= top - self.keep:
            return {"kind": "OLD"}
        self.known[name] = (parent, height, work)
        active = set(self._branch(self.tip, set())[0])
        best, found = None, None
        for leaf in self._leaves_above(name):
            branch, base = self._branch(leaf, active)
            if base is None and not self._overlaps(branch, active):
                continue
            gone = self._branch(self.tip, {base})[0] if base else [h for h in self._branch(self.tip, set())[0] if self.known[h][1] >= self.known[branch[-1]][1]]
            gain = sum(self.known[h][2] for h in branch) - sum(self.known[h][2] for h in gone)
            if gain > 0 and (best is None or gain > best):
                best, found = gain, (leaf, branch, base, gone)
        if found:
            leaf, branch, base, gone = found
            old, self.tip = self.tip, leaf
            move = {"kind": "REORG" if gone else "NEXT", "old_tip_hash": old, "old_tip_height": top, "new_tip_hash": leaf, "new_tip_height": self.known[leaf][1], "connected_blocks": branch}
            if gone:
                move |= {"common_ancestor_hash": base, "depth": len(gone), "disconnected_blocks": gone}
        elif height > top + self.keep:
            self.tip = name
            move = {"kind": "SKIPPED", "old_tip_height": top, "new_tip_hash": name, "new_tip_height": height, "missing_from": top + 1, "missing_to": height - 1}
        elif height > top + 1 and parent not in self.known:
            move = {"kind": "GAP", "missing_from": top + 1, "missing_to": height - 1}
        else:
            move = {"kind": "SIDE"}
        least = self.known[self.tip][1] - self.keep
        self.known = {h: x for h, x in self.known.items() if x[1] > least}
        return move

    def _leaves_above(self, name: str) -> list[str]:
        """The ends of all known branches that stand on a block, itself if none does."""
        children: dict[str | None, list[str]] = {}
        for h, (parent, _, _) in self.known.items():
            children.setdefault(parent, []).append(h)
        leaves, todo = [], [name]
        while todo:
            at = todo.pop()
            todo += children.get(at, [])
            if at not in children:
                leaves.append(at)
        return sorted(leaves)

    def _overlaps(self, branch: list[str], active: set[str]) -> bool:
        """Whether a branch whose root is unknown reaches below all that is known of the chain."""
        return self.known[branch[-1]][1] <= min(self.known[h][1] for h in active)


class _Follow(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.headers = handle.getListState("headers", "hash string, parent string, height bigint, work double")
        self.tip = handle.getValueState("tip", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = {h: (parent, height, work) for h, parent, height, work in self.headers.get()}
        chain = Headers(stored, self.tip.get()[0] if self.tip.exists() else None, self.keep)
        blocks = pd.concat(list(rows)).sort_values(["height", "block_hash"])
        out = []
        for b in blocks.itertuples():
            move = chain.add(b.block_hash, b.previous_block_hash, int(b.height), float(b.work))
            out.append({"network": key[0], "block_hash": b.block_hash, "height": b.height, **_EMPTY, "observed_at": b.observed_at, **move})
        self.headers.put([(h, *x) for h, x in chain.known.items()])
        self.tip.update((chain.tip,))
        columns = [c.split()[0] for c in MOVES.split(", ")]
        for at in range(0, len(out), 1000):  # lists of blocks are long only in moves that change the chain
            yield pd.DataFrame(out[at : at + 1000], columns=columns).astype({c: "Int64" for c in columns if c in ("height", "depth") or c.endswith(("_height", "_from", "_to"))})

    def close(self) -> None:
        pass


class _Arrivals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, height bigint, seconds bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocks = pd.concat(list(rows)).sort_values(["arrival", "height", "block_hash"])
        last = self.last.get() if self.last.exists() else None
        found = []
        for b in blocks.itertuples():
            fresh = last is not None and (b.height > last[1] or b.block_hash != last[0]) and b.seconds > last[2]
            found.append(b.seconds - last[2] if fresh else None)
            last = (b.block_hash, int(b.height), int(b.seconds))
        self.last.update(last)
        yield blocks.assign(network=key[0], interval_seconds=pd.array(found, dtype="Int64"))[["network", "arrival", "block_hash", "height", "seconds", "interval_seconds"]]

    def close(self) -> None:
        pass


def arrival_intervals(blocks: DataFrame, network: str = "mainnet") -> DataFrame:
    """interval_seconds of each block of a stream since the one that arrived before, as ``chain.arrival_intervals`` has them.

    Blocks are taken by ``arrival`` where the stream has it (any number that grows), else within a micro-batch by height.
    """
    keyed_state(blocks.sparkSession)
    given = blocks.withColumns({c: v for c, v in (("network", F.lit(network)), ("arrival", F.lit(0).cast("bigint"))) if c not in blocks.columns})
    rows = given.select("network", F.col("arrival").cast("bigint").alias("arrival"), "block_hash", "height", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("seconds"))
    schema = "network string, arrival bigint, block_hash string, height bigint, seconds bigint, interval_seconds bigint"
    return rows.groupBy("network").transformWithStateInPandas(_Arrivals(), schema, "Append", "None")


def moves(blocks: DataFrame, keep: int = KEEP, network: str = "mainnet") -> DataFrame:
    """A row for each block of a stream (block_hash, previous_block_hash, height, timestamp or observed_at, maybe work and network).

    Blocks of one micro-batch are taken by (height, hash).
    """
    keyed_state(blocks.sparkSession)
    given = blocks.withColumns({c: v for c, v in (("network", F.lit(network)), ("work", F.lit(1.0)), ("observed_at", F.col("timestamp") if "timestamp" in blocks.columns else F.current_timestamp())) if c not in blocks.columns})
    rows = given.select("network", "block_hash", "previous_block_hash", "height", F.coalesce(F.col("work").cast("double"), F.lit(1.0)).alias("work"), "observed_at").filter("block_hash IS NOT NULL AND height IS NOT NULL")
    return rows.groupBy("network").transformWithStateInPandas(_Follow(keep), MOVES, "Append", "None")


def reorgs(moved: DataFrame) -> DataFrame:
    """The reorganisations among moves, as the detector takes them; lists run from the tip down."""
    return moved.filter("kind = 'REORG'").select(
        "network", "old_tip_hash", "old_tip_height", "new_tip_hash", "new_tip_height", "common_ancestor_hash", "depth", "disconnected_blocks", "connected_blocks", "observed_at"
    )


def gaps(moved: DataFrame) -> DataFrame:
    """Heights that were missing when a block came: to be read again (GAP), or given up as too many (SKIPPED)."""
    action = F.when(F.col("kind") == "GAP", "RECONCILE").otherwise("SKIP")
    return moved.filter("kind IN ('GAP', 'SKIPPED')").select("network", "block_hash", "missing_from", "missing_to", action.alias("action"), "observed_at")
