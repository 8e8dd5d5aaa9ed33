"""The watch engine over a stream of transactions: direct matches, and descendants of watched outputs by keyed state.

The state is keyed by output (``txid:vout``), so watched outputs spread over all tasks, and a spend meets what is known of
the output that it spends wherever that lies. A spend of a followed output has to follow the outputs of its own
transaction, which are other keys; so there is one stateful operator a depth, each of which passes on to the next what is
to be followed one deeper:

    watched outputs (initial state) -> depth 1 -> depth 2 -> ... -> depth 5 at most

Spends run through all of them within one micro-batch, so a chain of spends within a batch is followed like one over many.
Each operator keeps what it follows until it is spent, and nothing else: the state is the outputs followed and unspent.

Order. ``arrival`` numbers the transactions. A followed output is spent by a transaction that arrives after the one that
made it, so results do not depend on how the stream is cut into batches, as long as batches come in the order of arrival.
A transaction that is reached at more than one depth is followed from the smallest. A watched output's spend that comes
again by the same transaction is told once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodewell.operators import watch
from lodewell.streaming.stateful import keyed_state

#: What runs between the operators: spends (with the outputs of their transaction as vout:value, comma-joined), outputs to follow, and what was found.
FLOW = "kind string, point string, arrival bigint, txid string, position int, outputs string, value_sats bigint, target_id string, depth int"
_FIELDS = ["kind", "point", "arrival", "txid", "position", "outputs", "value_sats", "target_id", "depth"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FIELDS).astype({"arrival": "Int64", "position": "Int32", "value_sats": "Int64", "depth": "Int32"})


def _whole(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


class _Level(StatefulProcessor):
    """Outputs that are followed at one depth; depth 0 is the watched outputs themselves."""

    def __init__(self, depth: int, deepest: int) -> None:
        self.depth, self.deepest = depth, deepest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.followed = handle.getMapState("followed", "target_id string", "arrival bigint, value_sats bigint")
        self.spender = handle.getValueState("spender", "txid string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.itertuples():
            self.followed.updateValue((row.target_id,), (-1, None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spends, entered, out = [], {}, []
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.kind == "spend":
                    spends.append(r)
                else:
                    out.append(tuple(r))  # for what comes after
                    if r.kind == "follow":
                        entered.setdefault(r.target_id, []).append((int(r.depth), int(r.arrival), _whole(r.value_sats)))
        for target, found in entered.items():
            depth, arrival, value = min(found)
            if depth == self.depth:  # one that is followed from less deep is that depth's
                self.followed.updateValue((target,), (arrival, value))
        for s in sorted(spends, key=lambda s: (s.arrival, s.txid, s.position)):
            out.append(tuple(s))
            out += self._spent(s)
        if out:
            yield _frame(out)

    def _spent(self, s) -> list[tuple]:
        held = sorted((target, arrival, value) for (target,), (arrival, value) in self.followed.iterator())
        if self.depth == 0 and held:
            if self.spender.exists() and self.spender.get()[0] == s.txid:
                return []
            self.spender.update((s.txid,))
        out = []
        for target, arrival, value in held:
            if arrival >= s.arrival:
                continue
            value = value if _whole(s.value_sats) is None else _whole(s.value_sats)
            out.append(("found", s.point, s.arrival, s.txid, s.position, None, value, target, self.depth))
            if self.depth < self.deepest:
                made = [o.split(":") for o in s.outputs.split(",") if o]
                out += [("follow", f"{s.txid}:{vout}", s.arrival, s.txid, None, None, int(sats) if sats else None, target, self.depth + 1) for vout, sats in made]
            if self.depth:
                self.followed.removeKey((target,))
        return out

    def close(self) -> None:
        pass


def _spends(tx: DataFrame) -> DataFrame:
    carried = F.filter("outputs", lambda o: ~F.coalesce(o["op_return"], F.lit(False)))
    kept = F.array_join(F.transform(carried, lambda o: F.concat(o["vout"].cast("string"), F.lit(":"), F.coalesce(o["value_sats"].cast("string"), F.lit("")))), ",")
    rows = tx.select("arrival", "txid", kept.alias("outputs"), F.posexplode("inputs").alias("position", "i"))
    point = F.concat_ws(":", F.lower("i.prev_txid"), F.col("i.prev_vout").cast("string"))
    return rows.filter("i.prev_txid IS NOT NULL").select(
        F.lit("spend").alias("kind"), point.alias("point"), "arrival", F.lower("txid").alias("txid"), "position", "outputs", F.col("i.value_sats").cast("bigint").alias("value_sats"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("int").alias("depth")
    )


def followed(tx: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """Spends of watched outputs (depth 0) and of what descends from them, by depth, of a stream of transactions.

    tx: arrival, txid, inputs (prev_txid, prev_vout, value_sats), outputs (vout, value_sats, op_return). max_depth is held to 1..5.
    """
    keyed_state(tx.sparkSession)
    points = watch.active(targets, "OUTPOINT").select(F.concat_ws(":", F.lower("txid"), F.col("vout").cast("string")).alias("point"), F.col("id").alias("target_id"))
    flow, deepest = _spends(tx), min(max(max_depth, 1), 5)
    for depth in range(deepest + 1):
        first = {"initialState": points.groupBy("point")} if depth == 0 else {}
        flow = flow.groupBy("point").transformWithStateInPandas(_Level(depth, deepest), FLOW, "Append", "None", **first)
    return flow.filter("kind = 'found'").select("arrival", "txid", "target_id", "depth", "position", "point", "value_sats")


def activities(tx: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """All activities of a stream of transactions, as ``watch.engine`` gives them for a table (but replacements, which have a stream of their own).

    tx as for ``followed``, with total_output_sats, height (null in the mempool), and address and script_hex in inputs and outputs.
    """
    found = followed(tx, targets, max_depth).withColumns({
        "activity_type": F.when(F.col("depth") == 0, "WATCHED_OUTPOINT_SPENT").otherwise("NEW_DESCENDANT_OBSERVED"),
        "correlation": F.when(F.col("depth") == 0, "DIRECT").otherwise("STRUCTURAL"),
    })
    inputs = tx.select("arrival", "txid", F.posexplode("inputs").alias("position", "i")).select("arrival", "txid", "position", "i.*")
    outputs = tx.select("arrival", "txid", F.posexplode("outputs").alias("position", "o")).select("arrival", "txid", "position", "o.*")
    return watch._staged(found, F.col("depth")).unionByName(watch.direct(tx, inputs, outputs, targets, outpoints=False))
