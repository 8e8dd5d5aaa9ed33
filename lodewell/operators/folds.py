"""Folds over a key's rows in order, a number carried from row to row, where one key may hold most of the rows.

Where no key has more than ``per_task`` rows, a task reads whole keys. Else rows are range-partitioned by (key, order), so a
key may fill all tasks, and are read twice. First each part tells, for whatever number the key enters it with, which number
it leaves with: a list of intervals of entries, each with its exit. The driver follows these from part to part, one row a
part. Then each part is read again from the number that it is entered with. A list of over ``PIECES`` intervals is not
kept: such a part is read once more, with its entry, when its turn comes.
"""

from __future__ import annotations

import bisect
import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.functions.lineage import cut

#: Intervals of entries that a part tells the driver at most.
PIECES = 256


class Summary(Protocol):
    """Takes a part's numbers in order; ``told`` is what ``exit`` needs, or None if that is too much."""

    def add(self, value: int) -> None: ...

    def told(self) -> list | None: ...


@dataclass(frozen=True)
class Fold:
    """answer: (number carried, row's number) to (answers, number carried on). exit: (what a part told, entry) to its exit."""

    answer: Callable[[int | None, int | None], tuple[tuple, int | None]]
    summary: Callable[[], Summary]
    exit: Callable[[list, int | None], int | None]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], value: str, kept: list[str], answers: T.StructType, fold: Fold, per_task: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """keys, kept columns and answers of every row. Rows of a key are taken by ``order``; ``value`` is a row's number.

    A row whose number is null gets answers of its own and changes nothing. Rows that agree in key and order are taken in
    any order. ``parts``: how many ranges to cut into (default: the shuffle's partitions).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    slim = rows.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__kept{i}") for i, c in enumerate(kept)], F.col(value).cast("bigint").alias("__value"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(order)])
    names, n, m = [f"__key{i}" for i in range(len(keys))], len(keys), len(kept)
    by = [*names, *[f"__by{i}" for i in range(len(order))]]
    answered = T.StructType([*[T.StructField(c, slim.schema[f"__key{i}"].dataType) for i, c in enumerate(keys)], *[T.StructField(c, slim.schema[f"__kept{i}"].dataType) for i, c in enumerate(kept)], *answers.fields])
    out_schema = to_arrow_schema(answered)

    def read(entries: dict[int, int | None]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, state = (None, None), None
            for batch in batches:
                found = []
                for part, v, *key in zip(batch.column("__part").to_pylist(), batch.column("__value").to_pylist(), *(batch.column(c).to_pylist() for c in names)):
                    if (part, key) != at:
                        state = entries.get(part) if part != at[0] else None
                        at = (part, key)
                    got, state = fold.answer(state, v)
                    found.append(got)
                columns = list(zip(*found)) if found else [()] * len(answers.fields)
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + m], *(pa.array(c, f.type) for c, f in zip(columns, list(out_schema)[n + m :]))], schema=out_schema)

        return run

    if most <= per_task:
        return slim.withColumn("__part", F.lit(0)).repartition(*names).sortWithinPartitions(*by).mapInArrow(read({}), answered)

    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(slim.repartitionByRange(count, *by).withColumn("__part", F.spark_partition_id()))
    dealt = lambda df: df.repartitionByRange(count, "__part").sortWithinPartitions("__part", *by)
    key_type = T.StructType([slim.schema[c] for c in names])
    told_type = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", key_type), T.StructField("last", key_type), T.StructField("exit", T.LongType()), T.StructField("told", T.StringType())])
    told_schema = to_arrow_schema(told_type)

    def ends(entries: dict[int, int | None]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, first, state, seen = (None, None), None, None, None

            def line() -> pa.RecordBatch:
                told = seen.told()
                row = {"part": at[0], "first": dict(zip(names, first)), "last": dict(zip(names, at[1])), "exit": state, "told": None if told is None else json.dumps(told)}
                return pa.RecordBatch.from_pylist([row], schema=told_schema)

            for batch in batches:
                for part, v, *key in zip(batch.column("__part").to_pylist(), batch.column("__value").to_pylist(), *(batch.column(c).to_pylist() for c in names)):
                    if part != at[0]:
                        if at[0] is not None:
                            yield line()
                        at, first, state, seen = (part, key), key, entries.get(part), fold.summary()
                    elif key != at[1]:
                        at, state = (part, key), None
                    if v is not None and key == first:
                        seen.add(v)
                    _, state = fold.answer(state, v)
            if at[0] is not None:
                yield line()

        return run

    entries, before, left = {}, None, None
    for row in sorted(dealt(placed).mapInArrow(ends({}), told_type).collect(), key=lambda r: r["part"]):  # one row a part
        out = row["exit"]
        if before is not None and tuple(row["first"]) == before and left is not None:
            entries[row["part"]] = left
            if row["first"] == row["last"]:
                if row["told"] is not None:
                    out = fold.exit(json.loads(row["told"]), left)
                else:
                    out = placed.filter(F.col("__part") == row["part"]).repartition(1).sortWithinPartitions("__part", *by).mapInArrow(ends({row["part"]: left}), told_type).first()["exit"]
        before, left = tuple(row["last"]), out
    return dealt(placed).mapInArrow(read(entries), answered)


# time to live


class _Spaced:
    """Rows let through once ``ttl`` has passed since the last one let through, from whatever last one.

    An entry matters by the first row that it lets through: one of those up to ``ttl`` after the part's first. Chains of
    rows let through that start there and have met are held as one.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl, self.start, self.open = ttl, None, True
        self.chains: OrderedDict[int, list[int]] = OrderedDict()  # last row let through, oldest first, to starts

    def add(self, value: int) -> None:
        starts = []
        while self.chains and next(iter(self.chains)) <= value - self.ttl:
            starts += self.chains.popitem(last=False)[1]
        if self.open:
            self.start = value if self.start is None else self.start
            if value not in self.chains:
                starts.append(value)
            self.open = value < self.start + self.ttl
        if starts:
            self.chains.setdefault(value, []).extend(starts)

    def told(self) -> list | None:
        pairs = sorted((s, last) for last, starts in self.chains.items() for s in starts)
        short = [p for i, p in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][1] != p[1]]  # the last start of each run
        return None if len(short) > PIECES else short


def spaced(ttl: int) -> Fold:
    """Answers whether a row is let through: it is the first, or ``ttl`` after the last one that was. ``order`` begins with the number."""

    def answer(last, value):
        if value is None:
            return (True,), last
        fresh = last is None or value - last >= ttl
        return (fresh,), value if fresh else last

    def leaves(told, last):
        i = bisect.bisect_left([s for s, _ in told], last + ttl)
        return told[i][1] if i < len(told) else last

    return Fold(answer, lambda: _Spaced(ttl), leaves)


# sequence numbers

#: Fixed value: numbers of messages have 32 bits.
WRAP, HALF = 1 << 32, 1 << 31


class _Numbered:
    """The last number accepted, from whatever number before.

    After a first number s every entry leaves with s, but the half circle (s, s + 2^31], to which s is stale and which
    leaves with itself. Later numbers take from either end of what is left of it.
    """

    def __init__(self) -> None:
        self.main, self.low, self.left = None, 0, 0  # entries low + 1 .. low + left leave with themselves
        self.pieces: list[list[int]] | None = []  # first entry, how many, exit

    def add(self, value: int) -> None:
        if self.main is None:
            self.main, self.low, self.left = value, value, HALF
            return
        newer = lambda held: 0 < (value - held) % WRAP < HALF
        self.main = value if newer(self.main) else self.main
        if self.pieces is None:
            return
        for piece in self.pieces:
            piece[2] = value if newer(piece[2]) else piece[2]
        o = (value - self.low) % WRAP
        if 0 < o <= HALF:
            taken = min(self.left, o)
            self._piece((self.low + 1) % WRAP, taken, value)
            self.low, self.left = (self.low + taken) % WRAP, self.left - taken
        elif o - HALF < self.left and o > HALF:
            taken = self.left - (o - HALF)
            self._piece((self.low + o - HALF + 1) % WRAP, taken, value)
            self.left -= taken

    def _piece(self, first: int, n: int, value: int) -> None:
        if n == 0:
            return
        self.pieces = [p for p in self.pieces if p[2] != self.main]
        if value != self.main:
            self.pieces.append([first, n, value])
        if len(self.pieces) > PIECES:
            self.pieces = None

    def told(self) -> list | None:
        return None if self.pieces is None else [self.main, self.low, self.left, self.pieces]


def numbered() -> Fold:
    """Answers state (Initial, Duplicate, Consecutive, Gap or Stale, against the last number accepted) and missed."""

    def answer(last, value):
        if value is None:
            return (None, None), last
        if last is None:
            return ("Initial", None), value
        diff = (value - last) % WRAP
        if diff == 0:
            return ("Duplicate", None), last
        if diff == 1:
            return ("Consecutive", None), value
        return (("Gap", diff - 1), value) if diff < HALF else (("Stale", None), last)

    def leaves(told, last):
        main, low, left, pieces = told
        if main is None or 0 < (last - low) % WRAP <= left:
            return last
        return next((v for first, n, v in pieces if (last - first) % WRAP < n), main)

    return Fold(answer, _Numbered, leaves)
