"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over the training run, linear between knots. Its integral gives the source's share;
targets stop at max_epochs times the source's size, and what is over is shared anew by weight until no target is
above. Within a source, documents stand in a fixed pseudo-random order (md5 of the id); the running sum of their sizes
is the source's token demand served so far. Inverting the cumulated demand of the schedule gives each document's
training position in [0, 1), and a range partitioning by position gives the training order.

Running sums never pass one task by rows: documents are summed in buckets of the md5 order (about the square root of a
source's documents each), buckets are summed along a source, and a window runs within one bucket.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is
ordered as the text "null"; rows that repeat are separate documents; an empty table gives no rows. Targets need one
row a source on the driver: a mix names its sources, so this is a table of weights, not of documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lodewell.llm.common import WORD, materialize

#: (time, weight) knots over [0, 1].
Schedule = Sequence[tuple[float, int]]


def ramp(rank: int, weight: int) -> Schedule:
    """Mean weight over the run as given; every second source fades out while the others fade in."""
    return ((0.0, 3 * weight), (1.0, weight)) if rank % 2 == 0 else ((0.0, weight), (1.0, 3 * weight))


def default_schedules(sources: list[str | None]) -> dict[str | None, Schedule]:
    """Weights 3, 1, 2, repeating, over the sources in order."""
    return {s: ramp(i, (3, 1, 2)[i % 3]) for i, s in enumerate(sources)}


def integral(schedule: Schedule) -> Fraction:
    return sum((Fraction(t1) - Fraction(t0)) * (Fraction(w0) + Fraction(w1)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def targets(sizes: dict, weights: dict, total_share: Fraction = Fraction(3, 2), max_epochs: int = 2) -> dict:
    """Each source's target: exact shares by weight, at most max_epochs times its size."""
    whole, full = total_share * sum(sizes.values()), set()
    while True:
        rest = whole - sum(max_epochs * sizes[s] for s in full)
        weight = sum(weights[s] for s in weights if s not in full)
        over = [s for s in sizes if s not in full and weights[s] * rest > max_epochs * sizes[s] * weight]
        if not over:
            return {s: Fraction(max_epochs * sizes[s]) if s in full or not weight else weights[s] * rest / weight for s in sizes}
        full.update(over)


def _invert(x: Column, knots: Column) -> Column:
    """The time at which the normalised cumulated weight reaches x."""
    seg = F.element_at(F.filter(knots, lambda k: k["c"] <= x), -1)
    left, slope = x - seg["c"], (seg["w1"] - seg["w0"]) / seg["dt"]
    return seg["t"] + 2 * left / (seg["w0"] + F.sqrt(seg["w0"] * seg["w0"] + 2 * slope * left))


_PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("epochs", T.LongType()),
        T.StructField("rest", T.LongType()),
        T.StructField("knots", T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("t", "dt", "w0", "w1", "c")]))),
    ]
)


def _plan_rows(sizes: dict, schedules: dict, share: Fraction, max_epochs: int) -> list[tuple]:
    weights = {s: integral(schedules[s]) for s in sizes}
    rows = []
    for s, target in targets(sizes, weights, share, max_epochs).items():
        knots, done = [], Fraction(0)
        for (t0, w0), (t1, w1) in zip(schedules[s], schedules[s][1:]):
            knots.append((t0, t1 - t0, float(w0 / weights[s]), float(w1 / weights[s]), float(done / weights[s])))
            done += (Fraction(t1) - Fraction(t0)) * (Fraction(w0) + Fraction(w1)) / 2
        words = math.floor(target + Fraction(1, 2))
        epochs = words // sizes[s] if sizes[s] else 0
        rows.append((s, sizes[s], target.numerator / target.denominator, epochs, words - epochs * sizes[s], knots))
    return rows


def mix_plan(docs: DataFrame, schedules=default_schedules, share: Fraction = Fraction(3, 2), max_epochs: int = 2) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, position of the first word taken (or null).

    ``schedules`` gives each source's schedule from the ordered list of sources. Whole passes over a source take every
    document; the words of a part pass come from the first documents in order, the last of them in part.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("draw"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted((r["source"] for r in totals), key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    plan = spark.createDataFrame(_plan_rows({r["source"]: r["size"] for r in totals}, schedules(ordered), share, max_epochs), _PLAN)
    digits = max(1, math.ceil(math.log(max((r["n"] for r in totals), default=1), 16) / 2))
    bucketed = sized.withColumn("bucket", F.substring("draw", 1, digits))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("s_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("words").over(along), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
        .join(plan.withColumnRenamed("source", "p_"), F.col("source").eqNullSafe(F.col("p_")))
        .withColumn("offset", F.col("start") + F.col("before"))
    )
    part = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("offset"), F.col("size")))
    first = F.when(F.col("taken") > 0, _invert(F.col("offset") / F.col("target"), F.col("knots")))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + part).select(
        "doc_id", "size", "source", "source_size", "target", "taken", first.alias("position"), "offset", "knots"
    )


def training_order(plan: DataFrame, weight: str = "position") -> DataFrame:
    """Rows range-sorted by training position: partition i holds only earlier positions than partition i + 1."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartitionByRange(parts, weight, "doc_id").sortWithinPartitions(weight, "doc_id")


def occurrences(plan: DataFrame) -> DataFrame:
    """One row for each pass that takes a document whole or by half at least: doc_id, source, pass_no, position."""
    passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    rows = plan.withColumn("pass_no", F.explode(F.when(passes > 0, F.sequence(F.lit(1), passes))))
    served = (F.col("offset") + (F.col("pass_no") - 1) * F.col("source_size")) / F.col("target")
    return rows.withColumn("position", _invert(F.least(served, F.lit(1.0)), F.col("knots"))).drop("offset", "knots")


#: Column names in use while documents are joined; no input column may be called so.
_DOC, _SOURCE, _SIZE, _NTH, _AT = (f"__lodewell_{x}" for x in ("doc", "source", "size", "nth", "at"))


def mixed_documents(docs: DataFrame, schedules=default_schedules, share: Fraction = Fraction(3, 2), max_epochs: int = 2) -> DataFrame:
    """The documents in training order, one row for each time that a document is used.

    Each row of docs has a row of the plan of its own. Of rows that repeat a doc_id, source and size, the plan's first in
    order goes to the one of the smallest text hash, and so on.
    """
    keys = (_DOC, _SOURCE, _SIZE)
    plan = mix_plan(docs, schedules, share, max_epochs)
    numbered = plan.withColumn(_NTH, F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("offset")))
    uses = materialize(occurrences(numbered).select(F.col("doc_id").alias(_DOC), F.col("source").alias(_SOURCE), F.col("size").alias(_SIZE), _NTH, F.col("position").alias(_AT)), "mix-uses")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    told = docs.withColumns({_DOC: F.col("doc_id").cast("bigint"), _SOURCE: F.col("source").cast("string"), _SIZE: size})
    repeated = materialize(plan.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"{k}_") for c, k in zip(("doc_id", "source", "size"), keys)]), "mix-repeated")
    again = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    # only rows that others repeat need a number, so only they are sorted by it
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text")))
    told = told.join(repeated, again, "left_anti").withColumn(_NTH, F.lit(1)).unionByName(told.join(repeated, again, "left_semi").withColumn(_NTH, nth))
    right = uses.select(*[F.col(c).alias(f"{c}_") for c in (*keys, _NTH)], _AT)
    joined = told.join(right, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*keys, _NTH)]).drop(*[f"{c}_" for c in (*keys, _NTH)])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(parts, _AT, "doc_id").sortWithinPartitions(_AT, "doc_id").drop(*keys, _NTH, _AT)
