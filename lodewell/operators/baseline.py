"""Historical distributions, exact and interpolated ranks, rarity bands and impact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions.lineage import cut

QUANTILES = {"p50": (1, 2), "p75": (3, 4), "p90": (9, 10), "p95": (19, 20), "p99": (99, 100), "p999": (999, 1000)}


def quality(n: Column, coverage: Column) -> Column:
    return F.when((n >= 500) & (coverage >= 0.95), "HIGH").when((n >= 100) & (coverage >= 0.8), "MODERATE").when((n >= 30) & (coverage >= 0.5), "DEGRADED").otherwise("INSUFFICIENT")


def placed(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Each distinct value of a group with its count c, ``upto`` (rows of the group at most it) and n (rows of the group).

    Values are range-partitioned by (group, value) and written once; each partition counts its own rows, a small table of
    partition totals gives the offsets. So a group with any number of distinct values is spread over all tasks.
    """
    counted = metrics.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counted.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "part").agg(F.sum("c").alias("t"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"), F.sum("t").over(Window.partitionBy(*by)).alias("n"))
    run = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    # one row a partition and group
    own = ranged.withColumn("own", F.sum("c").over(run)).join(offsets, [*by, "part"])
    return own.select(*by, "value", "c", (F.col("offset") + F.col("own")).alias("upto"), "n")


def distributions(metrics: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """Discrete quantiles of ``value`` in each group: the element at place ceil(q * n), in integer arithmetic."""
    need = lambda q: F.greatest(F.lit(1), F.floor((F.col("n") * q[0] + q[1] - 1) / q[1]))
    found = placed(metrics, by).groupBy(*by).agg(
        F.max("n").alias("sample_count"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum(F.col("value") * F.col("c")).alias("total"),
        *[F.min(F.when(F.col("upto") >= need(q), F.col("value"))).alias(name) for name, q in QUANTILES.items()],
    )
    out = found.join(candidates, [c for c in by if c in candidates.columns], "left")
    n, cand = F.col("sample_count"), F.coalesce("candidate_count", "sample_count")
    coverage = F.when(cand > 0, n / cand).otherwise(1.0)
    return out.select(*by, n, cand.alias("candidate_count"), F.greatest(cand - n, F.lit(0)).alias("missing_count"), coverage.alias("coverage_ratio"), "minimum", *QUANTILES, "maximum", (F.col("total") / n).alias("mean"), quality(n, coverage).alias("quality"))


def value_ranks(metrics: DataFrame, by: list[str]) -> DataFrame:
    """le, ge and population of each distinct value of a group: how many values are at most it, at least it, and all."""
    return placed(metrics, by).select(*by, "value", F.col("upto").alias("le"), (F.col("n") - F.col("upto") + F.col("c")).alias("ge"), F.col("n").alias("population"))


def exact_ranks(metrics: DataFrame, by: list[str], lower_is_rarer: bool = False) -> DataFrame:
    """Every row's percentile and tail in its group, ties inclusive on both sides.

    Counts run over distinct values; rows get them back by a join on the value.
    """
    at, tail = (F.col("ge"), F.col("le")) if lower_is_rarer else (F.col("le"), F.col("ge"))
    scored = value_ranks(metrics, by).select(*by, "value", (100.0 * at / F.col("population")).alias("percentile"), tail.alias("tail"), "population")
    return metrics.join(scored, [*by, "value"])


def interpolated(value: Column, points: list[tuple[float, Column]], n: Column, lower_is_rarer: bool | Column = False) -> tuple[Column, Column]:
    """(percentile, tail) of a value from a distribution's points, (percentile, value) upwards from the minimum.

    Where lower is rarer, the minimum is at 100 and the maximum at 0; between them the percentile is that of the value.
    """
    low, high = points[0][1], points[-1][1]
    inner = None
    for (p0, v0), (p1, v1) in zip(points, points[1:]):
        at = F.when(v1 > v0, p0 + (p1 - p0) * (value - v0) / F.when(v1 > v0, v1 - v0)).otherwise(F.lit(float(p1)))
        inner = F.when(value <= v1, at) if inner is None else inner.when(value <= v1, at)
    lower = lower_is_rarer if isinstance(lower_is_rarer, Column) else F.lit(lower_is_rarer)
    ends = F.when(lower, 100.0).otherwise(0.0), F.when(lower, 0.0).otherwise(100.0)
    pct = F.when(value <= low, ends[0]).when(value >= high, ends[1]).otherwise(inner)
    tail = F.when(value <= low, n).when(value >= high, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((100.0 - pct) / 100.0 * n)))
    return pct, tail.cast("bigint")


def band(percentile: Column, population: Column, least: int) -> Column:
    return F.when(population < least, "INSUFFICIENT_DATA").when(percentile >= 99.9, "EXTREME").when(percentile >= 99, "RARE").when(percentile >= 95, "UNUSUAL").when(percentile >= 90, "NOTABLE").otherwise("COMMON")


def one_in(population: Column, tail: Column) -> Column:
    return F.when(tail > 0, F.floor(population / F.when(tail > 0, tail))).otherwise(population).cast("bigint")


def impact(ranked: DataFrame, weights: DataFrame, event: str, by: list[str], least_population: int = 100, least_coverage: float = 0.5) -> DataFrame:
    """Points of each metric at or above the median, summed; null without enough matched metrics or population."""
    parts = ranked.join(F.broadcast(weights), by)  # a fixed table of a few rows
    p = F.col("percentile")
    points = F.round(F.when(p >= 50, F.col("weight") * (p - 50) / 50).otherwise(0.0), 2)
    out = parts.groupBy(event, by[0]).agg(F.sum(points).alias("raw"), F.count(F.lit(1)).alias("matched"), F.max("components").alias("components"), F.min("population").alias("least"))
    coverage = F.col("matched") / F.col("components")
    fine = (coverage >= least_coverage) & (F.col("least") >= least_population)
    return out.select(event, by[0], coverage.alias("component_coverage"), F.when(fine, F.round("raw", 2)).alias("score"))


def event_rarity(metrics: DataFrame, dists: DataFrame, by: list[str], lower: Column, run_end: int, least: int = 100, asked: DataFrame | None = None) -> DataFrame:
    """Percentile, tail, band and evaluation mode of every event's metrics, or of those asked for, which may lie outside.

    The rank is exact where the population has ``least`` values, else read off the stored distribution where that has,
    else there is none. ``lower`` says for which rows small values are the rare ones.
    """
    if asked is None:
        ranked = metrics.join(value_ranks(metrics, by), [*by, "value"])
    else:  # a few values: counted in one pass over the population
        few = asked.select(*by, F.col("value").alias("own")).distinct()
        count = metrics.join(few, by).groupBy(*by, "own").agg(F.count_if(F.col("value") <= F.col("own")).alias("le"), F.count_if(F.col("value") >= F.col("own")).alias("ge"), F.count(F.lit(1)).alias("population"))
        ranked = asked.join(count.withColumnRenamed("own", "value"), [*by, "value"], "left").fillna(0, ["le", "ge", "population"])
    at, own_tail = F.when(lower, F.col("ge")).otherwise(F.col("le")), F.when(lower, F.col("le")).otherwise(F.col("ge"))
    points = [(0.0, "minimum"), (50.0, "p50"), (75.0, "p75"), (90.0, "p90"), (95.0, "p95"), (99.0, "p99"), (99.9, "p999"), (100.0, "maximum")]
    joined = ranked.join(dists.select(*by, "sample_count", *[c for _, c in points]), by, "left")
    i_pct, i_tail = interpolated(F.col("value"), [(p, F.col(c)) for p, c in points], F.col("sample_count"), lower)
    exact, stored = F.col("population") >= least, F.coalesce(F.col("sample_count"), F.lit(0)) >= least
    n = F.when(exact, F.col("population")).otherwise(F.coalesce("sample_count", F.lit(0)))
    percentile = F.when(exact, 100.0 * at / F.col("population")).when(stored, i_pct)
    tail = F.when(exact, own_tail).when(stored, i_tail)
    method = F.when(exact, "EXACT").when(stored, "DISTRIBUTION").otherwise("INSUFFICIENT")
    height = F.col("block_height")
    mode = F.when(height.isNull() | (height <= run_end), "RETROSPECTIVE").otherwise("POINT_IN_TIME")
    return joined.select("id", *by, "value", method.alias("method"), percentile.alias("percentile"), tail.alias("tail"), n.alias("sample_count"), band(percentile, n, least).alias("band"), mode.alias("evaluation_mode"))


def with_primary(rows: DataFrame, events: DataFrame, primary: dict[str, str], run_end: int) -> DataFrame:
    """Rarity rows with ``is_primary``, and for events without their type's primary metric a row that says so.

    primary: the metric of each event type. Such a row has value 0, no percentile and an empty population.
    """
    kind = F.create_map(*[F.lit(x) for pair in primary.items() for x in pair])
    marked = rows.withColumn("is_primary", F.coalesce(F.col("metric") == kind[F.col("event_type")], F.lit(False)))
    bare = events.select("id", "event_type", "block_height").join(marked.filter("is_primary").select("id"), "id", "left_anti")
    mode = F.when(F.col("block_height").isNull() | (F.col("block_height") <= run_end), "RETROSPECTIVE").otherwise("POINT_IN_TIME")
    own = {"metric": F.coalesce(kind[F.col("event_type")], F.lit("value_sats")), "value": F.lit(0), "method": F.lit("EXACT"), "tail": F.lit(0), "sample_count": F.lit(0), "band": F.lit("INSUFFICIENT_DATA"), "evaluation_mode": mode, "is_primary": F.lit(True)}
    filled = bare.select(*[(own[c] if c in own else F.col(c) if c in ("id", "event_type") else F.lit(None)).cast(marked.schema[c].dataType).alias(c) for c in marked.columns])
    return marked.unionByName(filled)
