"""Incident dossiers: assembly of child records, recovery figures, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recovery(df: DataFrame, affected: str, recovered: str) -> DataFrame:
    a, r = F.col(affected), F.col(recovered)
    return df.withColumns({"outstanding_sats": F.greatest(a - r, F.lit(0)), "recovered_pct": F.when(a > 0, r * 100.0 / a).otherwise(0.0)})


def latest_snapshot(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in snapshots.columns if c not in (key, *order)]
    return snapshots.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, "m.*")


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], into: str) -> DataFrame:
    """Parents with an array of their children, in the order of the fields; empty without any."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(lists.schema[into].dataType)))


def _late(rows: DataFrame, rule: str) -> DataFrame:
    before = F.lag("at").over(Window.partitionBy("incident").orderBy("pos"))
    return rows.withColumn("before", before).filter("at < before").select("incident", F.lit(rule).alias("rule"), F.col("pos").cast("string").alias("detail"))


def _doubled(rows: DataFrame, column: str, rule: str) -> DataFrame:
    return rows.groupBy("incident", column).count().filter("count > 1").select("incident", F.lit(rule).alias("rule"), F.col(column).alias("detail"))


def violations(dossiers: DataFrame, edges: DataFrame, nodes: DataFrame, timeline: DataFrame, evidence: DataFrame | None = None, messages: DataFrame | None = None, updates: DataFrame | None = None) -> DataFrame:
    """(incident, rule, detail) of what breaks a rule.

    Recovered over affected; an outstanding amount that is not their difference, unless it is an estimate (if dossiers
    have outstanding_sats); dangling edges; doubled nodes and evidence; times of the timeline and of updates that go
    back; messages whose sender is named and held to be verified on chain.
    """
    rule = lambda df, name, detail: df.select("incident", F.lit(name).alias("rule"), detail.alias("detail"))
    ids = nodes.select("incident", F.col("node").alias("end")).distinct()
    ends = edges.select("incident", F.explode(F.array("source", "target")).alias("end"))
    found = [
        rule(dossiers.filter(F.col("recovered_sats") > F.col("affected_sats")), "recovered_over_affected", F.lit("")),
        rule(ends.join(ids, ["incident", "end"], "left_anti").distinct(), "dangling_edge", F.col("end")),
        _doubled(nodes, "node", "duplicate_node"),
        _late(timeline, "timeline_order"),
    ]
    if "outstanding_sats" in dossiers.columns:
        left = F.greatest(F.col("affected_sats") - F.col("recovered_sats"), F.lit(0))
        found.append(rule(dossiers.filter(~F.coalesce("is_estimate", F.lit(False)) & (F.col("outstanding_sats") != left)), "outstanding_mismatch", left.cast("string")))
    if evidence is not None:
        found.append(_doubled(evidence, "id", "duplicate_evidence"))
    if messages is not None:
        found.append(rule(messages.filter(F.col("attributed_sender").isNotNull() & (F.col("confidence") == "ON_CHAIN_VERIFIED")), "self_attributed_identity", F.col("id").cast("string")))
    if updates is not None:
        found.append(_late(updates, "update_order"))
    return reduce(DataFrame.unionByName, found)


def claim_errors(claims: DataFrame) -> DataFrame:
    """Claims with the rule that each breaks, or null: ownership, on-chain backing, sender identity, in that order."""
    c = F.col("classification")
    broken = (
        F.when((F.col("kind") == "ownership") & ~c.isin("ON_CHAIN_VERIFIED", "OFFICIALLY_ATTRIBUTED"), "ownership_not_definitive")
        .when((F.col("kind") == "fact") & (c != "ON_CHAIN_VERIFIED"), "fact_without_chain_backing")
        .when((F.col("kind") == "sender") & F.col("self_attributed") & (c == "ON_CHAIN_VERIFIED"), "self_attributed_identity")
    )
    return claims.withColumn("violation", broken)


def first_nodes(nodes: DataFrame, key: str, order: str) -> DataFrame:
    """Graph nodes once each: the first of each id."""
    rest = [x for x in nodes.columns if x not in (key, order)]
    return nodes.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("m")).select(key, *[F.col(f"m.{x}").alias(x) for x in rest])
