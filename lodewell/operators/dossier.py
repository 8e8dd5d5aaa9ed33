"""Dossiers of incidents: records gathered one by one, given out as tables, checked, saved, and read back whole."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.operators import incidents

#: A dossier's lists: their fields, and the field in whose order a list is read (nulls last, - for the newest first).
LISTS = {
    "sources": ("id string, publisher string, title string, url string, published_at timestamp, retrieved_at timestamp, category string, reliability double, name string", "published_at"),
    "evidence": ("id string, kind string, classification string, title string, description string, observed_at timestamp, source_id string, reference string, txid string, block_hash string, block_height bigint, network string, verified boolean, raw_data string", "observed_at"),
    "transactions": ("network string, txid string, role string, amount_sats bigint, block_height bigint, block_hash string, confirmed_at timestamp, evidence_id string, notes string", "confirmed_at"),
    "blocks": ("network string, height bigint, hash string, mined_at timestamp, tx_count bigint, evidence_id string", "height"),
    "entities": ("id string, name string, kind string, description string, confidence string", ""),
    "messages": ("txid string, network string, encoding string, text string, raw_hex string, confirmed_at timestamp, block_height bigint, attributed_sender string, confidence string", "confirmed_at"),
    "timeline": ("id string, happened_at timestamp, title string, description string, category string, source_id string, evidence_ids array<string>, txids array<string>, heights array<bigint>, classification string", "happened_at"),
    "findings": ("component string, area string, category string, summary string, details string, fix string, repository_url string, pull_request string, commit_hash string", ""),
    "updates": ("id string, happened_at timestamp, title string, summary string, source_id string, affected_sats bigint, recovered_sats bigint", "-happened_at"),
    "nodes": ("node string, label string, kind string, network string, metadata string", ""),
    "edges": ("source string, target string, relationship string, confidence string", ""),
    "claims": ("classification string, text string", ""),
}

CASE = "id string, case_id string, title string, summary string, status string, severity string, first_observed_at timestamp, last_updated_at timestamp"
RECOVERY = "as_of timestamp, affected_sats bigint, recovered_sats bigint, outstanding_sats bigint, source string, is_estimate boolean"

#: The plain lists that claims of each class also stand in.
PLAIN = {"verified_on_chain": "facts", "officially_attributed": "reported_claims", "reported": "reported_claims", "heuristic": "unverified_claims", "unknown": "unverified_claims"}


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def _frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Rows of JSON values as a table with their places; a value that does not fit its field is an error."""
    placed = json.dumps([{"pos": i, **r} for i, r in enumerate(rows)])
    return spark.createDataFrame([(placed,)], "j string").select(F.from_json("j", f"array<struct<pos: int, {ddl.replace(' ', ': ').replace(',: ', ', ')}>>", {"mode": "FAILFAST"}).alias("r")).selectExpr("inline(r)")


class Dossier:
    """One incident in the making."""

    def __init__(self, case_id: str, title: str, summary: str, severity: str, **rest) -> None:
        self.case = {"id": case_id, "case_id": case_id, "title": title, "summary": summary, "severity": severity, "status": "DETECTED", **rest}
        self.snapshot: dict = {"affected_sats": 0, "recovered_sats": 0, "outstanding_sats": 0, "is_estimate": False}
        self.lists: dict[str, list[dict]] = {name: [] for name in LISTS}

    @classmethod
    def of_json(cls, text: str) -> Dossier:
        """From an object with the case's own fields, ``recovery`` and the lists."""
        data = json.loads(text)
        out = cls(**{k: v for k, v in data.items() if k not in LISTS and k not in ("recovery", "targets")})
        for name in LISTS:
            for record in data.get(name, []):
                out.add(name, **record)
        return out.recovery(**data["recovery"]) if "recovery" in data else out

    def add(self, name: str, /, **record) -> Dossier:
        if unknown := set(record) - set(_names(LISTS[name][0])):
            raise ValueError(f"{name} have no {', '.join(sorted(unknown))}")
        if name == "claims" and record.get("classification") not in PLAIN:
            raise ValueError(f"no class of claims: {record.get('classification')}")
        self.lists[name].append(record)
        return self

    def recovery(self, as_of: str, affected_sats: int, recovered_sats: int, **rest) -> Dossier:
        self.snapshot = {"as_of": as_of, "affected_sats": affected_sats, "recovered_sats": recovered_sats, "outstanding_sats": max(affected_sats - recovered_sats, 0), "is_estimate": False, **rest}
        return self

    def sort_timeline(self) -> Dossier:
        """By time written as ISO text in one zone; entries of the same time stay in their order."""
        self.lists["timeline"].sort(key=lambda r: r["happened_at"])
        return self

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The case with its plain lists and everything it is linked with, ``snapshots``, and each list, all with incident_id."""
        plain = {kind: [c["text"] for c in self.lists["claims"] if PLAIN[c["classification"]] == kind] for kind in dict.fromkeys(PLAIN.values())}
        linked = {"txids": [r["txid"] for r in self.lists["transactions"]], "heights": [r["height"] for r in self.lists["blocks"]]}
        case = {**self.case, **plain, **{k: list(dict.fromkeys(v)) for k, v in linked.items()}}
        own = ", ".join([CASE, *(f"{k} array<string>" for k in plain), "txids array<string>, heights array<bigint>"])
        out = {"case": _frame(spark, [case], own).drop("pos"), "snapshots": _frame(spark, [self.snapshot], RECOVERY).drop("pos")}
        out |= {name: _frame(spark, rows, LISTS[name][0]) for name, rows in self.lists.items()}
        return {name: df.withColumn("incident_id", F.lit(self.case["id"])) for name, df in out.items()}

    def violations(self, spark: SparkSession) -> DataFrame:
        t = {name: df.withColumn("incident", F.col("incident_id")) for name, df in self.tables(spark).items()}
        timed = lambda name: t[name].select("incident", "pos", F.col("happened_at").alias("at"))
        return incidents.violations(t["snapshots"], t["edges"], t["nodes"], timed("timeline"), t["evidence"], t["messages"].withColumn("id", F.col("txid")), timed("updates"))

    def save(self, store) -> None:
        """Check the dossier and write it; one that breaks a rule is not written."""
        if broken := self.violations(store.spark).orderBy("rule", "detail").collect():
            raise ValueError("; ".join(f"{r['rule']} {r['detail']}".strip() for r in broken))
        t = self.tables(store.spark)
        store.save_incident(t["case"].drop("incident_id"), t["snapshots"].filter("as_of IS NOT NULL"), {name: t[name] for name in LISTS})


def assemble(store, incident: str | None = None) -> DataFrame:
    """Stored dossiers, or one, with all their lists in order and the latest state of recovery, as one version has them."""
    store = store.at() if store.version is None else store
    only = lambda df: df if incident is None else df.filter(F.col("incident_id") == incident)
    out = only(store.table("dossiers"))
    for name, (ddl, order) in LISTS.items():
        rows = store.table(f"incident_{name}") if store.has(f"incident_{name}") else store.spark.createDataFrame([], f"pos int, {ddl}, incident_id string")
        at = F.col(order.lstrip("-")).cast("timestamp" if order.endswith("_at") else "bigint") if order else F.lit(None)
        key = (F.unix_micros(at) if order.endswith("_at") else at).cast("bigint")
        keyed = only(rows).withColumns({"late": key.isNull(), "key": -key if order.startswith("-") else key})
        out = incidents.nest(out, keyed, "incident_id", ["late", "key", "pos", *_names(ddl)], name)
        out = out.withColumn(name, F.transform(name, lambda x: x.dropFields("late", "key", "pos")))
    if not store.has("incident_snapshots"):
        return out
    return out.join(incidents.latest_snapshot(only(store.table("incident_snapshots")), "incident_id", ["as_of"]), "incident_id", "left")


def example() -> Dossier:
    """A made-up case that is bundled with the package."""
    return Dossier.of_json(EXAMPLE.read_text())


def example_targets(spark: SparkSession) -> DataFrame:
    """The made-up case's watch targets: outpoints, a transaction and addresses."""
    data = json.loads(EXAMPLE.read_text())
    rows = [{"incident_id": data["case_id"], **t} for t in data["targets"]]
    return _frame(spark, rows, "id string, incident_id string, target_type string, txid string, vout int, address string, script_hex string, label string, active boolean").drop("pos")


EXAMPLE = Path(__file__).parent / "example_case.json"
