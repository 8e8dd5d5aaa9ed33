"""A store of tables under one folder, with the questions that users ask of it. Every answer is a DataFrame."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.identity import uuid5
from lodewell.operators import baseline, incidents, metrics, provenance, replay, watch
from lodewell.plans.versions import Keyed, Versions

#: Aliases that event types are also known by.
EVENT_ALIASES = {"large_transaction": "LARGE_TRANSFER", "dormant_coins": "DORMANT_COINS_MOVED", "fanout": "FAN_OUT", "DORMANT_UTXO_SPENT": "DORMANT_COINS_MOVED", "FEE_SPIKE": "EXTREME_FEE", "RBF_REPLACEMENT": "TRANSACTION_REPLACEMENT"}
NETWORK_ALIASES = {"bitcoin": "mainnet", "main": "mainnet", "test": "testnet"}


def event_type(name: str) -> str:
    return EVENT_ALIASES.get(name, EVENT_ALIASES.get(name.lower(), name.upper()))


def network(name: str) -> str:
    return NETWORK_ALIASES.get(name, name)


#: Tables whose rows have keys; all others are plain folders of Parquet.
KEYED = {
    "events": Keyed(("id",)),
    "headers": Keyed(("block_hash",)),
    "gone_blocks": Keyed(("block_hash",)),
    "outputs": Keyed(("txid", "n")),
    "alerts": Keyed(("id",)),
    "followed_points": Keyed(("prev_txid", "prev_vout", "target_id")),
    "incident_snapshots": Keyed(("incident_id", "as_of")),
    "observations": Keyed(("id",), "merge", provenance.REFRESHED),
    "event_metrics": Keyed(("event_id", "metric", "metric_definition_version"), "merge", ("value", "scale", "block_height", "event_time", "network")),
    "dossiers": Keyed(("incident_id",), "whole"),
}


def keyed(name: str) -> Keyed | None:
    return KEYED.get(name) or (Keyed(("incident_id",), "whole") if name.startswith("incident_") else None)


class Store:
    """Tables: events, observations, outputs, incidents, dossiers and their children, activities, alerts, targets, event_metrics, run_states, distributions, jobs, checkpoints.

    Keyed tables are written in versions (see ``versions``); rows of theirs in a plain folder count as older than all of these.
    A store made by ``at`` reads the keyed tables as one version has them.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, bucket_rows: int = 1_000_000) -> None:
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.versions = Versions(spark, self.root, keyed, bucket_rows)

    def at(self, version: int | None = None) -> Store:
        """The store as a version has it, by default the last: what is read of it does not change."""
        return Store(self.spark, self.root, max(self.versions.numbers(), default=0) if version is None else version, self.versions.bucket_rows)

    def _plain(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}") if self._folder(name) else None

    def table(self, name: str) -> DataFrame:
        rows = self.versions.read(name, self._plain(name), self.version) if keyed(name) else None
        return self.spark.read.parquet(f"{self.root}/{name}") if rows is None else rows

    def lookup(self, name: str, wanted: DataFrame) -> DataFrame | None:
        """The rows of a keyed table whose keys ``wanted`` holds; what is read grows with these, not with the table."""
        return self.versions.lookup(name, wanted, self._plain(name), self.version)

    def append(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._folder(name) or name in self.versions.state(self.version)["tables"]

    def _folder(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def append_new(self, name: str, rows: DataFrame, key: str | list[str]) -> int | None:
        """Rows whose key is not stored yet; of a keyed table, how many these were."""
        keys = [key] if isinstance(key, str) else key
        how = keyed(name)
        if how:
            if set(how.keys) != set(keys):
                raise ValueError(f"{name} is keyed by {', '.join(how.keys)}")
            return self.versions.written(self.put({name: rows}), name)
        rows = rows.dropDuplicates(keys)
        self.append(name, rows.join(self.table(name).select(*keys), keys, "left_anti") if self.has(name) else rows)

    def replace_of(self, name: str, rows: DataFrame, by: str) -> None:
        """Overwrite the stored rows of every value of ``by`` that the rows hold; the rest stay."""
        if keyed(name):
            self.put({name: rows})
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{name}")

    def put(self, writes: dict[str, DataFrame], replaced: DataFrame | None = None) -> int:
        """Write keyed tables, seen all at once; the version that has them."""
        return self.versions.put(writes, {name: self._plain(name) for name in writes}, replaced)

    def save_incident(self, incident: DataFrame, snapshots: DataFrame, children: dict[str, DataFrame]) -> None:
        """A dossier and its child tables, each with incident_id, in one version. Children are replaced whole for the incidents given.

        Recovery snapshots only grow: one for each (incident_id, as_of). A reader finds all of a save or nothing of it.
        """
        owner = incident.withColumn("incident_id", F.col("id"))
        self.put({**{f"incident_{name}": rows for name, rows in children.items()}, "incident_snapshots": snapshots, "dossiers": owner}, owner.select("incident_id"))

    def dossier(self, incident: str, children: dict[str, list[str]]) -> DataFrame:
        """A dossier with arrays of its children, each in the order of the fields named, and its latest snapshot."""
        seen = self if self.version is not None else self.at()  # all of one version
        out = seen.table("dossiers").filter(F.col("incident_id") == incident)
        for name, fields in children.items():
            out = incidents.nest(out, seen.table(f"incident_{name}").filter(F.col("incident_id") == incident), "incident_id", fields, name)
        last = incidents.latest_snapshot(seen.table("incident_snapshots").filter(F.col("incident_id") == incident), "incident_id", ["as_of"])
        return out.join(last, "incident_id", "left")

    def _write(self, name: str, rows: DataFrame) -> None:
        """Append rows as one numbered write; readers merge the writes of a key."""
        n = self.table(name).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1 if self.has(name) else 1
        self.append(name, rows.withColumn("seq", F.lit(n).cast("bigint")))

    def save_activities(self, rows: DataFrame) -> int:
        """Activities with ids from their dedup keys; the alerts of those that are new, whose number is returned.

        Every write is kept. What is read of an activity is its first write, but status and height of its last.
        """
        lacking = {c: F.lit(None).cast(kind) for c, kind in (("status", "string"), ("block_height", "bigint"), ("block_hash", "string")) if c not in rows.columns}
        rows = rows.withColumns({**lacking, "id": uuid5(F.col("dedup_key"))}).dropDuplicates(["dedup_key"])
        rows = rows.select(*sorted(rows.columns))
        self._write("activity_writes", rows)
        words = F.initcap(F.replace(F.lower("activity_type"), F.lit("_"), F.lit(" ")))
        needed = {"case_id": F.lit(None).cast("string"), "description": words, "target_label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"), "txid": F.lit(None).cast("string"), "value_sats": F.lit(None).cast("bigint")}
        made = watch.alerts(rows.withColumns({c: v for c, v in needed.items() if c not in rows.columns}), self.table("incidents").select("case_id", "title") if self.has("incidents") else None)
        ids = {"id": uuid5(F.concat(F.lit("alert:"), "dedup_key")), "activity_id": uuid5(F.col("dedup_key"))}
        return self.append_new("alerts", made.withColumns(ids).drop("dedup_key"), "id")

    def activities(self) -> DataFrame:
        return provenance.merge_events(self.table("activity_writes"), "id", "seq", ("status", "block_height", "block_hash"))

    def save_observations(self, rows: DataFrame) -> None:
        """Observations by id: what is kept is the first write, but source, witness, status and sequences of the last."""
        self.put({"observations": rows})

    def all_observations(self) -> DataFrame:
        """One row an observation, merged from its writes."""
        return self.table("observations")

    def save_event_texts(self, rows: DataFrame) -> None:
        """New titles, descriptions and metadata of events (id, title, description, metadata); what is null stays as it was."""
        self._write("event_texts", rows.select("id", "title", "description", "metadata"))

    def events(self) -> DataFrame:
        """Stored events with their last texts."""
        events = self.table("events")
        if not self.has("event_texts"):
            return events
        last = provenance.last_by(self.table("event_texts"), ["id"], "seq").select("id", *[F.col(c).alias(f"new_{c}") for c in ("title", "description", "metadata")])
        joined, own = events.join(last, "id", "left"), [c for c in ("title", "description", "metadata") if c in events.columns]
        return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in own}).select(*events.columns)

    def save_watch_targets(self, rows: DataFrame) -> None:
        """Targets by id: a later write updates classification, sources, label and whether a target is active."""
        self._write("target_writes", rows)

    def watch_targets(self, incident: str | None = None) -> DataFrame:
        out = provenance.last_by(self.table("target_writes"), ["id"], "seq").drop("seq")
        return out if incident is None else out.filter(F.col("incident_id") == incident)

    def seed_targets(self, rows: DataFrame) -> None:
        """Targets of ids and of (incident, kind, value) that are not stored yet, each once."""
        value = F.coalesce("txid", "address", "script_hex", F.lit(""))
        keyed = rows.withColumn("own", F.concat_ws("/", "incident_id", "target_type", value, F.coalesce(F.col("vout").cast("string"), F.lit("")))).dropDuplicates(["own"]).dropDuplicates(["id"])
        if self.has("target_writes"):
            stored = self.watch_targets()
            known = stored.select(F.concat_ws("/", "incident_id", "target_type", value, F.coalesce(F.col("vout").cast("string"), F.lit(""))).alias("own"))
            keyed = keyed.join(known, "own", "left_anti").join(stored.select("id"), "id", "left_anti")
        self.save_watch_targets(keyed.drop("own"))

    def _log(self, name: str, **row) -> None:
        """One row of an append-only control table; rows are told apart by a growing number."""
        n = self.table(name).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1 if self.has(name) else 1
        self.append(name, self.spark.createDataFrame([(n, *row.values())], "seq bigint, " + ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())))

    def save_job(self, job: str, span: replay.ReplayRange, status: str) -> None:
        self._log("jobs", id=job, start_height=span.start, end_height=span.end, status=status)

    def job(self, job: str):
        """The last state of a job, or None."""
        return self.table("jobs").filter(F.col("id") == job).orderBy(F.desc("seq")).first() if self.has("jobs") else None

    def set_job(self, job: str, status: str) -> None:
        """Pause, go on or cancel: only jobs that have not ended change."""
        state = self.job(job)
        if state is None or state["status"] not in replay.ACTIVE:
            raise ValueError("no such job, or it has ended")
        self.save_job(job, replay.ReplayRange(state["start_height"], state["end_height"]), status)

    def save_checkpoint(self, job: str, height: int) -> None:
        self._log("checkpoints", job=job, completed_height=height)

    def checkpoint(self, job: str) -> int | None:
        return self.table("checkpoints").filter(F.col("job") == job).agg(F.max("completed_height")).first()[0] if self.has("checkpoints") else None

    def outputs(self) -> DataFrame:
        return self.table("outputs")

    def save_baseline(self, start: int, end: int, net: str = "mainnet", version: str = "v2") -> str:
        """Compute and store a range's distributions; the run's id. A run that fails stays stored as failed."""
        run = self.spark.range(1).select(uuid5(F.lit(f"baseline:{network(net)}:{start}:{end}:{version}"))).first()[0]
        state = {"run": run, "network": network(net), "start_height": start, "end_height": end, "algorithm_version": version}
        self._log("run_states", **state, status="RUNNING")
        try:
            self.replace_of("distributions", self.create_baseline(start, end, net).withColumn("baseline_run_id", F.lit(run)), "baseline_run_id")
        except Exception:
            self._log("run_states", **state, status="FAILED")
            raise
        self._log("run_states", **state, status="COMPLETED")
        return run

    def runs(self) -> DataFrame:
        """Baseline runs in their last states; completed_at is the number of the entry that ended the run."""
        last = provenance.last_by(self.table("run_states"), ["run"], "seq")
        return last.withColumn("completed_at", F.when(F.col("status") == "COMPLETED", F.col("seq")))

    def rarity(self, run: str, least: int = 100, event_id: str | None = None) -> DataFrame:
        """Rarity of all events of a run's network, or of one, against the run's range; one of another network is refused."""
        state = self.runs().filter(F.col("run") == run).first()
        if event_id is not None:
            nets = {network(r[0] or "mainnet") for r in self.table("events").filter(F.col("id") == event_id).select("network").distinct().collect()}
            if nets - {state["network"]}:
                raise ValueError(f"the event is of {', '.join(sorted(nets))}, the run of {state['network']}")
        rows = self.population(state["start_height"], state["end_height"], state["network"]).withColumnRenamed("event_id", "id")
        lower = F.concat_ws("/", "event_type", "metric").isin([f"{kind}/{metric}" for kind, metric, _, _, _, rare, _, _ in metrics.REGISTRY if rare])
        dists = self.table("distributions").filter(F.col("baseline_run_id") == run)
        asked = None if event_id is None else self.table("event_metrics").filter(F.col("event_id") == event_id).withColumnRenamed("event_id", "id")
        return baseline.event_rarity(rows, dists, ["event_type", "metric"], lower, state["end_height"], least, asked)

    def impact(self, run: str, least: int = 100, event_id: str | None = None) -> DataFrame:
        """Impact scores of all events of a run, or of one, by the registry's weights."""
        sizes = Counter(kind for kind, *_ in metrics.REGISTRY)
        weights = self.spark.createDataFrame([(kind, metric, w, sizes[kind]) for kind, metric, *_, w in metrics.REGISTRY], "event_type string, metric string, weight double, components int")
        ranked = self.rarity(run, least, event_id).filter("method <> 'INSUFFICIENT'").withColumnRenamed("sample_count", "population")
        return baseline.impact(ranked, weights, "id", ["event_type", "metric"], least)

    def query_events(self, mode: str | None = None, job: str | None = None, **wanted) -> DataFrame:
        """Events by mode, by the replay job that observed them, and by the predicates of ``filter_events``."""
        if wanted.get("event_type"):
            wanted["event_type"] = event_type(wanted["event_type"])
        events = self.events()
        if mode:
            events = provenance.in_mode(events, self.table("observations"), mode)
        if job:
            events = provenance.in_job(events, self.table("observations"), job)
        return provenance.filter_events(events, **wanted)

    def event(self, event_id: str) -> DataFrame:
        one = self.events().filter(F.col("id") == event_id)
        seen = self.observations(event_id)
        return provenance.with_observations(one, seen, ["observed_at", "mode"])

    def observations(self, event_id: str) -> DataFrame:
        """An event's observations in the order of time; only its own writes are merged."""
        return self.all_observations().filter(F.col("event_id") == event_id).orderBy("observed_at", "id")

    def incidents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return provenance.page(self.table("incidents"), ["case_id", "id"], limit, offset)

    def incident(self, case: str) -> DataFrame:
        """By id or by case id in any case of letters."""
        return self.table("incidents").filter((F.col("id") == case) | (F.lower("case_id") == case.lower()))

    def _of_incident(self, rows: DataFrame, incident: str | None, status: str | None, limit: int, offset: int) -> DataFrame:
        if incident is not None:
            rows = rows.filter(F.col("incident_id") == incident)
        if status is not None:
            rows = rows.filter(F.col("status") == status)
        return provenance.page(rows, [F.desc("observed_at"), "id"], limit, offset)

    def activity(self, incident: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._of_incident(self.activities(), incident, status, limit, offset)

    def alerts(self, incident: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._of_incident(self.table("alerts"), incident, None, limit, offset)

    def activity_by_key(self, dedup_key: str) -> DataFrame:
        return self.activities().filter(F.col("dedup_key") == dedup_key)

    def public_watch_targets(self, incident: str) -> DataFrame:
        """Stored targets, or those of a table named targets."""
        own = self.watch_targets(incident) if self.has("target_writes") else self.table("targets").filter(F.col("incident_id") == incident)
        return watch.public_targets(own).limit(100)

    def distributions(self, kind: str | None = None, metric: str | None = None, limit: int = 100) -> DataFrame:
        """Stored distributions of a type and metric, those of the newest runs first."""
        rows = self.table("distributions").join(self.runs().select(F.col("run").alias("baseline_run_id"), F.col("seq").alias("written")), "baseline_run_id")
        if kind is not None:
            rows = rows.filter(F.col("event_type") == event_type(kind))
        if metric is not None:
            rows = rows.filter(F.col("metric") == metric)
        return provenance.page(rows, [F.desc("written"), "event_type", "metric"], limit, most=1000)

    def event_detail(self, event_id: str, run: str, least: int = 100) -> DataFrame:
        """An event with its observations, its primary and other rarity rows, and its impact score by a run."""
        found = self.event(event_id).filter(F.col("id") == event_id)
        state = self.runs().filter(F.col("run") == run).first()
        primary = {kind: metric for kind, metric, _, _, first, *_ in metrics.REGISTRY if first}
        rows = baseline.with_primary(self.rarity(run, least, event_id), found, primary, state["end_height"])
        entry = F.struct("metric", "value", "method", "percentile", "tail", "sample_count", "band", "evaluation_mode")
        summary = rows.groupBy("id").agg(F.max(F.when(F.col("is_primary"), entry)).alias("primary"), F.array_sort(F.collect_list(F.when(~F.col("is_primary"), entry))).alias("secondary"))
        return found.join(summary, "id", "left").join(self.impact(run, least, event_id).select("id", "component_coverage", F.col("score").alias("impact")), "id", "left")

    def population(self, start: int, end: int, net: str = "mainnet") -> DataFrame:
        """Metrics of events with a height in a range, of one network."""
        rows = self.table("event_metrics").filter(F.col("block_height").between(start, end))
        return rows.filter(F.col("network") == network(net))

    def create_baseline(self, start: int, end: int, net: str = "mainnet") -> DataFrame:
        """Distributions of each event type and metric over a height range."""
        events = self.table("events").filter(F.col("block_height").between(start, end) & (F.coalesce("network", F.lit("mainnet")) == network(net)))
        candidates = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("candidate_count"))
        return baseline.distributions(self.population(start, end, net), candidates, ["event_type", "metric"])

    def baseline_run(self, height: int, net: str = "mainnet", version: str = "v2") -> DataFrame:
        return metrics.latest_run(self.runs(), network(net), height, version)

    def event_rarity(self, event_id: str, run: str, least: int = 100) -> DataFrame:
        """Percentile, tail, band and evaluation mode of each of an event's metrics by a run: those of ``rarity``."""
        rows = self.rarity(run, least, event_id)
        return rows.withColumn("one_in", baseline.one_in(F.col("sample_count"), F.col("tail")))

    def count(self, source: str, step: int, **values: int) -> None:
        """Counters of a step of a replay, or of a batch of a stream; those of a step that is told again replace the first."""
        rows = [(source, step, name, int(value), time.time_ns()) for name, value in values.items()]
        self.append("counters", self.spark.createDataFrame(rows, "source string, step bigint, name string, value bigint, written bigint").coalesce(1))

    def flow(self, source: str | None = None) -> DataFrame:
        """name and value: counters over all steps, of one source or of all.

        A step that is run again after it wrote its events tells them as known, not as new.
        """
        rows = self.table("counters") if source is None else self.table("counters").filter(F.col("source") == source)
        return rows.groupBy("source", "step", "name").agg(F.max_by("value", "written").alias("value")).groupBy("name").agg(F.sum("value").alias("value"))

    def counters(self) -> DataFrame:
        """Rows, kinds and heights of what a pipeline has stored, by event type and network."""
        return self.table("events").groupBy("event_type", "network").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("txid").alias("transactions"), F.min("block_height").alias("first_height"), F.max("block_height").alias("last_height"), F.max("event_time").alias("last_seen"))

    def status(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in ("events", "incidents", "alerts")} | {"observations": self.all_observations().count(), "activities": self.activities().count() if self.has("activity_writes") else 0}

    def create_replay(self, start: int, end: int, tip: int | None = None) -> DataFrame:
        span = replay.ReplayRange(start, end)
        span.check(tip)
        return self.spark.range(1).select(uuid5(F.lit(f"replay:{start}:{end}")).alias("id"), F.lit(start).alias("start_height"), F.lit(end).alias("end_height"), F.lit("PENDING").alias("status"))
