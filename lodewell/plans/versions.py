"""Keyed Parquet tables of a store under numbered manifests: a reader sees one version of all tables, whole.

A write lands as a run, a folder that nobody reads yet; a manifest that names it makes it seen, with the runs of every
other table of the same write, by one rename that fails where another writer was first. Runs that have gathered are
merged into one, dealt by the hash of the key into buckets of about the same size, however large the table: a look-up of
k keys reads k buckets of a run at most. Old versions can be read until ``vacuum``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.functions.lineage import cut

#: Runs of like size that are merged into one; a run of over LARGER times what follows it is left alone.
FEW, LARGER = 4, 4


@dataclass(frozen=True)
class Keyed:
    """How writes of a key meet.

    new: a key that is stored already is not written again, so rows are read as they lie.
    merge: the first write's row, but the last write's columns named by ``refreshed`` (None: all that are no key).
    whole: a write replaces all rows of the keys that it names; a key may have many rows, or none.
    """

    keys: tuple[str, ...]
    mode: str = "new"
    refreshed: tuple[str, ...] | None = None


class Conflict(Exception):
    """Another writer changed what a change was made from."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, tables: Callable[[str], Keyed | None], bucket_rows: int = 1_000_000) -> None:
        self.spark, self.root, self.tables, self.bucket_rows = spark, root, tables, bucket_rows

    # manifests

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        """Versions that can be read, oldest first."""
        fs, home = self._fs(f"{self.root}/_versions")
        found = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last: {version, tables: {name: runs, oldest first}}."""
        if version is None:
            version = max(self.numbers(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}}
        fs, path = self._fs(f"{self.root}/_versions/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """Make a manifest seen, or False if its number is taken."""
        name = f"{self.root}/_versions/{state['version']:012d}.json"
        fs, hidden = self._fs(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        _, path = self._fs(name)
        try:
            if fs.getUri().getScheme() == "file":  # a rename replaces files there, a link does not
                os.link(hidden.toUri().getPath(), path.toUri().getPath())
                return True
            sc = self.spark.sparkContext
            rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
            none = sc._gateway.new_array(rename, 1)
            none[0] = rename.NONE
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(hidden, path, none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            fs.delete(hidden, False)

    def commit(self, change: Callable[[dict], dict[str, list[dict]]]) -> int:
        """Apply a change to the last version's runs and publish it; where another writer was first, to that one's."""
        while True:
            old = self.state()
            tables = change(old)
            new = {"version": old["version"] + 1, "tables": {**old["tables"], **tables}}
            for runs in new["tables"].values():
                for run in runs:
                    run.setdefault("seq", new["version"])
            if self._publish(new):
                return new["version"]
            for runs in tables.values():
                for run in runs:
                    if run["seq"] == new["version"]:
                        del run["seq"]

    def written(self, version: int, name: str) -> int:
        """How many rows the write that made a version added to a table, as its manifest tells."""
        return sum(run["rows"] for run in self.state(version)["tables"].get(name, []) if run["seq"] == version)

    # runs

    @staticmethod
    def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: int) -> dict:
        keys, run = self.tables(name).keys, uuid.uuid4().hex
        path = f"{self.root}/_runs/{name}/{run}"
        dealt = rows.withColumn("__bucket", self._bucket(keys, buckets))
        if buckets > 1:
            dealt = dealt.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", *keys)
        seen = Observation()
        dealt.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("__bucket").parquet(path)
        return {"run": run, "buckets": buckets, "rows": seen.get.get("rows") or 0, "schema": rows.schema.jsonValue()}

    def _read_run(self, name: str, run: dict) -> DataFrame:
        schema = T.StructType.fromJson(run["schema"]).add("__bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.root}/_runs/{name}/{run['run']}")

    def _stage(self, name: str, rows: DataFrame) -> dict:
        """Rows as a run that no manifest names yet; a large one is dealt into buckets at once."""
        run = self._write(name, rows, 1)
        wanted = self._buckets_for(run["rows"])
        return run if wanted == 1 else self._write(name, self._read_run(name, run).drop("__bucket"), wanted)

    def _buckets_for(self, rows: int) -> int:
        return 1 << max(0, (rows - 1) // self.bucket_rows).bit_length()

    def _union(self, name: str, runs: list[dict], base: DataFrame | None = None, touched: set[int] | None = None) -> DataFrame | None:
        """Rows of runs with the number of their write; of touched buckets only. base: rows older than all runs."""
        out = None if base is None else base.withColumn("__seq", (F.col("seq") - (1 << 40) if "seq" in base.columns else F.lit(-1)).cast("bigint")).drop("seq")
        for run in runs:
            rows = self._read_run(name, run)
            if touched is not None and run["buckets"] > 1:
                mine = sorted({b % run["buckets"] for b in touched})
                rows = rows if len(mine) == run["buckets"] else rows.filter(F.col("__bucket").isin(mine))
            rows = rows.drop("__bucket").withColumn("__seq", F.lit(run["seq"]).cast("bigint"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _merged(self, name: str, rows: DataFrame, inner: bool = False) -> DataFrame:
        """What a reader sees of written rows. inner: keep what later merges need."""
        how = self.tables(name)
        if how.mode == "new":
            return rows.drop("__seq")
        if how.mode == "whole":
            marked = rows if "__row" in rows.columns else rows.withColumn("__row", F.lit(True))
            last = marked.groupBy(*how.keys).agg(F.max("__seq").alias("__seq"))
            kept = marked.join(last, [*how.keys, "__seq"], "left_semi").drop("__seq")
            return kept if inner else kept.filter(F.coalesce("__row", F.lit(True))).drop("__row")
        rest = [c for c in rows.columns if c not in (*how.keys, "__seq")]
        late = rest if how.refreshed is None else [c for c in how.refreshed if c in rest]
        early = [c for c in rest if c not in late]
        parts = ([F.min_by(F.struct(*early), "__seq").alias("first")] if early else []) + ([F.max_by(F.struct(*late), "__seq").alias("last")] if late else [])
        grouped = rows.groupBy(*how.keys).agg(*parts) if parts else rows.select(*how.keys).distinct()
        found = {**{c: F.col(f"first.{c}") for c in early}, **{c: F.col(f"last.{c}") for c in late}}
        return grouped.select(*[found.get(c, F.col(c)).alias(c) for c in rows.columns if c != "__seq"])

    # what users do

    def read(self, name: str, base: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
        """A table as a version has it, by default the last; None if it holds none."""
        rows = self._union(name, self.state(version)["tables"].get(name, []), base)
        return None if rows is None else self._merged(name, rows)

    def lookup(self, name: str, wanted: DataFrame, base: DataFrame | None = None, version: int | None = None, state: dict | None = None) -> DataFrame | None:
        """The table's rows of the keys in ``wanted``: of each run only the buckets that a key falls into are read.

        The driver takes the distinct bucket numbers, as many as the largest run has at most.
        """
        keys, runs = self.tables(name).keys, (state or self.state(version))["tables"].get(name, [])
        shape = base.schema if base is not None else T.StructType.fromJson(runs[-1]["schema"]) if runs else None
        if shape is None:
            return None
        wanted = cut(wanted.select(*[F.col(k).cast(shape[k].dataType).alias(k) for k in keys]).distinct())
        most = max((run["buckets"] for run in runs), default=1)
        touched = {r[0] for r in wanted.select(self._bucket(keys, most)).distinct().collect()} if most > 1 else None
        rows = self._union(name, runs, base, touched)
        return self._merged(name, rows.join(wanted, list(keys), "left_semi"))

    def put(self, writes: dict[str, DataFrame], bases: dict[str, DataFrame | None] | None = None, replaced: DataFrame | None = None) -> int:
        """Write rows to tables, seen all at once. replaced: the keys of ``whole`` tables whose rows the write replaces.

        Without ``replaced`` these are the keys of the rows. Of rows of one write with the same key one is taken, but
        in ``whole`` tables. A write to a ``new`` table whose runs another writer has changed meanwhile is made anew.
        """
        bases = bases or {}

        def prepare(name: str) -> tuple[DataFrame, dict | None]:
            how, rows = self.tables(name), cut(writes[name])
            if how.mode == "new":
                return rows.dropDuplicates(list(how.keys)), None
            if how.mode == "merge":
                return rows, self._stage(name, rows.dropDuplicates(list(how.keys)))
            gone = (rows if replaced is None else replaced).select(*how.keys).distinct().withColumn("__row", F.lit(False))
            return rows, self._stage(name, rows.withColumn("__row", F.lit(True)).unionByName(gone, allowMissingColumns=True))

        def unseen(name: str) -> dict:
            rows, keys = ready[name][0], list(self.tables(name).keys)
            stored = self.lookup(name, rows, bases.get(name), state=seen)
            return self._stage(name, rows if stored is None else rows.join(stored.select(*keys), keys, "left_anti"))

        with ThreadPoolExecutor(8) as pool:  # the tables' jobs share the cluster
            ready = dict(zip(writes, pool.map(prepare, writes)))
        fresh = [name for name in writes if ready[name][1] is None]
        while True:
            seen = self.state()
            with ThreadPoolExecutor(8) as pool:
                made = {name: run for name, (_, run) in ready.items() if run} | dict(zip(fresh, pool.map(unseen, fresh)))

            def change(old: dict) -> dict:
                runs = {name: old["tables"].get(name, []) for name in made}
                if any(runs[name] != seen["tables"].get(name, []) for name in fresh):
                    raise Conflict
                return {name: [*runs[name], made[name]] if made[name]["rows"] or not runs[name] else runs[name] for name in made}

            try:
                version = self.commit(change)
            except Conflict:
                continue
            break
        for name in writes:
            self.compact(name)
        return version

    @staticmethod
    def _gathered(runs: list[dict]) -> list[dict]:
        total, first = 0, len(runs)
        while first > 0 and (total == 0 or runs[first - 1]["rows"] <= LARGER * total):
            first -= 1
            total += runs[first]["rows"]
        return runs[first:] if len(runs) - first >= FEW else []

    def compact(self, name: str, all_runs: bool = False) -> None:
        """Merge the last runs of like size into one, or all of them; so a table of n writes has about log n runs.

        A row is rewritten about log n times. What another writer adds meanwhile stays; where one has merged, nothing is done.
        """
        runs = self.state()["tables"].get(name, [])
        old = runs if all_runs else self._gathered(runs)
        if len(old) < 2 and not all_runs or not old:
            return
        merged = self._merged(name, self._union(name, old), inner=True)
        run = self._write(name, merged, self._buckets_for(sum(r["rows"] for r in old))) | {"seq": old[-1]["seq"]}

        def change(now: dict) -> dict:
            there, gone = now["tables"].get(name, []), [r["run"] for r in old]
            at = next((i for i, r in enumerate(there) if r["run"] == gone[0]), None)
            if at is None or [r["run"] for r in there[at : at + len(gone)]] != gone:
                raise Conflict
            return {name: [*there[:at], run, *there[at + len(gone) :]]}

        try:
            self.commit(change)
        except Conflict:
            return

    def vacuum(self, keep: int = 10, unseen_seconds: int = 86_400) -> None:
        """Delete all but the last ``keep`` versions, and runs that none of these names and that are older than a write may last."""
        numbers = self.numbers()
        named = {run["run"] for n in numbers[-keep:] for runs in self.state(n)["tables"].values() for run in runs}
        for n in numbers[:-keep]:
            fs, path = self._fs(f"{self.root}/_versions/{n:012d}.json")
            fs.delete(path, False)
        fs, home = self._fs(f"{self.root}/_runs")
        for table in fs.listStatus(home) if fs.exists(home) else []:
            for folder in fs.listStatus(table.getPath()):
                if folder.getPath().getName() not in named and folder.getModificationTime() / 1000 <= time.time() - unseen_seconds:
                    fs.delete(folder.getPath(), True)
