"""Written tables that end a plan's lineage: what is read of them is columns, and a lost executor costs a task's retry."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: list[str] = []
_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lodewell-"))
    return f"file://{_LOCAL[0]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet under the shared folder and read again; the files go when the driver exits."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/lodewell-cut-{spark.sparkContext.applicationId}"
    if home not in _KNOWN:
        _KNOWN.add(home)
        atexit.register(_drop, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` with aggregates that are gathered while the rows are written; those of no rows are 0."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, {name: int(seen.get.get(name) or 0) for name in counts}


def _drop(spark: SparkSession, home: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone already; the folder is the cluster's to clear
        pass
