"""What the text operators share: the written-table helper, Arrow batch limits and hashing of words.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor and the driver can
read, so a lost executor costs a task retry and never a result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII bytes, which is what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: list[str] = []


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


def materialize(df: DataFrame, tag: str, bucket_by: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and return a reader of it: lineage ends here.

    With bucket_by it is a table of the session, in as many buckets as there are shuffle partitions.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/lodewell-{spark.sparkContext.applicationId}"
    name = uuid.uuid4().hex
    path = f"{home}/{tag}-{name}"
    _forget(spark, home)
    if bucket_by:
        table = f"lodewell_{tag.replace('-', '_')}_{name}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(n, bucket_by).option("path", path).saveAsTable(table)
        return spark.table(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_REGISTERED: set[str] = set()


def _forget(spark: SparkSession, home: str) -> None:
    if home in _REGISTERED:
        return
    _REGISTERED.add(home)

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(home)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has gone already; the folder is the cluster's to clear
            pass

    atexit.register(drop)


#: Rows that one task takes in any case; below, no key is looked at for heat.
COOL = 10_000


def many_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many.join(one, key, how), where a key may hold a large share of the rows of many and has one row at most in one.

    A key of more than 1 / (4 * partitions) of the rows is hot: there are fewer than 4 * partitions of those, whatever
    the tables' sizes, so their rows of one are broadcast and their rows of many stay where they are. The rest is joined
    by shuffles. many is read twice and should be a written table.
    """
    parts, rows = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), many.count()
    if rows <= COOL:
        return many.join(one, key, how)
    n = "__lodewell_n"
    hot = materialize(many.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > rows // (4 * parts)).select(key), "hot-keys")
    if hot.isEmpty():
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    here = many.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how)
    return here.unionByName(many.join(hot, key, "left_anti").join(one, key, how))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, as a few rows may hold very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def texts(column) -> list[bytes]:
    """A string column of a batch as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random value for each byte and the powers of an odd base, for the polynomial word hash.
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of a byte array, and where each word starts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    lengths = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    offset = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = _TABLE[_LOWER[data[at]]] * _powers(int(lengths.max()))[offset]
    return mix64(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)), starts
