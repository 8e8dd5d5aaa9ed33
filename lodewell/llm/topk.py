"""Exact top-k by inner product with a pivot table.

Components are turned into integers, floor(scale * x). The pivot table is written first: every vector with its distances
to PIVOTS pivots. By the triangle inequality the largest difference of two vectors' pivot distances bounds their
distance from below, and with the norms bounds their inner product from above.

Candidates are packed by nearest pivot, in the order of the distance to it, so that the vectors of a blob have like
distances; a blob keeps the least and the largest distance to each pivot and the largest norm, which bound the inner
product of a query with all its vectors. Queries are blocked in the same way. Each query block first takes the SEEDS
blobs of the highest bounds, which gives every query k scores to beat. Of all other blobs only those go to a block whose
bound for one of its queries reaches that query's k-th score; the rest is eliminated by the table, before any shuffle of
vectors. The blobs that are left come in the order of their bounds; within a blob a query takes the candidates in the
order of theirs and stops when the next is under its k-th score so far. Ties stay in, so the result is exact.

A task has one (query block, part of its blobs) at a time and holds one blob of BLOB vectors; neither side is gathered.

Defined results: a vector that is null or holds a null or non-finite component takes no part; only vectors of the
query's own length are candidates; ties go to the smaller id; rows that repeat an id are separate candidates, a
query skips every row of its own id, and a query id that repeats is asked once, with its smallest vector; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.llm.common import materialize

K, SCALE, PIVOTS = 10, 1024, 24
#: Vectors of a candidate blob and of a query block; candidates scored at once; blobs that seed a query block; blobs of a
#: task's part and of a chunk of bounds.
BLOB, QUERY_BLOCK, STEP, SEEDS, PART, CHUNK = 2048, 1024, 256, 4, 16, 1024


def valid_rows(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and the integer components of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda v: F.floor(v * scale)).alias("v"))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places in the batch, vectors) of each dimension of a batch of vec_id, dim, v."""
    dims, flat = batch.column(1).to_numpy(False), batch.column(2).flatten().to_numpy(False).astype(np.int64)
    ends = np.cumsum(dims)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)


_TABLE = "vec_id bigint, dim int, v binary, norm double, cell int, ring double, to_pivots binary"


def _distances(pivots: dict[int, np.ndarray]):
    """The pivot table's rows: norm, nearest pivot, distance to it, and the distances to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in _vectors(batch):
                f, p = v.astype(np.float64), pivots.get(dim)
                if p is None:  # no query has this length
                    continue
                norm = np.einsum("ij,ij->i", f, f)
                far = np.sqrt(np.maximum(norm[:, None] - 2 * f @ p.T + np.einsum("ij,ij->i", p, p)[None, :], 0))
                cell = far.argmin(axis=1)
                ids = batch.column(0).take(pa.array(at))
                columns = [ids, pa.array(np.full(len(at), dim, np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(norm), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(at)), cell]), pa.array([x.tobytes() for x in far], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _TABLE.replace(",", "").split()[::2])

    return run


_BLOBS = "dim int, blob bigint, n int, ids binary, vs binary, norms binary, to_pivots binary, lo binary, hi binary, most double"


def _pack(size: int, by_cell: bool):
    """Rows sorted by (dim, cell, ring) as blobs of at most ``size`` vectors, of one cell if asked for."""

    def give(rows: list[tuple]) -> pa.RecordBatch:
        ids, _, vs, norms, _, _, far = zip(*rows)
        table = np.frombuffer(b"".join(far), np.float64).reshape(len(rows), -1)
        row = (rows[0][1], int.from_bytes(os.urandom(8), "little", signed=True), len(rows), np.array(ids, np.int64).tobytes(), b"".join(vs), np.array(norms).tobytes(), table.tobytes(), table.min(axis=0).tobytes(), table.max(axis=0).tobytes(), max(norms))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], _BLOBS.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= size or row[1] != held[0][1] or by_cell and row[4] != held[0][4]):
                    yield give(held)
                    held = []
                held.append(row)
        if held:
            yield give(held)

    return run


class Block:
    """Vectors with norms and pivot distances, as the pivot table has them."""

    def __init__(self, n: int, ids: bytes, vs: bytes, norms: bytes, to_pivots: bytes) -> None:
        self.ids, self.norm = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self.v, self.to_pivots = np.frombuffer(vs, np.int64).reshape(n, -1), np.frombuffer(to_pivots, np.float64).reshape(n, -1)
        self.big = float(np.abs(self.v).max(initial=0)) ** 2 * max(self.v.shape[1], 1) >= 2**52
        self.f = self.v.astype(np.float64)

    def scores(self, q: int, of: "Block", at: np.ndarray) -> np.ndarray:
        if self.big or of.big:  # beyond what doubles hold exactly
            return of.v[at] @ self.v[q]
        return (of.f[at] @ self.f[q]).astype(np.int64)


def bound(whole, gap):
    """The largest inner product of two vectors whose squared norms add up to ``whole`` and that lie ``gap`` apart at least."""
    # rounding of the distances is far below the slack
    return (whole - gap * gap) / 2 + 1 + 1e-6 * (whole + 1)


def blob_bounds(norm: np.ndarray, to_pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(queries, blobs): what no inner product of a query with a vector of a blob exceeds."""
    out = np.empty((len(norm), len(most)))
    for i in range(len(norm)):
        gap = np.maximum(np.maximum(lo - to_pivots[i], to_pivots[i] - hi), 0).max(axis=1, initial=0)
        out[i] = bound(norm[i] + most, gap)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


_NONE = np.iinfo(np.int64).min


def search_block(queries: Block, cands: Block, best: list, least: np.ndarray, k: int) -> int:
    """Fold a block of candidates into the k best of each query; returns how many scores were computed.

    least: a score that the k-th best of each query is known to reach.
    """
    seen = 0
    for q in range(len(queries.ids)):
        ids, scores = best[q]
        floor = max(int(scores[k - 1]) if len(ids) >= k else _NONE, int(least[q]))
        gap = np.abs(cands.to_pivots - queries.to_pivots[q]).max(axis=1, initial=0)
        most = bound(queries.norm[q] + cands.norm, gap)
        left = np.flatnonzero(most >= floor)
        left = left[np.argsort(-most[left], kind="stable")]
        for a in range(0, len(left), STEP):
            if most[left[a]] < floor:
                break
            at = left[a : a + STEP]
            at = at[cands.ids[at] != queries.ids[q]]
            new = queries.scores(q, cands, at)
            seen += len(at)
            good = new >= floor
            at, new = at[good], new[good]
            if len(at):
                ids, scores = _best(np.concatenate([ids, cands.ids[at]]), np.concatenate([scores, new]), k)
                floor = max(floor, int(scores[k - 1]) if len(ids) >= k else _NONE)
        best[q] = (ids, scores)
    return seen


def _floats(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _mean_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, blob, mean bound) for each query block and each blob of a chunk."""
    for batch in batches:
        for q, n, norms, far, blobs in zip(*(c.to_pylist() for c in batch.columns)):
            got = blob_bounds(np.frombuffer(norms, np.float64), np.frombuffer(far, np.float64).reshape(n, -1), _floats([b["lo"] for b in blobs]), _floats([b["hi"] for b in blobs]), np.array([b["most"] for b in blobs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), q)), pa.array([b["blob"] for b in blobs], pa.int64()), pa.array(got.mean(axis=0))], ["q", "blob", "bound"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, blob, bound) where some query's bound reaches its k-th score so far; bound is the largest of those."""
    for batch in batches:
        for q, n, norms, far, least, blobs in zip(*(c.to_pylist() for c in batch.columns)):
            got = blob_bounds(np.frombuffer(norms, np.float64), np.frombuffer(far, np.float64).reshape(n, -1), _floats([b["lo"] for b in blobs]), _floats([b["hi"] for b in blobs]), np.array([b["most"] for b in blobs]))
            fits = got >= np.frombuffer(least, np.int64)[:, None]
            at = np.flatnonzero(fits.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array([blobs[i]["blob"] for i in at], pa.int64()), pa.array(np.where(fits, got, -np.inf)[:, at].max(axis=0, initial=-np.inf))], ["q", "blob", "bound"])


_FOUND = "q bigint, place int, query_id bigint, vec_id bigint, score bigint, seen bigint"
_EMPTY = np.zeros(0, np.int64)


def _search(k: int):
    """Rows sorted by (q, part) and falling bounds: the k best of each query of a block over a part of its blobs.

    A row without vec_id has in ``seen`` how many scores were computed for the block.
    """

    def give(q: int, queries: Block, best: list, seen: int) -> pa.RecordBatch:
        n = [len(b[0]) for b in best]
        place = np.repeat(np.arange(len(n), dtype=np.int32), n)
        ids, scores = (np.concatenate([_EMPTY, *(b[i] for b in best)]) for i in range(2))
        columns = [pa.array([q] * (len(place) + 1), pa.int64()), pa.array([*place.tolist(), None], pa.int32()), pa.array([*queries.ids[place].tolist(), None], pa.int64()), pa.array([*ids.tolist(), None], pa.int64()), pa.array([*scores.tolist(), None], pa.int64()), pa.array([0] * len(place) + [seen], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, _FOUND.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best, seen = None, None, [], 0
        for batch in batches:
            for q, part, least, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if (q, part) != key:
                    if key is not None:
                        yield give(key[0], queries, best, seen)
                    key, queries, seen = (q, part), Block(*columns[:5]), 0
                    best, floor = [(_EMPTY, _EMPTY)] * len(queries.ids), np.frombuffer(least, np.int64) if least else np.full(len(queries.ids), _NONE)
                seen += search_block(queries, Block(*columns[5:]), best, floor, k)
        if key is not None:
            yield give(key[0], queries, best, seen)

    return run


_VECTORS = ("n", "ids", "vs", "norms", "to_pivots")


def _met(pairs: DataFrame, asked: DataFrame, blobs: DataFrame, k: int) -> DataFrame:
    """What the pairs (q, part, blob, bound) of query blocks and blobs give; asked also has the scores to reach."""
    given = pairs.join(blobs.select("blob", *[F.col(c).alias(f"c_{c}") for c in _VECTORS]), "blob")
    both = given.join(asked.select("q", "least", *_VECTORS), "q")
    rows = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q", "part").sortWithinPartitions("q", "part", F.desc("bound"))
    return rows.select("q", "part", "least", *_VECTORS, *[f"c_{c}" for c in _VECTORS]).mapInArrow(_search(k), _FOUND)


def _floors(k: int):
    """The k-th score so far of each query of a block, as one array in the block's order."""

    def run(t: pa.Table) -> pa.Table:
        least = np.full(t.column("n")[0].as_py(), _NONE, np.int64)
        rows = t.filter(t.column("place").is_valid())
        place, score = rows.column("place").to_numpy(), rows.column("score").to_numpy()
        order = np.lexsort((-score, place))
        place, score = place[order], score[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        least[place[nth == k - 1]] = score[nth == k - 1]
        return pa.table({"q": t.column("q")[:1], "least": pa.array([least.tobytes()], pa.binary())})

    return run


def search(queries: DataFrame, cands: DataFrame, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, vec_id, score of candidates among which each query's k best are, and rows of counts (vec_id is null, seen is set)."""
    spark = cands.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    pivots = {}
    for r in queries.select("dim").distinct().collect():  # one small table a dimension, whatever the number of vectors
        rows = cands.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").select("v").limit(n_pivots).collect()
        if rows:
            pivots[r["dim"]] = np.array([x["v"] for x in rows], np.float64).reshape(len(rows), r["dim"])
    table = materialize(cands.select("vec_id", "dim", "v").mapInArrow(_distances(pivots), _TABLE), "pivot-table")
    order = ("dim", "cell", "ring", "vec_id")
    # a cell may hold any share of the vectors, so it is dealt over several tasks
    dealt = table.repartition(parts, "dim", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    blobs = materialize(dealt.sortWithinPartitions(*order).mapInArrow(_pack(BLOB, True), _BLOBS), "blobs")
    wanted = materialize(queries.mapInArrow(_distances(pivots), _TABLE), "query-table")
    ranged = wanted.repartitionByRange(-(-max(wanted.count(), 1) // QUERY_BLOCK), *order).sortWithinPartitions(*order)
    asked = materialize(ranged.mapInArrow(_pack(QUERY_BLOCK, False), _BLOBS), "query-blocks").withColumnRenamed("blob", "q")
    chunks = -(-blobs.count() // CHUNK)
    if not chunks or asked.isEmpty():
        return spark.createDataFrame([], _FOUND).select("query_id", "vec_id", "score", "seen")
    chunk = F.pmod(F.col("blob"), F.lit(chunks))
    outlines = materialize(blobs.groupBy("dim", chunk.alias("chunk")).agg(F.collect_list(F.struct("blob", "lo", "hi", "most")).alias("blobs")), "outlines")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk")
    met = asked.select("dim", "q", "n", "norms", "to_pivots", every).join(outlines, ["dim", "chunk"]).select("q", "n", "norms", "to_pivots", "blobs").mapInArrow(_mean_bounds, "q bigint, blob bigint, bound double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "blob"))
    seeds = materialize(met.withColumn("place", place).filter(F.col("place") <= SEEDS).select("q", F.lit(0).cast("bigint").alias("part"), "blob", "bound"), "seeds")
    first = materialize(_met(seeds, asked.withColumn("least", F.lit(None).cast("binary")), blobs, k), "first-found")
    least = materialize(first.join(asked.select("q", "n"), "q").groupBy("q").applyInArrow(_floors(k), "q bigint, least binary"), "floors")
    asked = asked.join(least, "q")
    open_ = asked.select("dim", "q", "n", "norms", "to_pivots", "least", every).join(outlines, ["dim", "chunk"]).select("q", "n", "norms", "to_pivots", "least", "blobs").mapInArrow(_open_pairs, "q bigint, blob bigint, bound double")
    open_ = open_.join(seeds.select("q", "blob"), ["q", "blob"], "left_anti")
    open_ = materialize(open_, "open-pairs")
    n = open_.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = open_.join(n, "q").select("q", F.pmod(F.xxhash64("blob"), F.col("parts")).alias("part"), "blob", "bound")
    more = _met(dealt, asked, blobs, k)
    return first.unionByName(more).select("query_id", "vec_id", "score", "seen")


def top_k(queries: DataFrame, cands: DataFrame, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the highest inner product; both come from valid_rows."""
    found = search(queries, cands, k, n_pivots).filter("vec_id IS NOT NULL").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
