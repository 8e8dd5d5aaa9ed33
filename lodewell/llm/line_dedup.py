"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order, give keep bitmaps.

Only hashes and positions travel to find the lines, never text; apply_bitmaps, which gives the kept text, is a join of
the documents with the bitmaps and shuffles each text once. Rows are range-partitioned by (hash, document), so that a line held by a
third of all documents is spread over many tasks; each task streams its sorted rows once. A hash that lies wholly
inside one task is decided there. The first and the last hash of a task may go on in its neighbours: the task writes a
count for those (two rows a task at most) and leaves their rows pending until the counts are added up.

Defined results: a null or empty text is one empty line; a null doc_id is one document, smaller than any other; rows
that repeat a doc_id count as one document, and each gets the bitmap of its own text; an empty table gives no rows;
further columns, whatever their names, pass through apply_bitmaps untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewell.llm.common import materialize, texts

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"

_LINES = "key binary, doc_id bigint, text_hash bigint, n_lines int, positions array<int>"
_STREAM = f"kind int, n_docs bigint, {_LINES}"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a key of fewer code points."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                lines, at = text.split(b"\n"), {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)):
                        at.setdefault(key, []).append(i)
                for key, positions in at.items():
                    for column, value in zip(out, (key, doc, h, len(lines), positions)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int32()))],
                names=["key", "doc_id", "text_hash", "n_lines", "positions"],
            )

    return rows


DROP, PENDING, COUNT = 0, 1, 2
_FLUSH = 2_000
#: Rows of a key that wait in a task for it to have min_docs documents; more (of rows that repeat an id, or have none) are decided afterwards.
HELD = 1_000
#: Counts of keys up to which they are broadcast to the rows that wait for them.
BROADCAST = 100_000


class _Out:
    """Rows of the stream, given out in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "n_docs", "key", "doc_id", "text_hash", "n_lines", "positions"])


def _stream(min_docs: int):
    """Rows come sorted by key, then doc_id from the largest; at most HELD rows of a key's first documents are held.

    Rows beyond are given out as pending with a count of their key, as those are whose key goes on in another task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, doc, n_docs, largest, edge, over, held = _Out(), None, None, 0, None, True, False, []

        def hold(row):
            nonlocal held, over
            held.append(row)
            if len(held) >= HELD or over:
                out.rows.extend((PENDING, None, *x) for x in held)
                held, over = [], True

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != key:
                    if key is not None and (edge or over):
                        out.rows.append((COUNT, n_docs, key, largest, None, None, None))
                    edge, over, key, doc, n_docs, largest, held = key is None, False, row[0], row[1], 1, row[1], []
                elif row[1] != doc:
                    doc, n_docs = row[1], n_docs + 1
                if edge:
                    out.rows.append((PENDING, None, *row))
                elif doc == largest:
                    # kept if the key ends here; at the task's last key it waits for the neighbour
                    if n_docs < min_docs:
                        hold(row)
                elif n_docs >= min_docs:
                    out.rows += [(DROP, None, *x) for x in held if x[1] != largest]
                    held = []
                    out.rows.append((DROP, None, *row))
                else:
                    hold(row)
                if len(out.rows) >= _FLUSH:
                    yield out.batch()
        if key is not None:
            out.rows.append((COUNT, n_docs, key, largest, None, None, None))
            out.rows += [(PENDING, None, *x) for x in held if n_docs < min_docs]
        yield out.batch()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[positions] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep_bitmap) of each document that loses a line; the rest keep all.

    keep_bitmap is zlib over the big-endian packed bits, one for each line, 1 for kept.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    lines = materialize(base.mapInArrow(_line_rows(min_chars), _LINES), "line-keys")
    order = (F.col("key"), F.col("doc_id").desc_nulls_last())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = materialize(
        lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text_hash").mapInArrow(_stream(min_docs), _STREAM), "line-stream"
    )
    row = ("doc_id", "text_hash", "n_lines", "positions")
    # two rows a task at most, and one for each key with over HELD rows of few documents
    edges = materialize(streamed.filter(F.col("kind") == COUNT).groupBy("key").agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("largest")), "line-edges")
    late = (
        streamed.filter(F.col("kind") == PENDING)
        .join(F.broadcast(edges) if edges.count() <= BROADCAST else edges, "key")
        .filter((F.col("total") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest")))
    )
    drops = streamed.filter(F.col("kind") == DROP).select(*row).unionByName(late.select(*row))
    per_doc = drops.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))
    return per_doc.mapInArrow(_pack, "doc_id bigint, text_hash bigint, n_lines int, n_dropped int, keep_bitmap binary")


def _keep(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    kept, n_lines, n_dropped = [], [], []
    for raw, packed in zip(texts(text), bitmap.to_pylist()):
        lines = raw.split(b"\n")
        n = len(lines)
        if packed is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
            lines = [lines[i] for i in np.flatnonzero(bits)]
            raw = b"\n".join(lines)
        kept.append(raw)
        n_lines.append(n)
        n_dropped.append(n - len(lines))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"]
    )


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
#: Column names that the operator adds while it works; no input column may be called so.
_D, _H, _B = "__lodewell_doc", "__lodewell_hash", "__lodewell_bitmap"


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, into: str) -> DataFrame:
    """docs with a struct column ``into`` of the kept text, n_lines and n_dropped. The bitmaps are the hashed side."""
    small = bitmaps.select(F.col("doc_id").alias(_D), F.col("text_hash").alias(_H), F.col("keep_bitmap").alias(_B)).hint("shuffle_hash")
    keyed = docs.join(small, F.col("doc_id").cast("bigint").eqNullSafe(F.col(_D)) & (F.xxhash64("text") == F.col(_H)), "left")
    keep = F.arrow_udf(_keep, _KEPT)
    return keyed.withColumn(into, keep("text", _B)).drop(_D, _H, _B)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text reduced to its kept lines, and n_chars, where there is one, counted anew."""
    kept = "__lodewell_kept"
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), kept)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(f"{kept}.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{kept}.n_dropped") > 0, F.char_length(F.col(f"{kept}.text")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).drop(kept)
