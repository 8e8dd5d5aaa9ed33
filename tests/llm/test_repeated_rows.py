"""Rows that repeat an id or have none, and columns of types that have no order."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewell.llm import line_dedup, minhash, mixing
from lodewell.llm.common import bounded_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, extra map<string,int>, inner struct<a: map<string,int>>, raw binary"


@pytest.fixture(autouse=True)
def batches(spark):
    bounded_batches(spark)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, {"k": 1}, ({"a": 1},), bytearray(b"x")) for d, t, s in rows], SCHEMA)


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_mixed_one_by_one(spark, doc_id):
    rows = [(doc_id, f"two words{i}", "a") for i in range(40)]
    df = frame(spark, rows)
    plan = mixing.mix_plan(df)
    taken = plan.agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(df)
    used = sum(len(r["text"].split()) for r in out.collect())
    assert out.columns == df.columns and abs(used - taken) <= 2
    assert max(Counter(r["text"] for r in out.collect()).values()) <= 2


def test_mixing_repeated_and_single_rows(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(60)] + [(3, "w w w", "b")] * 4 + [(None, "null id", None), (None, "null id", None)]
    df = frame(spark, rows)
    uses = mixing.occurrences(mixing.mix_plan(df)).count()
    assert mixing.mixed_documents(df).count() == uses > 60


def test_near_duplicates_with_columns_that_have_no_order(spark):
    rows = [(1, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (2, "a b c d e f g h", "s"), (3, "x y z u v w", "s"), (None, "n n n", "s"), (None, "n n n", "s")]
    df = frame(spark, rows)
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None", "None"]


def plain_lines(rows, least=5):
    keys = {}
    for i, (d, t, _) in enumerate(rows):
        for line in t.split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
            if len(k) >= 40:
                keys.setdefault(k, set()).add(d)
    common = {k: max((d for d in ids if d is not None), default=None) for k, ids in keys.items() if len(ids) >= least}
    out = []
    for d, t, _ in rows:
        out.append((d, "\n".join(line for line in t.split("\n") if line.lower().strip() not in common or common[line.lower().strip()] == d)))
    return Counter(out)


@pytest.mark.parametrize("ids", [[7], [None], [7, 8, 9, None], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, None]])
def test_a_line_in_thousands_of_rows_of_few_documents(spark, monkeypatch, ids):
    """Rows of few documents with one line: no more than HELD of them wait in a task, whatever comes of the line."""
    monkeypatch.setattr(line_dedup, "HELD", 20)
    line = "a line that is long enough to be counted as one"
    rows = [(ids[i % len(ids)], f"{line}\nown {i}", "s") for i in range(900)] + [(i, f"other {i}\n{'z' * 50}", "s") for i in range(100, 104)]
    df = frame(spark, rows)
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == plain_lines(rows)


def test_few_rows_are_held(monkeypatch):
    """100 000 rows of one id and one key, in batches: they go out as they come."""
    n = 100_000
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
    columns = [pa.array(c, k) for c, k in zip([[b"k"] * n, [7] * n, list(range(n)), [1] * n, [[0]] * n], kinds, strict=True)]
    before = pa.RecordBatch.from_arrays([c[:1] if i else pa.array([b"a"], pa.binary()) for i, c in enumerate(columns)], names=list("abcde"))
    whole = pa.RecordBatch.from_arrays(columns, names=list("abcde"))
    given = [b.num_rows for b in line_dedup._stream(5)(iter([before, *[whole.slice(i, 1000) for i in range(0, n, 1000)]]))]
    assert max(given) <= line_dedup._FLUSH + line_dedup.HELD and sum(given) == n + 3
