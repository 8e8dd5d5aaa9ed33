"""Folds in parts equal folds row by row, for every entry of a part and for keys that span parts."""

import random

import pytest
from pyspark.sql import functions as F

from lodewell.operators import chain, folds, provenance


def leaves(fold, values, entry):
    for v in values:
        _, entry = fold.answer(entry, v)
    return entry


def numbers(draw, kind, n):
    at = draw.choice([0, 5, folds.HALF, folds.WRAP - 20])
    out = []
    for i in range(n):
        jump = {"near": draw.choice([1, 1, 2, 0, -1, -3]), "far": draw.choice([1, folds.HALF - 1, folds.HALF, folds.HALF + 1, -5, 1 << 30]), "down": -1}[kind]
        at = (at + jump) % folds.WRAP
        out.append(at)
    return out


@pytest.mark.parametrize("kind", ["near", "far", "down"])
def test_a_part_tells_its_exit_for_every_entry(kind):
    draw, fold = random.Random(kind), folds.numbered()
    for _ in range(300):
        values = numbers(draw, kind, draw.randint(0, 12))
        seen = fold.summary()
        for v in values:
            seen.add(v)
        edges = {(v + d + e) % folds.WRAP for v in values or [0] for d in (0, folds.HALF) for e in (-2, -1, 0, 1, 2)}
        for entry in edges | {draw.randrange(folds.WRAP) for _ in range(5)}:
            assert fold.exit(seen.told(), entry) == leaves(fold, values, entry)


def test_too_many_pieces_are_not_told():
    seen = folds.numbered().summary()
    for v in range(1000, 1000 - folds.PIECES - 10, -1):
        seen.add(v)
    assert seen.told() is None
    seen = folds.spaced(10**6).summary()
    for v in range(folds.PIECES + 10):
        seen.add(v)
    assert seen.told() is None


@pytest.mark.parametrize("ttl", [1, 7, 30, 1000])
def test_spaced_parts_tell_their_exits(ttl):
    draw, fold = random.Random(ttl), folds.spaced(ttl)
    for _ in range(300):
        values, at = [], 100
        for _ in range(draw.randint(1, 40)):
            at += draw.choice([0, 1, 2, 3, ttl // 2, ttl]) if draw.random() < 0.7 else 0
            values.append(at)
        seen = fold.summary()
        for v in values:
            seen.add(v)
        for entry in range(max(0, 100 - ttl - 2), 101):
            assert fold.exit(seen.told(), entry) == leaves(fold, values, entry)


def rows_of(draw):
    """A key with most rows, keys that end within a part, one of a single row, one that is null."""
    keys = ["hot"] * 600 + ["a"] * 30 + ["b"] * 40 + [None] * 25 + ["one"]
    seqs = {k: numbers(draw, "near", 600) for k in {*keys}}
    return [(k, i, (None if draw.random() < 0.02 else draw.randrange(2000)), seqs[k][i % 600]) for i, k in enumerate(keys)]


@pytest.mark.parametrize("pieces", [256, 0])
def test_keys_over_many_parts(spark, monkeypatch, pieces):
    """pieces 0: no part tells anything, so each is read again with its entry."""
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame(rows, "k string, i bigint, t bigint, s bigint").repartition(3)
    if pieces == 0:
        rows = [r for r in rows if r[0] != "hot" or r[1] < 200]
        df = df.filter("k IS NULL OR k <> 'hot' OR i < 200")
        monkeypatch.setattr(folds._Numbered, "told", lambda self: None)
        monkeypatch.setattr(folds._Spaced, "told", lambda self: None)
    want_state, want_fresh = {}, set()
    for key in {r[0] for r in rows}:
        state = None
        for _, i, _, s in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            want_state[i], state = folds.numbered().answer(state, s)
        state = None
        for _, i, t, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            (fresh,), state = folds.spaced(40).answer(state, t)
            want_fresh |= {i} if fresh else set()
    for per_task, parts in ((10**6, None), (10, 6)):
        if pieces == 0 and parts is None:
            continue
        got = chain.sequence_states(df, "k", "i", "s", per_task, parts).collect()
        assert {r["i"]: (r["state"], r["missed"]) for r in got} == want_state and len(got) == len(rows)
        got = [r["i"] for r in provenance.dedup_ttl(df, ["k"], F.col("t"), "i", 40, per_task, parts).collect()]
        assert sorted(got) == sorted(want_fresh)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, i bigint, t bigint, s bigint")
    assert chain.sequence_states(df, "k", "i", "s").collect() == [] and provenance.dedup_ttl(df, ["k"], F.col("t"), "i", 5).collect() == []
