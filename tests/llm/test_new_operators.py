"""Prefix trie, source divergence and exact dedup against plain recounts, on awkward rows and on hot keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodewell.llm import divergence, exact_dedup, prefix_trie
from lodewell.llm.common import bounded_batches

EMPTY = hashlib.sha256().hexdigest()


@pytest.fixture(autouse=True)
def batches(spark):
    bounded_batches(spark)


# -- prefix trie ------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, node string, part int, len map<string,int>"


def conversations(spark, rows):
    """With columns of names that the operator uses inside, one of them a map."""
    return spark.createDataFrame([(*r, "x", 1, {"a": 1}) for r in rows], TURNS)


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    paths = {}
    for c, turns in own.items():
        turns.sort()
        h = zlib.crc32(str(c).encode()) % 4
        of = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = [x[3:] for x in sorted(own.get(of, []))[:h] + turns[h:]]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(paths[c]) == len(p)))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    return sorted(map(tuple, prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=str)


def test_trie_equals_a_plain_recount(spark):
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 65), 400, 2**40, -7, -20]:
        for turn in range(draw.randint(1, 5)):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a b", "c", "d  e f"])))
    rows += [(61, None, "user", "a b"), (61, None, None, None), (62, 0, "user", "c"), (62, 0, "user", "c"), (None, 0, "user", "lost"), (63, 9, "user", "wortä " * 50_000)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_many_equal_ones(spark):
    """One conversation with most of the rows lies in several tasks; a third of all conversations are the same."""
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(44, t, "user", f"turn {t % 7}") for t in range(380)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie._spans(prefix_trie._ordered(conversations(spark, rows))).filter("conv_id = 40").count() > 1
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "user", "hello") for c in range(20, 40)] + [(20, 1, "user", "more")]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its family's first is absent, its only turn is replaced
    assert trie(spark, [(lone, 0, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


# -- source divergence ------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, term string, n int, value map<string,int>"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, "x", 1, {"a": 1}) for d, t, lang, s in rows], DOCS)


def plain_audit(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, v=v, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out, key=str)


def audited(spark, rows, **more):
    return sorted(map(tuple, divergence.audit(documents(spark, rows), **more).collect()), key=str)


def some_texts(seed, n):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "ü", "Y")] + ["日本", "rare"]
    return [(i, " ".join(draw.choices(words, k=draw.randint(0, 30))) + draw.choice(["", "_", "1"]), draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None, "Z", "é"])) for i in range(n)]


def test_audit_equals_a_plain_recount(spark):
    rows = some_texts(5, 400)
    rows += [(900, None, "xx", "a"), (901, "", "xx", None), (902, "!!! 123", "xx", "b"), (903, "few", "fr", "a"), (903, "few", "fr", "a"), (904, "WORD " * 300_000, "en", "a"), (None, "ax ax", "en", "only")]
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, rows, min_docs=60, top=2) == plain_audit(rows, 60, 2)


def test_audit_of_a_hot_source_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "LISTED", 10)
    rows = [(d, t, "en", "hot" if d % 3 else s) for d, t, _, s in some_texts(6, 300)]
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, []) == []


def test_shares_of_counts_beyond_long_products(spark):
    n = 5 * 10**14
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(3 * n).cast("long"), F.lit(10**6).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (3 * n + 2 * 10**6)


# -- exact dedup ------------------------------------------------------------------------------------------------------

TEXTS = "doc_id bigint, text string, last map<string,int>, group_size string, kept int, __x binary"


def texts(spark, rows):
    return spark.createDataFrame([(d, t, {"a": 1}, "x", 1, bytearray(b"y")) for d, t in rows], TEXTS)


def plain_duplicates(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out, left = [], Counter()
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        left[t or "", d] += 1
        out.append((d, keep, len(ids), d == keep and left[t or "", d] == 1, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "x" * 700_000
ROWS = [
    (1, "same"), (2, "same"), (2, "same"), (7, "same"), (7, "same"), (3, "Same"), (4, None), (5, ""), (None, ""), (6, " "), (None, "null id"), (None, "null id"), (8, LONG), (9, LONG), (10, LONG[:-1] + "y"),
    (11, "a" * 300 + "b"), (12, "a" * 300 + "c"), (13, "a" * 300 + "b"), (14, "é"), (15, "é"), (16, "alone in its length"),
]


@pytest.mark.parametrize("digests", [True, False])
def test_duplicates_equal_a_plain_recount(spark, digests):
    got = sorted(map(tuple, exact_dedup.duplicates(texts(spark, ROWS), digests).collect()), key=str)
    want = plain_duplicates(ROWS)
    if digests:
        assert got == want
    else:
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert {r[0] for r in got if r[4] is None} >= {16} and all(r[4] for r in got if r[2] > 1)  # whole texts of survivors alone are read


def test_dropping_duplicates_keeps_all_columns(spark):
    out = exact_dedup.drop_duplicates(texts(spark, ROWS))
    assert out.columns == texts(spark, []).columns
    want = sorted(((r[0], r[4]) for r in plain_duplicates(ROWS) if r[3]), key=str)
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=str) == want


def test_a_group_of_most_rows_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr("lodewell.llm.common.COOL", 10)
    rows = [(i % 500, "one of many") for i in range(4000)] + [(i, f"text {i}") for i in range(5000, 5400)]
    assert sorted(map(tuple, exact_dedup.duplicates(texts(spark, rows), True).collect()), key=str) == plain_duplicates(rows)
    assert exact_dedup.duplicates(texts(spark, [])).count() == 0 and exact_dedup.drop_duplicates(texts(spark, [])).count() == 0


def test_survivors_are_bounded(spark, monkeypatch):
    """However many texts have an equal one, the second scan knows them by no more numbers than SLOTS; chance hits cost a hash."""
    monkeypatch.setattr(exact_dedup, "SLOTS", 8)
    rows = [(i, f"text {i % 300} {i // 600}") for i in range(900)]
    df = texts(spark, rows)
    assert exact_dedup._survivors(df.withColumn(exact_dedup._TEXT, F.col("text"))).count() <= 8
    assert sorted(map(tuple, exact_dedup.duplicates(df, True).collect()), key=str) == plain_duplicates(rows)


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.duplicates(texts(spark, ROWS), True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
