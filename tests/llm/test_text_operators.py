"""Text operators against brute force, libraries and held-out labels, and on awkward rows."""

import collections
import functools
import hashlib
import math
import re
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodewell.llm import bpe, common, langid, license_scan, line_dedup, lm, minhash, mixing, quality, queries, token_counts, topk
from lodewell.llm.common import bounded_batches

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, rows int, n bigint"


@pytest.fixture(scope="module")
def docs(spark):
    bounded_batches(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns of names that operators use inside."""
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), "k", 1, 2) for d, t, lang, s in rows], SCHEMA)


LONG = "word " * 60_000 + "é" * 5_000
AWKWARD = [
    (1, None, "en", None), (2, "", None, "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b"), (None, "null id", "en", "b"),
    (6, LONG, "en", "c"), (7, "the quick brown fox " * 30, "en", "c"), (8, "der die und das " * 30, "de", "c"), (9, "123 456", "en", "c"), (2**40, "日本語 ½ <|endoftext|>", None, "c"),
]


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_every_operator_takes_awkward_rows(spark, rows):
    bounded_batches(spark)
    df, n = frame(spark, rows), len(rows)
    assert line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df), "kept").count() == n
    assert line_dedup.dedup_lines(df).columns == df.columns
    plan = mixing.mix_plan(df)
    assert plan.count() == n and mixing.training_order(plan).count() == n
    mixing.mixed_documents(df).count()
    assert license_scan.scan(df).count() == n
    near = minhash.near_duplicates(df, shingle=2)
    assert near.count() == n
    assert minhash.drop_near_duplicates(df).columns == df.columns
    assert bpe.encode(df).count() == n and token_counts.count_tokens(df).count() == n
    assert lm.score_documents(df).count() == n
    found = langid.identify(df)
    assert found.count() == n
    assert langid.drop_unidentified(df).columns == df.columns
    assert quality.judge(df).count() == n
    if rows:
        by = {r["doc_id"]: r for r in near.collect()}
        assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[3]["n_shingles"] == 0 and by[None]["component_id"] is None
        assert {r["lang_pred"] for r in found.filter("doc_id IN (1, 2, 3, 9)").collect()} == {"und"}
        assert {r["n_dropped"] for r in line_dedup.keep_bitmaps(df).collect()} == set()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_lines_straddling_tasks(spark):
    """One line in every document, over many small range partitions."""
    line = "x" * 50
    df = frame(spark, [(i, f"own line {i}\n{line}\n {line.upper()} ", "en", "a") for i in range(300)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    rows = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(rows) == 299 and 299 not in rows and all(r["n_dropped"] == 2 for r in rows.values())
    bits = np.unpackbits(np.frombuffer(zlib.decompress(rows[0]["keep_bitmap"]), np.uint8), count=3)
    assert bits.tolist() == [1, 0, 0]


def test_mix_meets_targets(docs):
    rows = mixing.mix_plan(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["position"] is None or 0 <= r["position"] <= 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in rows))


def lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def brute_license(text):
    """Every window of every template, counted plainly."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = {}
    for label, template in license_scan.TEMPLATES:
        own = template.split()
        need, width = math.ceil(0.9 * len(set(own)) - 1e-9), math.ceil(1.25 * len(own))
        if len(set(w) & set(own)) < need:
            continue
        for i in range(len(w)):
            block = w[i : i + width]
            n = len(set(block) & set(own))
            if n >= need and (len(own) > 12 or lcs(own, block) >= math.ceil(0.9 * len(own) - 1e-9)):
                best[label] = max(best.get(label, 0), n / len(set(own)))
    base = {x for _, x in at}
    score = 1.0 if at else max(best.values(), default=0.0)
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | best.keys())), score)


LICENSE_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_licenses_against_brute_force(docs, plain):
    for r in license_scan.scan(docs).collect():
        assert tuple(r[c] for c in LICENSE_COLUMNS) == brute_license(plain[r["doc_id"]])


def test_license_passages_wherever_they_stand(spark):
    """Whole paragraphs and notices, changed, cut, out of order, repeated, at every offset of the text before them."""
    rng = np.random.default_rng(4)
    rows = []
    for label, template in license_scan.TEMPLATES:
        w = template.split()
        for kind in range(6):
            v = list(w)
            if kind == 1:
                v = [x for i, x in enumerate(v) if i % 14 != 5]
            elif kind == 2:
                v = [y for x in v for y in ([x, "inserted"] if rng.random() < 0.15 else [x])]
            elif kind == 3:
                rng.shuffle(v)
            elif kind == 4:
                v = v[: int(0.85 * len(v))]
            elif kind == 5:
                v = v * 3
            rows.append((len(rows), " ".join([*["filler"] * int(rng.integers(0, 70)), *v, *["the software is"] * int(rng.integers(0, 9))]).upper(), "en", "a"))
    rows += [(900, "reserved all day with rights", "en", "a"), (901, "cc by nc " * 20_000, "en", "a"), (902, "all rights reserved " * 20_000, "en", "a")]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    for d, t, *_ in rows[:-2]:
        assert tuple(got[d][c] for c in LICENSE_COLUMNS) == brute_license(t), t
    assert (got[901]["n_base"], got[901]["first_word"], got[901]["last_word"]) == (20_000, 0, 3 * 19_999)
    assert got[902]["labels"] == "all-rights-reserved" and got[900]["labels"] == ""


def brute_components(plain, k=2):
    sets = {}
    for d, t in plain.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {d: find(d) for d in sets}


def test_near_duplicates_against_brute_force(docs, plain):
    sets, want = brute_components(plain)
    rows = minhash.near_duplicates(docs, shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {d: (len(sets[d]), want[d]) for d in sets}


def test_large_buckets_lose_no_link(spark):
    """Copies of one text with words changed: many pairs lie on either side of the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(60):
        w = list(base)
        for i in rng.choice(60, int(rng.integers(1, 8)), replace=False):
            w[i] = f"v{d}x{i}"
        texts[d] = " ".join(w)
    _, want = brute_components(texts)
    rows = minhash.near_duplicates(frame(spark, [(d, t, "en", "a") for d, t in texts.items()]), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_large_buckets_in_many_blobs(spark, monkeypatch):
    """Buckets of several blobs, hot keys treated apart: groups around a few centres, with chains between them."""
    monkeypatch.setattr(minhash, "BLOB", 7)
    monkeypatch.setattr(common, "COOL", 20)
    rng = np.random.default_rng(9)
    texts = {}
    for d in range(120):
        w = [f"w{i}" for i in range(50)]
        for i in rng.choice(50, int(rng.integers(0, 7)), replace=False):
            w[i] = f"v{d % 5}x{i}"
        texts[d] = " ".join(w)
    _, want = brute_components(texts)
    assert len(set(want.values())) > 3
    rows = minhash.near_duplicates(frame(spark, [(d, t, "en", "a") for d, t in texts.items()]), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_filter_loses_no_text(spark):
    """Rows that repeat an id, with equal and with different texts; the same rows come out however they are dealt."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near_a = a.replace("a39", "other")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (3, c), (4, near_a), (4, a), (None, a), (None, a), (5, None), (5, ""), (5, " "), (6, "one"), (7, "One"), (2, c)]
    made = frame(spark, [(d, t, "en", "s") for d, t in rows])
    want = sorted(map(str, [(1, a), (2, b), (2, c), (None, a), (None, a), (5, None), (5, ""), (5, " "), (6, "one")]))
    for n in (1, 13):
        df = made.repartition(n)
        got = minhash.drop_near_duplicates(df)
        assert got.columns == df.columns
        assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == want


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(100, 300)], rng.integers(0, 1 << 63, 60).astype(np.uint64)]))
        bits = np.bitwise_count(np.frombuffer(minhash.sketch(a), np.uint8) ^ np.frombuffer(minhash.sketch(b), np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


ODD = ["", "  ", "ΑΣ Σ İstanbul é ﬁ", "<|endoftext|>hi <|startoftext|> x", "x" * 3000, "don't we'll 'S", "tab\t\t\n  end  ", "😀 日本語 ½ Ⅷ", "a  <|endoftext|>  b", "é" * 700, "ab" * 500 + " <|end"]


def test_bpe_round_trip_with_the_library(spark, plain):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, *(t for t in list(plain.values())[:80])]
    rows = bpe.encode(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_as_the_libraries_have_it():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    model, machine = bpe.tokenizer("word_bpe_49k.json"), token_counts.machine("byte_bpe_50k.json")
    for a in range(0, len(points), 100_000):
        texts = [f"a{c}b1{c}2!{c}?" for c in points[a : a + 100_000]]
        assert [" ".join(x[0] for x in model.encode(t)) for t in texts] == [" ".join(map(str, e.ids)) for e in word.encode_batch(texts, add_special_tokens=False)]
        assert list(map(machine.count, texts)) == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]


def test_bpe_digests(spark, plain):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, *ODD, *list(plain.values())[80:160]]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.encode(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), digest=True).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_rank_array_equals_heap():
    model = bpe.tokenizer("word_bpe_49k.json")
    for word in ("international", "x" * 300, "éèê" * 120):
        parts = [model.inner[b] for b in word.encode()]
        assert model.by_rank_array(list(parts)) == model.by_heap(list(parts))


PARTS = ["a", "s", "t", "'", "'s", "'re", "'v", "ll", "d", " ", "  ", "\n", "\t", "1", "23", "!", "?é", "日本", "<|endoftext|>", "<|end", "\u00a0", "½", "😀", "the ", " of", "\r\n", "'l"]


def test_token_counts_with_the_library(plain, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    machine, rng = token_counts.machine("byte_bpe_50k.json"), np.random.default_rng(6)
    texts = [*ODD, *(t or "" for t in list(plain.values())[:80]), *("".join(rng.choice(PARTS, int(rng.integers(0, 25)))) for _ in range(2000))]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [machine.count(t) for t in texts] == want
    short = [i for i, t in enumerate(texts) if len(t) < 300]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [machine.count(texts[i]) for i in short] == [want[i] for i in short]


def test_chunk_maps_compose_in_any_grouping(monkeypatch):
    machine, rng = token_counts.machine("byte_bpe_50k.json"), np.random.default_rng(8)
    monkeypatch.setattr(token_counts, "CHUNK", 9)
    for _ in range(200):
        text = "".join(rng.choice(PARTS, 40))
        maps = list(map(machine.chunk_map, machine.chunks(text)))
        left = functools.reduce(machine.compose, maps)
        right = functools.reduce(lambda r, m: machine.compose(m, r), reversed(maps))
        for entry in (token_counts.START, machine.read(token_counts.START, "some wor")[1], machine.read(token_counts.START, "x  ")[1], machine.read(token_counts.START, "'")[1]):
            assert machine.apply(left, entry) == machine.apply(right, entry)


def test_token_counts_of_texts_dealt_over_tasks(spark, monkeypatch):
    """Texts of many chunks next to short ones, by the query's own path."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "one", LONG * 5, "x" * 1_100_000, "日本語" * 400_000, "a <|endoftext|>" * 90_000]
    rows = token_counts.count_tokens(frame(spark, [(1 if i == 2 else i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    want = [(1 if i == 2 else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts)]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_lm_base_against_brute_force(docs, plain):
    train = {d: t for d, t in plain.items() if zlib.crc32(str(d).encode()) % 10}
    counts = collections.Counter()
    for t in train.values():
        counts.update([*(t or "").encode().lower().split(), b" end"])
    n, v = sum(counts.values()), len(counts)
    rows = lm.score_documents(docs).collect()
    for r in rows:
        w = [*(plain[r["doc_id"]] or "").encode().lower().split(), b" end"]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, r["doc_id"] not in train)
        assert math.isclose(base, r["base_score"], rel_tol=1e-9)


def brute_scores(words, train):
    """Interpolated scores by recursion over counts in plain dictionaries."""
    counts = [collections.Counter(), collections.Counter(), collections.Counter()]
    for d in train:
        for k, c in enumerate(counts):
            c.update(tuple(words[d][i : i + k + 1]) for i in range(len(words[d]) - k))
    n, v = sum(counts[0].values()), len(counts[0])
    mass = collections.Counter()
    for cs in counts[1:]:
        for g, c in cs.items():
            if c >= 2:
                mass[g[:-1]] += c - 0.75

    def p(g):
        if len(g) == 1:
            return (counts[0][g] + 0.1) / (n + 0.1 * (v + 1))
        c, of = counts[len(g) - 1][g], counts[len(g) - 2][g[:-1]]
        return (c - 0.75 if c >= 2 else 0) / max(of, 1) + (1 - mass[g[:-1]] / max(of, 1)) * p(g[1:])

    return p, counts, {d: sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w))) for d, w in words.items()}


def lm_words(plain):
    words = {d: [*(t or "").encode().lower().split(), b" end"] for d, t in plain.items()}
    return words, [d for d in words if zlib.crc32(str(d).encode()) % 10]


def test_lm_scores_by_every_ngram_seen_twice(docs, plain):
    words, train = lm_words(plain)
    p, counts, want = brute_scores(words, train)
    rows = lm.score_documents(docs.repartition(7)).collect()
    assert sum(c >= 2 for c in counts[1].values()) > 1000 and len(rows) == len(plain)
    for r in rows:
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) > 0.2 * sum(r["n_tokens"] for r in held)


def test_lm_probabilities_sum_to_one(plain):
    words, train = lm_words(plain)
    p, counts, _ = brute_scores(words, train)
    rest = 1 - sum(p(w) for w in counts[0])
    triple = max(counts[2], key=counts[2].get)
    for h in ((b"the",), triple[:2], triple[1:], (b"no such word",)):
        seen = sum(p((*h, *w)) for w in counts[0])
        assert abs(seen + rest * p((*h, b"no such word")) / p((b"no such word",)) - 1) < 1e-9


def test_lm_in_pieces_and_lanes(spark, monkeypatch):
    """Texts of many pieces and lanes score as if they were read in one; no n-gram is counted twice where pieces meet."""
    rng = np.random.default_rng(5)
    plain = {d: " ".join(f"w{x}" for x in rng.zipf(1.5, n) % 30) for d, n in enumerate((0, 1, 2, 3, 7, 40, 41, 900, 260))}
    words, train = lm_words(plain)
    _, _, want = brute_scores(words, train)
    for name, small in (("BLOCK_TOKENS", 50), ("LANE", 7), ("RANGES", 3)):
        monkeypatch.setattr(lm, name, small)
    batch = pa.RecordBatch.from_arrays([pa.array(list(plain)), pa.array([d not in train for d in plain]), pa.array(list(plain.values()))], ["d", "h", "t"])
    blocks = [b for made in lm._blocks(iter([batch])) for b in made.to_pylist()]
    assert len(blocks) > 20
    told: dict = collections.defaultdict(dict)

    def exchange(sent):
        groups = collections.defaultdict(list)
        for t in sent:
            for r in t.to_pylist():
                groups[r["kind"], r["part"]].append(r)
        n = v = 0
        for rows in groups.values():
            for r in lm._add(pa.Table.from_pylist(rows, lm._SENT_ARROW)).to_pylist():
                told[r["block"]][r["kind"], r["part"]] = r["told"]
                n, v = n + r["train_tokens"], v + r["n_words"]
        return n, v

    held = [lm.Block(b, 3) for b in blocks]
    n, v = exchange([b.send_pairs() for b in held])
    for b in held:
        b.hear_pairs(told[b.row["block"]])
    exchange([b.send_triples() for b in held])
    for b in held:
        b.hear_triples(told[b.row["block"]])
    exchange([b.send_masses() for b in held])
    got, size = collections.Counter(), collections.Counter()
    for b in held:
        for r in b.scores(told[b.row["block"]], n, v).to_pylist():
            got[r["doc_id"]] += r["score"]
            size[r["doc_id"]] += r["n_tokens"]
    assert n == sum(len(words[d]) for d in train) and size == {d: len(w) for d, w in words.items()}
    assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_language_on_held_out_documents(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_short_texts_stay_identified(spark, docs):
    few = [(10**6 + i, c, None, "a") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(frame(spark, few).select("doc_id", "text", "lang", "source"))
    assert langid.drop_unidentified(rows).filter("doc_id >= 1000000").count() == len(few)


def test_code_length_of_a_byte_by_hand():
    trees = langid.Trees({"a": {int.from_bytes(b"\0\0\0x", "big"): 3, int.from_bytes(b"\0\0xy", "big"): 1}}, 3)
    data = np.frombuffer(b"xy", np.uint8)
    # x: 3 of 4 in the empty history's deepest context seen; y: sure after x, with an escape to come
    assert np.isclose(trees.code_lengths(data, np.array([2]))[0, 0], -math.log2(3 / 4) - math.log2(1 / 2))


def test_code_lengths_against_brute_force(docs):
    """Method C by plain recursion over counts of contexts, for two languages, bytes never seen included."""
    rows = docs.filter("lang IN ('de', 'en') AND text IS NOT NULL").orderBy("doc_id").limit(30).collect()
    counts = {"de": collections.Counter(), "en": collections.Counter()}
    for r in rows[:20]:
        raw = b"\0\0\0" + r["text"].encode().lower()
        counts[r["lang"]].update(raw[i - 3 : i + 1] for i in range(3, len(raw)))
    by_context = {}
    for lang, grams in counts.items():
        for g, n in grams.items():
            for k in range(4):
                by_context.setdefault((lang, g[3 - k : 3]), collections.Counter())[g[3]] += n

    def bits(lang, text):
        raw, total = b"\0\0\0" + text, 0.0
        for i in range(3, len(raw)):
            for k in (3, 2, 1, 0):
                if not (seen := by_context.get((lang, raw[i - k : i]))):
                    continue
                n, d = sum(seen.values()), len(seen)
                total -= math.log2((seen[raw[i]] or d) / (n + d))
                if seen[raw[i]]:
                    break
            else:
                total += 8
        return total

    trees = langid.Trees({lang: {int.from_bytes(g, "big"): n for g, n in c.items()} for lang, c in counts.items()}, 3)
    texts = [r["text"].encode().lower()[:400] for r in rows] + [b"x", "日本 ½".encode(), b"the \x7f\x01 zz"]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    for t, found in zip(texts, got):
        assert np.allclose(found, [bits("de", t), bits("en", t)], rtol=1e-5)


def test_code_lengths_do_not_depend_on_blocks(plain, docs, monkeypatch):
    trees = langid.learn(docs)
    texts = [(t or "").encode().lower() for t in list(plain.values())[:20]]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = trees.code_lengths(data, ends)
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert np.allclose(trees.code_lengths(data, ends), whole)


def brute_quality(rows):
    """doc_id to (base measures, base_failed, kept), from texts and languages in plain Python."""
    classes = ["[A-Z]", "[0-9]", """[!"'(),\\-./:;?]""", r"[#*$%&|<>+=@\[\]\\^_`{}~]", r"[^\x00-\x7F]"]
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = {k: n for k, n in collections.Counter(lang for _, _, lang in rows if lang is not None).items() if n >= 20}
    counts = {k: collections.Counter() for k in sizes}
    for d, t, lang in rows:
        if lang in sizes and int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:8], 16) < int(min(1.0, 2000 / sizes[lang]) * 2**32):
            counts[lang].update(w for w in words_of(t) if not re.fullmatch(r"[\x00-\x40\x5B-\x60\x7B-\x7F]*", w))
    common = {k: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= 2][:16] for k, c in counts.items()}

    def chars(t, w):
        found = [len(re.findall(c, t or "")) for c in classes]
        return [*found, max(0, sum(map(len, w)) - sum(found))]

    def words(w, lang):
        n = collections.Counter(w)
        found = [n[x] for x in common[lang]]
        return [*found, max(0, len(w) - sum(found))]

    def shares(x):
        return [(c + 0.5) / (sum(x) + 0.5 * len(x)) for c in x]

    def distance(x, total, q):
        p = [c / max(total, 1) for c in x]
        return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + b * math.log2(2 * b / (a + b)) for a, b in zip(p, q)) / 2))

    refs = {}
    for lang in common:
        own = [(t, words_of(t)) for _, t, k in rows if k == lang]
        refs[lang] = shares([sum(c) for c in zip(*(chars(*x) for x in own))]), shares([sum(c) for c in zip(*(words(w, lang) for _, w in own))])
    out = []
    for d, t, lang in rows:
        w = words_of(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        n_chars = sum(map(len, w))
        failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
        char = min((distance(chars(t, w), n_chars, c) for c, _ in refs.values()), default=0)
        word = min((distance(words(w, k), len(w), q) for k, (_, q) in refs.items()), default=0)
        foreign = bool(refs) and lang is not None and lang not in refs
        far = n_chars >= 200 and char > 0.3 or not foreign and len(w) >= 60 and word > 0.285
        out.append((d, len(w), n_chars, len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked), failed, not failed and not far))
    return out


QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rng = np.random.default_rng(7)
    odd = "<| {{ }} | # = 09 07 55 [x] $ % ^ ~ ".split()
    rows += [(10**6 + i, " ".join(rng.choice(odd, 400)), ("en", "xx", None)[i % 3]) for i in range(6)]  # far from all in characters
    rows += [(10**6 + 10 + i, " ".join("Wort, anders"[: 5 + k % 7] + "qx"[k % 2] * (k // 7 + i) for k in range(90)), ("en", "xx", None)[i % 3]) for i in range(6)]  # in words, not held against a language without reference
    rows += [(None, None, "en"), (None, "", None), (5, "one", "en"), (5, "one", "en"), (7, " \n\t ", "de")]
    for part in (rows, rows[-5:], []):
        got = quality.judge(frame(spark, [(d, t, lang, "a") for d, t, lang in part])).select(*QUALITY_COLUMNS).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_quality(part)))
    kept = {r[0]: r[-1] for r in brute_quality(rows)}
    assert not any(kept[10**6 + i] for i in range(6)) and [kept[10**6 + 10 + i] for i in range(3)] == [False, True, False]


def test_quality_common_words_of_all_documents(spark):
    # half of the ids are below the hash of a draw of 2000 of 4000; the other half has the more frequent words
    low = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) < 2**31
    names = {part: [f"{part}{chr(97 + i)}" for i in range(16)] for part in ("seen", "more")}
    rows = [(d, " ".join(names["seen"] if low(d) else names["more"] * 2), "xx", "a") for d in range(4000)]
    assert quality.common_words(frame(spark, rows)) == {"xx": names["more"]}


def test_top_k_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [1.0]), (100, [-1.0, 0.5]), (8, [1e12, 1.0])]
    df = topk.valid_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.top_k(df.filter("vec_id % 100 = 0"), df, k=3).orderBy("query_id", "rank").collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (0, 100):
        scored = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert [tuple(r) for r in got] == want
    assert topk.top_k(df.limit(0), df).count() == 0


def brute_top_k(vectors, queries, k):
    ids = np.array(list(vectors))
    table = np.floor(1024 * np.array(list(vectors.values()))).astype(np.int64)
    out = []
    for q in queries:
        scores = table @ table[int(np.flatnonzero(ids == q)[0])]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out += [(q, n + 1, int(ids[i]), int(scores[i])) for n, i in enumerate(order)]
    return out


@pytest.mark.parametrize("spread", [0.02, 3.0], ids=["clusters", "no structure"])
def test_top_k_prunes_before_vectors_are_sent(spark, monkeypatch, spread):
    """Clustered vectors: most scores are never computed; the result is exact with and without structure."""
    for name, small in (("BLOB", 16), ("QUERY_BLOCK", 8), ("SEEDS", 2), ("PART", 3), ("CHUNK", 5)):
        monkeypatch.setattr(topk, name, small)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + spread * rng.normal(size=16)).tolist() for i in range(1000)}
    df = topk.valid_rows(spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").repartition(5))
    asked = df.filter("vec_id % 50 = 7")
    got = topk.top_k(asked, df, k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_top_k(vectors, range(7, 1000, 50), 5)
    seen = topk.search(asked, df, k=5).agg(F.sum("seen")).first()[0]
    assert seen < (0.25 if spread < 1 else 1.01) * 20 * 999


def test_pipeline(spark):
    sys.path.insert(0, "/root/repo")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, SF)
    second = corpus_pipeline.dedup_lines(spark, first, SF)
    third = corpus_pipeline.near_dedup(spark, second, SF)
    fourth = corpus_pipeline.mix(spark, third, SF)
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    _, roots = brute_components(texts, 5)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(d for d in texts if roots[d] == d)
    order = [r["doc_id"] for r in fourth.collect()]
    out = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(order)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in list(out)[:20]:
        ids = library.encode(texts[d] or "", add_special_tokens=False).ids
        assert out[d] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    near = " ".join(f"w{i}" for i in range(60))
    rows = [*AWKWARD, (20, near, "en", "a"), (20, near, "en", "a"), (20, near.upper() + " more", "de", None), (21, near + " end", "en", "a"), (20, "another text with the same id " * 8, "en", "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, rows[:0]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.dedup_lines(spark, corpus_pipeline.language_id(spark, docs, ""), ""), "")
    got = sorted((str(r["doc_id"]), r["text"][:12]) for r in kept.collect())
    assert [x for x in got if x[0] in ("20", "21")] in ([("20", "another text"), ("20", "w0 w1 w2 w3 ")], [("20", "W0 W1 W2 W3 "), ("20", "another text")])
    assert {d for d, _ in got} == {"4", "None", "6", "7", "8", "20", str(2**40)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {str(r["doc_id"]) for r in out} <= {d for d, _ in got}
