"""MinHash near-dedup with tensored banding.

A document's set is that of its distinct word shingles. Documents of equal sets are one class; everything after works
on classes, so exact copies cost one row. Two collections of ``side`` half keys are made, each half of ``rows``
minhashes; the key of table (i, j) is the pair of half i of the first and half j of the second. So side * side tables
of 2 * rows minhashes each need only 2 * side * rows minhashes.

Tables are sorted by (key, class) and streamed. A bucket of SMALL classes at most gives all its pairs. A larger one
gives its first class against each other one; after these are verified and joined into components, only pairs across
components are left in it. All of them have an end outside the bucket's largest component, so the classes outside are
set against all others, block against block, BLOB classes each: FEW pairs for each two components in every round, all
in the last, so no pair that meets in a bucket goes unchecked unless it is already connected.

A pivot, a bucket or a component may hold a large share of all rows. Joins on those treat hot keys apart (many_to_one),
pivots are verified in chunks, and each two blocks of a bucket are a key of their own.

Two exact bounds spare most failing pairs: set sizes, and parity sketches of BITS bits, in which every shingle flips
one bit, so that the bits in which two sketches differ never outnumber the shingles in which the sets do. Candidates
that pass are verified on full sets: chunks of at most CHUNK partners of one pivot stream past the pivot's set.
A pair at similarity s is missed with probability 1 - (1 - (1 - s^rows)^side)^2: at s = 0.8, with 12 sides of 3 rows,
0.0004 a pair, at 0.85 0.00002, and less for a group with more than one path.

Defined results: null and empty texts and texts of white space have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; a row with a null doc_id links with nothing and its component is null;
rows that repeat a doc_id are separate documents of the same id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.common import WORD, many_to_one, materialize, mix64, texts, word_hashes

SIDE, ROWS, SMALL, CHUNK = 12, 3, 8, 64
BLOB, BITS, ROUNDS, FEW = 512, 1024, 2, 4
THRESHOLD, SHINGLE = 80, 5
#: Bytes of text hashed at once.
PIECE = 1 << 20
_U = np.uint64


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts, cut at white space."""
    a = 0
    while len(text) - a > PIECE:
        found = [at for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (at := text.rfind(c, a, a + PIECE)) > a]
        if not found:
            break
        yield text[a : max(found)]
        a = max(found)
    yield text[a:]


def shingle_sets(rows: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    odd = mix64(np.arange(11, 11 + k, dtype=np.uint64)) | _U(1)

    def combine(words: np.ndarray) -> np.ndarray:
        n = len(words) - k + 1
        if n <= 0:
            return mix64((words * odd[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _U(len(words) + 1)) if len(words) else words
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += words[j : j + n] * odd[j]
        return np.unique(mix64(out))

    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(held), np.uint8)
        hashes, starts = word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in held])
        cuts = np.searchsorted(starts, ends)
        for a, b in zip(np.append(0, cuts[:-1]), cuts):
            yield combine(hashes[a:b])
        held.clear()

    size = 0
    for text in rows:
        if size + len(text) > PIECE and held:
            yield from flush()
            size = 0
        if len(text) > PIECE:
            yield combine(np.concatenate([word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(text)]))
            continue
        held.append(text)
        size += len(text)
    if held:
        yield from flush()


def class_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """BITS parity bits."""
    return np.packbits((np.bincount((shingles >> _U(20)) % _U(BITS), minlength=BITS) & 1).astype(bool)).tobytes()


def room(n1, n2, percent: int):
    """The most shingles in which two sets of these sizes may differ at the threshold."""
    return (n1 + n2) * (100 - percent) // (100 + percent)


def half_keys(sets: list[np.ndarray], side: int, rows: int) -> np.ndarray:
    """(documents, 2 * side) half keys: the first collection's, then the second's."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), 2 * side), np.uint64)
    seeds = mix64(np.arange(1, 4 * side * rows + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    for h in range(2 * side):
        for r in range(rows):
            n = h * rows + r
            least = np.minimum.reduceat((flat ^ seeds[2 * n]) * (seeds[2 * n + 1] | _U(1)), starts)
            out[:, h] = mix64(out[:, h] + least + _U(h + 1))
    return out


def _features(k: int, side: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(texts(batch.column(1)), k))
            full = [i for i, s in enumerate(sets) if len(s)]
            halves: list = [None] * len(sets)
            for a in range(0, len(full), 256):
                at = full[a : a + 256]
                for i, row in zip(at, half_keys([sets[i] for i in at], side, rows)):
                    halves[i] = row.tobytes()
            ids = [class_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(halves, pa.binary()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "text_hash", "n", "class", "halves", "bits"],
            )

    return run


def _tables(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.arange(1, side * side + 1, dtype=np.uint64).reshape(side, side) * _U(0xA0761D6478BD642F)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            halves = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, 2, side)
            for a in range(0, n, 200):
                part = halves[a : a + 200]
                keys = mix64(part[:, 0, :, None] * _U(0xE7037ED1A0B428DB) + part[:, 1, None, :] * _U(0x8EBC6AF09C88C6E3) + spread).reshape(-1).view(np.int64)
                m = side * side
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids[a : a + 200], m)), pa.array(np.repeat(sizes[a : a + 200], m).astype(np.int32))], ["key", "class", "n"])

    return run


def near(n1, n2, percent: int):
    """Whether two set sizes leave room for the threshold."""
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


PAIR, MEMBER = 0, 1
_BUCKETS = "kind int, key bigint, a bigint, b bigint, n int"


def _buckets(percent: int):
    """Streams rows sorted by (key, class): pairs of small buckets, stars of large ones and their members."""

    def give(kind: int, keys, a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(keys), pa.array(a), pa.array(b), pa.array(n)], ["kind", "key", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        star: list = [None]  # (key, class, size) of the first row of a large bucket that goes on

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            keys, ids, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            new = np.append(True, keys[1:] != keys[:-1])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(keys)))
            going = star[0] is not None and star[0][0] == keys[0]
            if not last and lengths[-1] <= SMALL and not (going and len(starts) == 1):
                cut = starts[-1]
                held.append((keys[cut:], ids[cut:], n[cut:]))
                keys, ids, n, starts, lengths = keys[:cut], ids[:cut], n[:cut], starts[:-1], lengths[:-1]
                if not len(keys):
                    return
            length = np.repeat(lengths, lengths)
            first = np.repeat(starts, lengths)
            large = length > SMALL
            pivot, pivot_n = ids[first], n[first]
            if going:
                own = first == 0
                large |= own
                pivot, pivot_n = np.where(own, star[0][1], pivot), np.where(own, star[0][2], pivot_n)
            for d in range(1, SMALL):
                i = np.flatnonzero(~large[:-d] & (first[:-d] == first[d:])) if len(keys) > d else []
                if len(i):
                    i = i[near(n[i], n[i + d], percent) & (ids[i] != ids[i + d])]
                    if len(i):
                        yield give(PAIR, keys[i], ids[i], ids[i + d], n[i])
            i = np.flatnonzero(large)
            if len(i):
                yield give(MEMBER, keys[i], ids[i], ids[i], n[i])
                i = i[near(n[i], pivot_n[i], percent) & (ids[i] != pivot[i])]
                if len(i):
                    yield give(PAIR, keys[i], pivot[i], ids[i], n[i])
            if len(keys):
                star[0] = (keys[-1], pivot[-1], pivot_n[-1]) if large[-1] else None

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
                size += batch.num_rows
            if size >= 100_000:
                yield from work(False)
                size = sum(len(h[0]) for h in held)
        if held:
            yield from work(True)

    return run


def _sets(k: int):
    """(class, set) of the rows whose class is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, ids, out = batch.column(0).to_pylist(), [], []
            for w, s in zip(want, shingle_sets(texts(batch.column(1)), k)):
                if len(s) and class_id(s) == w:
                    ids.append(w)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["class", "shingles"])

    return run


def _verify(percent: int):
    """Rows sorted by (pivot, part, role): the pivot's set comes first, its partners stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = own = None
        for batch in batches:
            a, b = [], []
            for pivot, part, role, other, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                one = np.frombuffer(raw, np.uint64)
                if role == 0:
                    key, own = (pivot, part), one
                    continue
                if key != (pivot, part):
                    continue
                at = np.minimum(np.searchsorted(own, one), len(own) - 1)
                shared = int((own[at] == one).sum())
                if 100 * shared >= percent * (len(own) + len(one) - shared):
                    a.append(pivot)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold. No task holds more than a pivot's set and one partner's."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    cut = many_to_one(pairs, parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    rows = cut.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("class")).unionByName(
        parts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("class"))
    )
    full = rows.join(sets, "class").select("a", "part", "role", "class", "shingles")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(n, "a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_verify(percent), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(class, root) of every class on an edge, by repeated contraction.

    Each round sends a class to its smallest neighbour in an order drawn anew for the round, then replaces the ends of
    every edge; edges within one root go. Rounds are written out, so lineage stays short.
    """
    roots = None
    n = 0
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("h"), c.alias("c"))  # noqa: E731, B023
        to = both.groupBy("u").agg(F.min(drawn(F.col("v"))).alias("m")).select("u", F.least(F.col("m"), drawn(F.col("u")))["c"].alias("r"))
        to = materialize(to, f"roots-{n}")
        if roots is None:
            roots = to.select(F.col("u").alias("class"), F.col("r").alias("root"))
        else:
            roots = materialize(roots.join(to, roots["root"] == to["u"], "left").select("class", F.coalesce("r", "root").alias("root")), f"labels-{n}")
        left = many_to_one(edges, to.select(F.col("u").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("u").alias("b"), F.col("r").alias("rb")), "b")
        edges = materialize(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges-{n}")
        n += 1
        if edges.isEmpty():
            return roots


def _possible(percent: int):
    """Whether sizes and sketches leave room for the threshold, for columns of both sides."""

    def run(n1: pa.Array, bits1: pa.Array, n2: pa.Array, bits2: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in (bits1, bits2))
        a, b = n1.to_numpy(), n2.to_numpy()
        return pa.array((np.bitwise_count(x ^ y).sum(axis=1) <= room(a, b, percent)) & near(a, b, percent))

    return F.arrow_udf(run, "boolean")


def possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bounds let pass."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = many_to_one(pairs, side("a"), "a").join(side("b"), "b")
    return both.filter(_possible(percent)("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _across(percent: int, turn: int, few: int | None):
    """Pairs of a block's classes outside the largest component with a block's of any, across components, that pass the bounds.

    With ``few``, at most that many for each two components, drawn anew every turn.
    """

    def draw(a, b, root_a, root_b, seed):
        rank = mix64(mix64(a.astype(np.uint64) ^ seed) ^ b.astype(np.uint64))
        order = np.lexsort((rank, root_b, root_a))
        ra, rb = root_a[order], root_b[order]
        new = np.append(True, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]))
        start = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return order[place < few]

    def unpack(rows):
        ids = np.array([r["class"] for r in rows], np.int64)
        n, root = np.array([r["n"] for r in rows], np.int64), np.array([r["root"] for r in rows], np.int64)
        return ids, n, root, np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = _U(mix64(np.array([turn + 1], np.uint64))[0])
        for batch in batches:
            for rows_x, rows_y, main in zip(*(batch.column(i).to_pylist() for i in range(3))):
                (ids, n, root, bits), (ids_y, n_y, root_y, bits_y) = unpack(rows_x), unpack(rows_y)
                held, size = [], 0
                for i in range(len(ids)):
                    # two classes outside the largest component meet twice, and count once
                    at = np.flatnonzero((root_y != root[i]) & near(n_y, n[i], percent) & ((root_y == main) | (ids_y > ids[i])))
                    if len(at):
                        at = at[np.bitwise_count(bits_y[at] ^ bits[i]).sum(axis=1) <= room(n_y[at], n[i], percent)]
                    if not len(at):
                        continue
                    held.append((np.full(len(at), ids[i]), ids_y[at], np.full(len(at), root[i]), root_y[at]))
                    size += len(at)
                    if few and size > 100_000:
                        whole = [np.concatenate(c) for c in zip(*held)]
                        drawn = draw(*whole, seed)
                        held, size = [tuple(x[drawn] for x in whole)], len(drawn)
                if not held:
                    continue
                whole = [np.concatenate(c) for c in zip(*held)]
                drawn = draw(*whole, seed) if few else slice(None)
                a, b = whole[0][drawn], whole[1][drawn]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _more_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs across components in large buckets. Of buckets with the same members one is enough."""
    labelled = materialize(members.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "labelled")
    print_of = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("class").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "class")))
    keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), print_of.alias("print")).filter("lo <> hi")
    keys = keys.groupBy("print").agg(F.min("key").alias("key")).select("key")
    largest = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    rows = many_to_one(labelled, keys.join(largest, "key"), "key").join(classes.select("class", "bits"), "class")
    held = F.collect_list(F.struct("class", "n", "root", "bits"))
    x = rows.filter("root <> main").groupBy("key", "blob").agg(held.alias("one"), F.max("main").alias("main"), F.max("blobs").alias("blobs"))
    x = x.select("key", "one", "main", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blobs") - 1)).alias("blob"))
    y = rows.groupBy("key", "blob").agg(held.alias("two"))
    return x.join(y, ["key", "blob"]).select("one", "two", "main").mapInArrow(_across(percent, turn, FEW if turn < ROUNDS else None), "a bigint, b bigint").distinct()


def _classed(docs: DataFrame, shingle: int, percent: int, side: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, class) of every row and (class, root, component_id) of every class of a document with an id."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    features = materialize(hashed.mapInArrow(_features(shingle, side, rows), "doc_id bigint, text_hash bigint, n bigint, class bigint, halves binary, bits binary"), "features")
    linked = features.filter(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    classes = materialize(linked.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("halves").alias("halves"), F.max("bits").alias("bits")), "classes")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = classes.select("class", "n", "halves").mapInArrow(_tables(side), "key bigint, class bigint, n int")
    buckets = materialize(tables.repartition(n_parts, "key").sortWithinPartitions("key", "class").mapInArrow(_buckets(percent), _BUCKETS), "buckets")
    pairs = materialize(buckets.filter(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    pairs = materialize(possible_pairs(pairs, classes, percent), "pairs")
    # what meets in a large bucket of table (i, j) shares half i of the first collection: side keys a class are enough
    large = buckets.filter(F.col("kind") == MEMBER).select(F.col("a").alias("class")).distinct().join(classes.select("class", "n", "halves"), "class")
    half = F.posexplode(F.array(*[F.substring("halves", 8 * i + 1, 8) for i in range(side)]))
    members = materialize(large.select("class", "n", half.alias("i", "half")).select(F.xxhash64("i", "half").alias("key"), "class", "n"), "members")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(members.select("class")).distinct()
    wanted = wanted.join(classes.select("class", "rep"), "class").hint("shuffle_hash")
    sets = materialize(base.join(wanted, F.col("doc_id") == F.col("rep")).select("class", "text").mapInArrow(_sets(shingle), "class bigint, shingles binary"), "sets")
    edges = materialize(verified(pairs, sets, percent), "links")
    roots = components(edges)
    tested = pairs
    if not members.isEmpty():
        # blobs are drawn by hash, so that no task orders a whole bucket
        sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOB).alias("blobs"))
        members = many_to_one(members, sizes, "key").withColumn("blob", F.pmod(F.xxhash64(F.lit("blob"), "class"), "blobs"))
        members = materialize(members, "members-in-blobs")
        turn = 0
        while turn <= ROUNDS:
            more = _more_pairs(members, classes, roots, turn, percent)
            more = materialize(more.join(tested, ["a", "b"], "left_anti"), "more-pairs")
            turn = ROUNDS if turn < ROUNDS and more.isEmpty() else turn + 1  # the last turn takes every pair
            if more.isEmpty():
                continue
            tested = tested.unionByName(more)
            found = materialize(verified(more, sets, percent), "more-links")
            if not found.isEmpty():
                edges = materialize(edges.unionByName(found), "links")
                roots = components(edges)
    named = materialize(roots.join(classes.select("class", "rep"), "class"), "named")
    of_class = many_to_one(named, named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("class", "root", "component_id")
    alone = classes.select("class", "rep").join(roots.select("class"), "class", "left_anti").select("class", F.col("class").alias("root"), F.col("rep").alias("component_id"))
    whole = materialize(of_class.unionByName(alone), "components")
    return features.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")), whole


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept."""
    found, of_class = _classed(docs, shingle, percent, side, rows)
    component = F.coalesce("component_id", "doc_id")
    out = many_to_one(found.select("doc_id", "n", "class"), of_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Column names that the filter adds while it works; no input column may be called so.
_ID, _HASH, _ROW = "__lodewell_id", "__lodewell_hash", "__lodewell_row"


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """One document of each group: of those with its smallest id the one of the smallest text hash, once.

    Documents are told apart by id and text, so of rows that share an id only those of one group are duplicates. Of rows
    that share both, the first in the table's order stays. Rows without an id and rows without words are linked with nothing: all stay.
    """
    found, of_class = _classed(docs, shingle, percent, SIDE, ROWS)
    rows = many_to_one(found.filter("class IS NOT NULL").select("doc_id", "text_hash", "class"), of_class, "class").filter("doc_id = component_id")
    texts_of = rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = materialize(texts_of.groupBy("root", "doc_id").agg(F.min(F.struct("text_hash", "copies")).alias("t")).select("doc_id", "t.*"), "kept")
    key, own = F.col("doc_id").cast("bigint"), F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    told = docs.filter(own).withColumns({_ID: key, _HASH: F.xxhash64("text")})
    if not first.filter("copies > 1").isEmpty():
        told = told.withColumn(_ROW, F.monotonically_increasing_id())  # columns of any type: rows are told apart by their place
        told = told.withColumn(_ROW, F.row_number().over(Window.partitionBy(_ID, _HASH).orderBy(_ROW))).filter(F.col(_ROW) == 1).drop(_ROW)
    kept = first.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH))
    return told.join(kept, [_ID, _HASH], "left_semi").select(*docs.columns).unionByName(docs.filter(~own))
