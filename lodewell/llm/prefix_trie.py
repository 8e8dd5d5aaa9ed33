"""The trie of conversation prefixes: what is shared at each node, by smallest-member ownership.

A conversation c of turns (role, text) is first rebuilt: the first h turns of conversation c - c % 20, then its own turns
after its first h, where h = crc32(c) % 4. A node is a distinct sequence of first turns, its members are the conversations
that start with it, and its owner is the smallest of them. A conversation that owns a node owns all the nodes below it on
its path, so what it owns is a suffix of its path, told by one depth. A node's owned occurrence is the one that must be
computed; the tokens of all others are saved. So one sum over the members of a node gives its subtree's totals: each member
adds the tokens of its path from the node down to where its own suffix starts (occurrence tokens minus owned tokens), one
leaf if its last node is its own and childless, and one child if the next node is its own.

A turn stands for itself as the SHA-256 of its role and text, so no text is shuffled. Nodes are named by sums of hashes of
(position, turn) in four parts, 128 bits, which, unlike chained hashes, can be added up in parallel.

No step gathers a group. Turns are range-partitioned by (conversation, turn), so a conversation of any length lies in
consecutive tasks; positions and sums start in each task and are lifted by the totals of the tasks before. Windows mark
owned nodes within (node, salt), then among the at most one row a salt that is left. Sums over members are partial before
the shuffle. Ids of conversations that end in one node are sorted by range, written as pieces of text by each task, and fed
piece by piece to one hash.

Order: by turn, null first; rows of equal turn by the SHA-256 of role and text. Null role and text are empty. Rows without
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.common import WORD, many_to_one, materialize

#: Conversations whose ids agree but for the remainder by FAMILY share the first turns of the one divisible by it; DEEPEST at most.
FAMILY, DEEPEST = 20, 3
#: Ids in one piece of text.
PIECE = 50_000
_SUMS = ["s0", "s1", "s2", "s3"]


def _hashes(position: Column, digest: Column) -> list[Column]:
    """Four numbers of 32 bits for a turn at a position."""
    whole = F.sha2(F.concat_ws(":", position.cast("string"), digest), 256)
    return [F.conv(F.substring(whole, 1 + 8 * k, 8), 16, 10).cast("long").alias(s) for k, s in enumerate(_SUMS)]


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256), 1, 32))


def _ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, row, digest, tokens: turns in order; row holds the task above its lower 33 bits and rises with the order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("tie"),  # parts equal rows, so that any number of them can be dealt
    )
    order = ["conv_id", "turn", "digest", "tie"]
    return materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "tokens", F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33)), "trie-turns")


def _spans(turns: DataFrame) -> DataFrame:
    """A row for each conversation in each task: its first row, the turns before it, the tasks and turns of the conversation."""
    spans = turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(spans.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(own).alias("turns"), F.count(F.lit(1)).over(own).alias("parts")), "trie-spans")


def _placed(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """turns with their position, from 1. (conversation, task) is the key, so a long conversation is many keys."""
    return turns.join(spans, ["conv_id", "part"]).withColumn("p", F.col("row") - F.col("first") + F.col("before") + 1)


def _rebuilt(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each conversation: h, head (turns taken from its family's first), and its rebuilt number of turns."""
    family = F.col("conv_id") % FAMILY == 0
    first = _placed(turns.filter(family), spans.filter(family)).filter(F.col("p") <= DEEPEST)
    heads = first.select("conv_id", F.struct("p", "tokens", *_hashes(F.col("p"), F.col("digest"))).alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("taken"))
    h = F.when(family, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (DEEPEST + 1)).cast("int")
    convs = spans.groupBy("conv_id").agg(F.max("turns").alias("turns")).withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads.withColumnRenamed("conv_id", "of"), "of", "left")
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("tokens"), *[F.lit(0).cast("long").alias(s) for s in _SUMS])), 1, 0)
    head = F.when(F.col("taken").isNull(), none).otherwise(F.slice("taken", F.lit(1), F.col("h")))
    convs = convs.withColumn("head", head).withColumn("len", F.size("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    return materialize(convs.select("conv_id", "h", "head", "len"), "trie-conversations")


def _total(turns: Column, field: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + x[field])


def _occurrences(turns: DataFrame, spans: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation at each node of its path: depth, tokens of the last turn and of all, node and parent."""

    def own(these):
        rows = _placed(turns, these).filter("p > h").withColumn("depth", F.col("p") - F.col("h") + F.col("taken"))
        return rows.select("*", *_hashes(F.col("depth"), F.col("digest")))

    fields = ["tokens", *_SUMS]
    known = spans.join(convs.select("conv_id", "h", "len", F.size("head").alias("taken"), *[_total(F.col("head"), f).alias(f"head_{f}") for f in fields]), "conv_id")
    # what conversations that lie in several tasks have in the tasks before
    totals = materialize(own(known.filter("parts > 1")).groupBy("conv_id", "part").agg(*[F.sum(f).alias(f) for f in fields]), "trie-totals")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "part", *[F.sum(f).over(before).alias(f"carried_{f}") for f in fields])
    known = known.join(carried, ["conv_id", "part"], "left").select(
        "conv_id", "part", "first", "before", "h", "len", "taken", *[(F.col(f"head_{f}") + F.coalesce(f"carried_{f}", F.lit(0))).alias(f"start_{f}") for f in fields]
    )
    so_far = Window.partitionBy("conv_id", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = own(known).select("conv_id", "part", "depth", "len", "tokens", *_SUMS, *[(F.col(f"start_{f}") + F.sum(f).over(so_far)).alias(f"all_{f}") for f in fields])
    rows = rows.select(
        "conv_id", "part", "depth", "len", "tokens", "all_tokens",
        _node(F.col("depth"), [F.col(f"all_{s}") for s in _SUMS]).alias("node"),
        _node(F.col("depth") - 1, [F.col(f"all_{s}") - F.col(s) for s in _SUMS]).alias("up"),
    )
    # the root and the nodes of turns taken from another conversation
    at = convs.select("conv_id", "len", "head", F.explode(F.sequence(F.lit(0), F.size("head"))).alias("d"))
    path = lambda d: F.slice("head", F.lit(1), d)
    node = lambda d: _node(d, [_total(path(d), s) for s in _SUMS])
    top = at.select(
        "conv_id", F.lit(-1).cast("long").alias("part"), F.col("d").cast("long").alias("depth"), "len",
        F.when(F.col("d") > 0, F.element_at("head", F.greatest(F.col("d"), F.lit(1)))["tokens"]).otherwise(0).alias("tokens"), _total(path(F.col("d")), "tokens").alias("all_tokens"),
        node(F.col("d")).alias("node"), F.when(F.col("d") > 0, node(F.greatest(F.col("d") - 1, F.lit(0)))).alias("up"),
    )
    return materialize(rows.unionByName(top), "trie-occurrences")


def _owned(seen: DataFrame) -> DataFrame:
    """The occurrence of each node in its smallest member: how many tokens come before it, and whether it has no child."""
    salts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seen.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)))
    for keys in (["node", "salt"], ["node"]):
        group = Window.partitionBy(*keys)
        longest = F.max("longest" if "longest" in rows.columns else "len").over(group)
        rows = rows.withColumn("longest", longest).withColumn("rank", F.row_number().over(group.orderBy("conv_id"))).filter("rank = 1").drop("rank")
    return materialize(rows.select("conv_id", "depth", "node", "up", (F.col("all_tokens") - F.col("tokens")).alias("before"), (F.col("longest") == F.col("depth")).alias("leaf")), "trie-owned")


def _joined(batches: Iterator) -> Iterator:
    """Sorted (node, conv_id) to pieces of comma-joined ids: (node, first id, ids)."""
    import pyarrow as pa

    node, ids = None, []
    for batch in batches:
        out = []
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or len(ids) >= PIECE):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["node", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])


def _digested(batches: Iterator) -> Iterator:
    """Pieces sorted by (node, first id) to one SHA-256 a node, fed piece by piece."""
    import pyarrow as pa

    node, sha = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in out], pa.binary()), "ends_sha256": [x[1] for x in out]})
    if sha:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [sha.hexdigest()]})


def _ends(ends: DataFrame) -> DataFrame:
    pieces = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = _ordered(conversations)
    spans = _spans(turns)
    convs = _rebuilt(turns, spans)
    seen = _occurrences(turns, spans, convs)
    owned = _owned(seen)

    # a row for each conversation: where its own suffix starts, the tokens before that, its parent there, and whether it ends in a leaf of its own
    ends = materialize(seen.filter("depth = len").select("conv_id", "node", "len", "all_tokens"), "trie-ends")
    starts = owned.groupBy("conv_id").agg(F.min("depth").alias("start"), F.min("before").alias("before"), F.max("leaf").alias("leaf"), F.min_by("up", "depth").alias("up"))
    paths = ends.join(starts, "conv_id", "left").select(
        "conv_id", "up", F.coalesce("start", F.col("len") + 1).alias("start"), F.coalesce("before", "all_tokens").alias("before"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")
    )
    paths = materialize(paths, "trie-paths")
    below = many_to_one(materialize(paths.filter("up IS NOT NULL"), "trie-below"), owned.select(F.col("node").alias("up"), F.col("conv_id").alias("parent")), "up")
    paths = below.drop("up").unionByName(paths.filter("up IS NULL").drop("up").withColumn("parent", F.lit(None).cast("long")))
    parts = spans.select("conv_id", "part").unionByName(convs.select("conv_id", F.lit(-1).cast("long").alias("part"))).join(paths, "conv_id")

    rows = seen.join(parts, ["conv_id", "part"])
    up = F.when(F.col("depth") > F.col("start"), F.col("conv_id")).when(F.col("depth") == F.col("start"), F.col("parent"))
    child = F.when((F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("len")), 1).otherwise(0)
    nodes = rows.groupBy("node").agg(
        F.min(F.struct("conv_id", "depth", up.alias("parent"))).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("before") - F.col("all_tokens") + F.col("tokens"), F.lit(0))).alias("saved_tokens"),
    )
    return nodes.join(_ends(ends), "node", "left").select(
        "owner.conv_id", "owner.depth", F.col("owner.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )
