"""Language-model scoring with a weighted backoff automaton.

Unigrams are counted exactly over all training documents and smoothed by adding ALPHA. Every longer n-gram up to order 3
that is seen LEAST times or more is an arc, so the automaton grows with the corpus. Orders are interpolated by absolute
discounting: p(w | h) = (c(hw) - DISCOUNT) / c(h), where hw is an arc, plus f(h) p(w | h without its first word). f(h),
what the arcs of h leave of 1, is the weight of the failure arc of state h, so every state's probabilities sum to 1.
A text is read once from left to right: the state (the longest arc that the text so far ends with) is carried from
token to token; a token without an arc adds the state's failure weight and is tried again from the state it leads to.
Texts of a block are read side by side, in lanes of LANE tokens at most; a lane that begins inside a text first reads
the two tokens before it, after which an automaton of order 3 is in the same state as if it had read them all.

No task holds the automaton. Documents are written in blocks of BLOCK_TOKENS tokens (longer texts in several), numbered
by a vocabulary of the block. A block hands out the hashes of its distinct n-grams with their training counts, one row
for each range of hashes; a range adds up what all blocks sent and answers each block with totals. Three such exchanges
give a block all arcs its texts can reach: counts of words and pairs; counts of triples whose two pairs are arcs (no
other triple can be seen LEAST times); and the arcs' mass of each state, to which every arc is added once, by the block
that owns it. The blocks lie bucketed, so that only answers are shuffled to meet them. Words meet by 64-bit hash, longer
n-grams by one of 26 bits more than the corpus's size takes, 64 at most: up to 2^38 tokens an n-gram shares another's
count with a probability below 2^-26.

Defined results: null and empty texts are the end token alone; a null doc_id counts as remainder 0; rows that repeat
a doc_id are separate documents; other columns are ignored. Without training documents N and V are 0 and every score
is that of an even spread, log10 of 0.1 / 0.1 a token.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.common import crc_mod, materialize, mix64, texts

ALPHA, DISCOUNT, LEAST = 0.1, 0.75, 2
#: The end token; no word holds a space.
END = b" end"
#: Tokens and words of a block; tokens of a lane.
BLOCK_TOKENS, BLOCK_WORDS, LANE = 500_000, 250_000, 512
#: Ranges of hashes at least, and tokens of the corpus for each further one.
RANGES, RANGE_TOKENS = 64, 2_000_000
#: Tokens that a piece of a text repeats from the one before.
LEAD = 2
#: Bits of an n-gram's hash beyond those of the number of tokens.
SPARE_BITS = 26
WORD, PAIR, TRIPLE, WORD_MASS, PAIR_MASS = range(5)
_U = np.uint64


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Values compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True) if len(values) else b""


def _unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd", 1).decompress(raw, n * width, asbytes=True), np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its two overlapping parts (of its two words, for a pair)."""
    return mix64(mix64(left ^ _U(0x9E3779B97F4A7C15)) + right)


class _Writer:
    """Pieces of texts gathered into the row of a block. Word ids follow the order of the words' hashes."""

    names = ["block", "n_tokens", "homes", "places", "doc_ids", "held_out", "leads", "lengths", "ids", "words"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def __init__(self) -> None:
        # blocks are written once, so a drawn number tells them apart
        self.block = int.from_bytes(os.urandom(8), "little", signed=True)
        self.vocabulary, self.pieces, self.n_tokens = defaultdict(count().__next__), [], 0

    def add(self, words: list[bytes], *of) -> None:
        self.pieces.append((*of, np.array(list(map(self.vocabulary.__getitem__, words)), np.uint32)))
        self.n_tokens += len(words)

    def full(self) -> bool:
        return self.n_tokens >= BLOCK_TOKENS or len(self.vocabulary) >= BLOCK_WORDS

    def row(self) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        homes, places, docs, held, leads, ids = zip(*self.pieces)
        row = (self.block, self.n_tokens, homes, places, docs, held, leads, list(map(len, ids)), _pack(rank[np.concatenate(ids)]), hashes[order].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, self.kinds)], self.names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Writer()
    for batch in batches:
        for doc, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            words = tokens(text)
            of = (out.block, len(out.pieces), doc, held_out)
            for a in range(0, len(words), BLOCK_TOKENS):
                lead = min(a, LEAD)
                out.add(words[a - lead : a + BLOCK_TOKENS], *of, lead)
                if out.full():
                    yield out.row()
                    out = _Writer()
    if out.pieces:
        yield out.row()


_BLOCKS = "block bigint, n_tokens bigint, homes array<bigint>, places array<int>, doc_ids array<bigint>, held_out array<boolean>, leads array<int>, lengths array<bigint>, ids binary, words binary"
_SENT = "kind int, part int, block bigint, n int, keys binary, sums binary"
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
_TOLD = "kind int, part int, block bigint, told binary, n_words bigint, train_tokens bigint"
_FOUND = "home bigint, place int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _parts(keys: np.ndarray, parts: int) -> tuple[list[int], list[int]]:
    """The ranges that sorted keys fall into, and where each of those begins, with the end."""
    part = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return part[at].tolist(), [*at.tolist(), len(keys)]


def _send(block: int, parts: int, kind: int, keys: np.ndarray, sums: np.ndarray) -> pa.Table:
    """A row for each range: differences of the sorted keys, and what the block adds to each."""
    part, at = _parts(keys, parts)
    steps = np.diff(keys, prepend=_U(0))
    steps[at[:-1]] = keys[at[:-1]]
    rows = [(kind, p, block, b - a, _pack(steps[a:b]), _pack(sums[a:b])) for p, a, b in zip(part, at, at[1:])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _SENT_ARROW)], schema=_SENT_ARROW)


def _add(sent: pa.Table) -> pa.Table:
    """Twice the sum of each key over all blocks, and one more for the block that owns it."""
    kind, sizes = sent.column("kind")[0].as_py(), sent.column("n").to_pylist()
    keys, sums = (np.concatenate([_unpack(x, n, t) for x, n in zip(sent.column(c).to_pylist(), sizes)]) for c, t in (("keys", np.uint64), ("sums", np.int64)))
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        np.cumsum(keys[a:b], out=keys[a:b])
    found, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, sums, len(found)) if sums.max(initial=0) < 1 << 20 and len(sums) < 1 << 32 else None
    if total is None:  # beyond what doubles add exactly
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, sums)
    total = total.astype(np.int64)
    owner = np.empty(len(found), np.int64)
    owner[at] = np.arange(len(keys))
    answer = 2 * total[at]
    answer[owner] += 1
    told = [_pack(answer[b - n : b]) for b, n in zip(ends, sizes)]
    words, tokens_ = (int((total > 0).sum()), int(total.sum())) if kind == WORD else (0, 0)
    first = [1] + [0] * (len(told) - 1)
    columns = [sent.column("kind"), sent.column("part"), sent.column("block"), pa.array(told, pa.binary()), pa.array([words * x for x in first], pa.int64()), pa.array([tokens_ * x for x in first], pa.int64())]
    return pa.table(columns, _TOLD.replace(",", "").split()[::2])


class Automaton:
    """The states, arcs and failure arcs that the texts of a block can reach.

    State 0 is the empty one, then come words, then pairs that are arcs. Arcs are held by order, longest first: the
    state they leave, their weight and the state they lead to.
    """

    def __init__(self, n_words: int, n_pairs: int) -> None:
        self.depth_from = (1 + n_words, 1, 0)  # the first state of depth two, of depth one, of any
        self.fail_weight, self.fail_to = np.zeros(1 + n_words + n_pairs), np.zeros(1 + n_words + n_pairs, np.int64)
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def traverse(self, arcs_at: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The weight of each token. arcs_at: at each token the arc of each order that its n-gram has, or -1.

        starts, ends: of the texts. Lanes are read side by side, each with a state of its own.
        """
        cuts = [np.arange(a, b, LANE) for a, b in zip(starts.tolist(), ends.tolist())]
        lane, stop = np.concatenate(cuts), np.concatenate([np.minimum(c + LANE, b) for c, b in zip(cuts, ends.tolist())])
        begin = np.maximum(lane - LEAD, np.repeat(starts, list(map(len, cuts))))
        order = np.argsort(begin - stop, kind="stable")  # the longest first, so that lanes still read are a prefix
        lane, stop, begin = lane[order], stop[order], begin[order]
        length = stop - begin
        out, states = np.zeros(len(arcs_at[0])), np.zeros(len(begin), np.int64)
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))
            at, state = begin[:n] + t, states[:n]
            weight, reached, open_ = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
            for (leaves, arc_weight, leads), arc_of, deep in zip(self.arcs, arcs_at, self.depth_from):
                arc = arc_of[at]
                hit = open_ & (arc >= 0)
                hit[hit] = leaves[arc[hit]] == state[hit]
                taken = arc[hit]
                weight[hit] += arc_weight[taken]
                reached[hit] = leads[taken]
                open_ &= ~hit
                down = open_ & (state >= max(deep, 1))
                weight[down] += self.fail_weight[state[down]]
                state[down] = self.fail_to[state[down]]
            states[:n] = reached
            own = at >= lane[:n]
            out[at[own]] = weight[own]
        return out


class Block:
    """A block's texts end to end, its distinct n-grams as sorted keys, and what the exchanges told about them."""

    def __init__(self, row: dict, parts: int, bits: int = 64) -> None:
        self.row, self.parts, self.mask = row, parts, ~_U((1 << 64 - bits) - 1)
        self.ids = _unpack(row["ids"], row["n_tokens"], np.uint32).astype(np.int64)
        self.words, lengths = np.frombuffer(row["words"], np.uint64), np.array(row["lengths"])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        first = np.zeros(len(self.ids), bool)
        first[self.starts] = True
        self.leads = np.array(row["leads"])
        self.counts = np.repeat(~np.array(row["held_out"], bool), lengths)
        self.lead = np.zeros(len(self.ids), bool)
        for a, n in zip(self.starts[self.leads > 0], self.leads[self.leads > 0]):
            self.lead[a : a + n] = True
        self.counts &= ~self.lead
        self.later = np.flatnonzero(~first)
        self.pairs, self.pair = self.grams(_join(self.words[self.ids[self.later - 1]], self.words[self.ids[self.later]]), self.later)

    def grams(self, hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in order, and the place among them of the n-gram that ends at each token, or -1."""
        keys, at = np.unique(hashes & self.mask, return_inverse=True)
        out = np.full(len(self.ids), -1)
        out[where] = at
        return keys, out

    def counted(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.counts & (at >= 0)], minlength=n).astype(np.int64)

    def send(self, kind: int, keys: np.ndarray, sums: np.ndarray) -> pa.Table:
        return _send(self.row["block"], self.parts, kind, keys, sums)

    def told(self, answers: dict, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The total of each key, and whether this block owns it."""
        part, at = _parts(keys, self.parts)
        found = np.concatenate([np.zeros(0, np.int64), *(_unpack(answers[kind, p], b - a, np.int64) for p, a, b in zip(part, at, at[1:]))])
        return found >> 1, (found & 1).astype(bool)

    def send_pairs(self) -> pa.Table:
        return pa.concat_tables([self.send(WORD, self.words, self.counted(self.ids, len(self.words))), self.send(PAIR, self.pairs, self.counted(self.pair, len(self.pairs)))])

    def hear_pairs(self, answers: dict) -> None:
        self.count, _ = self.told(answers, WORD, self.words)
        n, own = self.told(answers, PAIR, self.pairs)
        arc = n >= LEAST
        # from here on only pairs that are arcs count
        self.pair = np.append(np.where(arc, np.cumsum(arc) - 1, -1), -1)[self.pair]
        self.pairs, self.pair_count, self.own_pair = self.pairs[arc], n[arc], own[arc]
        at = np.flatnonzero(self.pair >= 0)
        self.left, self.right = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), np.int64)
        self.left[self.pair[at]], self.right[self.pair[at]] = self.ids[at - 1], self.ids[at]
        both = at[1:][(np.diff(at) == 1) & (self.pair[at[1:] - 1] >= 0)] if len(at) else at
        self.triples, self.triple = self.grams(_join(self.pairs[self.pair[both - 1]], self.pairs[self.pair[both]]), both)

    def send_triples(self) -> pa.Table:
        return self.send(TRIPLE, self.triples, self.counted(self.triple, len(self.triples)))

    def hear_triples(self, answers: dict) -> None:
        n, own = self.told(answers, TRIPLE, self.triples)
        arc = n >= LEAST
        self.triple = np.append(np.where(arc, np.cumsum(arc) - 1, -1), -1)[self.triple]
        self.triple_count, self.own_triple = n[arc], own[arc]
        at = np.flatnonzero(self.triple >= 0)
        self.context, self.last = np.zeros(len(self.triple_count), np.int64), np.zeros(len(self.triple_count), np.int64)
        self.context[self.triple[at]], self.last[self.triple[at]] = self.pair[at - 1], self.pair[at]

    def send_masses(self) -> pa.Table:
        """Four times the mass that the arcs of each state take, of the arcs that this block owns."""
        mass = lambda n, own, state, size: np.bincount(state[own], (4 * n - round(4 * DISCOUNT))[own], size).astype(np.int64)
        words = self.send(WORD_MASS, self.words, mass(self.pair_count, self.own_pair, self.left, len(self.words)))
        return pa.concat_tables([words, self.send(PAIR_MASS, self.pairs, mass(self.triple_count, self.own_triple, self.context, len(self.pairs)))])

    def automaton(self, answers: dict, n: int, v: int) -> Automaton:
        """Arcs are put together from the shorter ones, so each weighs the interpolated probability."""
        words, pairs = len(self.words), len(self.pairs)
        rest = lambda kind, keys, of: 1 - self.told(answers, kind, keys)[0] / 4 / np.maximum(of, 1)
        fail_word, fail_pair = rest(WORD_MASS, self.words, self.count), rest(PAIR_MASS, self.pairs, self.pair_count)
        self.p = (self.count + ALPHA) / (n + ALPHA * (v + 1))
        p2 = (self.pair_count - DISCOUNT) / self.count[self.left] + fail_word[self.left] * self.p[self.right]
        p3 = (self.triple_count - DISCOUNT) / self.pair_count[self.context] + fail_pair[self.context] * p2[self.last]
        out = Automaton(words, pairs)
        out.fail_weight[1:] = np.log10(np.concatenate([fail_word, fail_pair]))
        out.fail_to[1 + words :] = 1 + self.right
        out.arcs = [(1 + words + self.context, np.log10(p3), 1 + words + self.last), (1 + self.left, np.log10(p2), 1 + words + np.arange(pairs)), (np.zeros(words, np.int64), np.log10(self.p), 1 + np.arange(words))]
        return out

    def scores(self, answers: dict, n: int, v: int) -> pa.Table:
        model = self.automaton(answers, n, v)
        own = ~self.lead
        add = lambda x: np.add.reduceat(np.where(own, x, 0), self.starts)
        row, size = self.row, self.ends - self.starts - self.leads
        score = add(model.traverse([self.triple, self.pair, self.ids], self.starts, self.ends))
        columns = [row["homes"], row["places"], row["doc_ids"], row["held_out"], size, add((self.count > 0)[self.ids].astype(np.int64)), add(np.log10(self.p)[self.ids]), score]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], _FOUND.replace(",", "").split()[::2])


def _start(parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from Block(row, parts, bits).send_pairs().to_batches()

    return run


def _step(step: int, parts: int, bits: int, n: int, v: int):
    """What a block sends in an exchange, or its scores, from what the exchanges before told it."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        heard = {(k, p): x for k, p, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "told")))}
        block = Block(blocks.to_pylist()[0], parts, bits)
        block.hear_pairs(heard)
        if step == 2:
            return block.send_triples()
        block.hear_triples(heard)
        return block.send_masses() if step == 3 else block.scores(heard, n, v)

    return run


def score_documents(docs: DataFrame, fold: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text, by a model of the documents outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", fold) == 0).alias("held_out"), "text")
    blocks = materialize(rows.mapInArrow(_blocks, _BLOCKS), "lm-blocks", bucket_by="block")
    size = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts, bits = max(RANGES, size // RANGE_TOKENS), min(64, SPARE_BITS + size.bit_length())

    def exchange(step: int, sent: DataFrame) -> DataFrame:
        # what was shuffled is of no use once the answers are written, and would fill the disks
        conf, key = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            return materialize(sent.groupBy("kind", "part").applyInArrow(_add, _TOLD), f"lm-told-{step}")
        finally:
            conf.set(key, before)

    told = exchange(1, blocks.mapInArrow(_start(parts, bits), _SENT))
    v, n = told.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    for step, schema in ((2, _SENT), (3, _SENT), (4, _FOUND)):
        answers = told.select("kind", "part", "block", "told").groupBy("block")
        out = blocks.groupBy("block").cogroup(answers).applyInArrow(_step(step, parts, bits, n, v), schema)
        told = told if step == 4 else told.unionByName(exchange(step, out))
    # a text of several pieces is one row again
    whole = out.groupBy("home", "place", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
