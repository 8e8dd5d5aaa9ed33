"""Token counts by a compiled finite-state tokenizer.

For byte-level BPE the encoding of a prefix is fixed by its last token: each byte read makes the one token that fits
the encoding before it, so the count of tokens so far moves by a fixed amount. A state of the inner machine is what later
bytes can still depend on: the longest suffix that begins some token, with the last token and the relative count at
each place in that suffix. Transitions are compiled when first met and annotated with the change of the count. An outer
machine reads characters and splits the text into words: its states are a boundary, a run of one kind, a run of white
space and an apostrophe that may begin a contraction, each with the inner states of what is pending.

A text is cut into chunks, and a chunk is a map from the state in which it is entered to the state in which it is left
and the tokens it emits. White space after another character and special tokens close whatever is pending, so beyond the
first such place all entry states give the same: the map is the text before that place, which an entry state is run
over, and a count and an exit state common to all. Maps compose, in any grouping: the result does not depend on where the
cuts fall, and a pairwise scan gives a text's count. The chunks of texts of over LONG code points are mapped by many
tasks, and only their maps come together. A chunk without such a place, as in a text without white space, is its own
map, and the composed maps then hold that text.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null doc_id and rows that repeat one are documents of
their own; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.bpe import SPACE, byte_symbols, vocabulary_path
from lodewell.llm.common import materialize

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Code points of a chunk, and of a text whose chunks are dealt over tasks.
CHUNK, LONG = 1 << 16, 1 << 20
#: Words and transitions remembered by a worker before its memory starts afresh.
MEMO, TRANSITIONS = 150_000, 1_500_000
LETTER, NUMBER = r"\p{L}", r"\p{N}"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Outer states; runs are of letters, numbers or others. Pending inner states are (state, count).
BOUNDARY, RUN, WHITE, APOSTROPHE = "boundary", "run", "white", "apostrophe"
START = (BOUNDARY,)


class Machine(dict):
    """Maps a pre-token to its number of tokens; the transitions are compiled lazily."""

    def __init__(self, path: str) -> None:
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model, back = spec["model"], {s: b for b, s in enumerate(byte_symbols())}
        raw = {t: bytes(back[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        self.prefixes = {b[:n] for b in self.ids for n in range(1, len(b))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(SPLIT).findall
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.kinds: dict[str, str] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: its suffix, and for each place in it (token that ends there, count there less the count now)
        self.states: list[tuple[bytes, tuple]] = [(b"", ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def merged(self, parts: list[int]) -> list[int]:
        while len(parts) > 1:
            best = min((m[0], i) for i, pair in enumerate(zip(parts, parts[1:])) if (m := self.merge.get(pair, (1 << 60, -1))))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [self.merge[parts[best[1]], parts[best[1] + 1]][1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether right may follow left in an encoding."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            both = self.bytes_of.get(left, b"") + self.bytes_of[right]
            known = self.merged([self.ids[both[i : i + 1]] for i in range(len(both))]) == ([left, right] if left >= 0 else [right])
            if len(self.fits) >= TRANSITIONS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, change of the count)."""
        suffix, places = self.states[state]
        text = suffix + bytes([byte])
        for start in range(len(text)):
            token = self.ids.get(text[start:])
            if token is not None and self.fit(places[start][0], token):
                delta = places[start][1] + 1
                break
        else:
            raise ValueError("the vocabulary does not cover this byte")
        cut = next(i for i in range(len(text) + 1) if i == len(text) or text[i:] in self.prefixes)
        moved = tuple((t, c - delta) for t, c in places[cut:]) + ((token, 0),)
        there = (text[cut:], moved)
        n = self.number.get(there)
        if n is None:
            n = self.number[there] = len(self.states)
            self.states.append(there)
        found = self.next[state << 8 | byte] = (n, delta)
        return found

    def __missing__(self, piece: str) -> int:
        if len(self.next) >= TRANSITIONS:
            self.reset()
        state = count = 0
        look = self.next.get
        for byte in piece.encode():
            step = look(state << 8 | byte) or self.compile(state, byte)
            state = step[0]
            count += step[1]
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without cuts; special strings count one each."""
        if self.special and any(s in text for s in self.special):
            pieces = self.find_special.split(text)
            return len(pieces) - 1 + sum(map(self.plain_run, pieces))
        return self.plain_run(text)

    def plain_run(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)))

    def feed(self, inner: tuple, text: str) -> tuple:
        """The inner state and count after more bytes. States are held by what they are, as their numbers are a worker's own."""
        what, count = inner
        state = self.number.get(what)
        if state is None:
            state = self.number[what] = len(self.states)
            self.states.append(what)
        for byte in text.encode():
            state, delta = self.next.get(state << 8 | byte) or self.compile(state, byte)
            count += delta
        return self.states[state], count

    def kind(self, c: str) -> str:
        found = self.kinds.get(c)
        if found is None:
            found = self.kinds[c] = next((k for k, one in _KINDS if one.match(c)), "other")
        return found

    def opened(self, c: str) -> tuple:
        """The state after the first character of a word."""
        if (kind := self.kind(c)) == "space":
            return (WHITE, _NOTHING, self.feed(_NOTHING, c), c)
        return (APOSTROPHE, "") if c == "'" else (RUN, kind, self.feed(_NOTHING, c))

    def step(self, state: tuple, c: str) -> tuple[int, tuple]:
        """The outer machine's transition on a character: (tokens of what is closed by it, next state)."""
        if state[0] == APOSTROPHE:
            held = state[1]
            if held + c in CONTRACTIONS:
                return self["'" + held + c], START
            if any(x.startswith(held + c) for x in CONTRACTIONS):
                return 0, (APOSTROPHE, held + c)
            if not held:
                return self.step((RUN, "other", self.feed(_NOTHING, "'")), c)
            n, after = self.step((RUN, "letter", self.feed(_NOTHING, held)), c)
            return self["'"] + n, after
        if state[0] == RUN:
            if self.kind(c) == state[1]:
                return 0, (RUN, state[1], self.feed(state[2], c))
            return state[2][1], self.opened(c)
        if state[0] == WHITE:
            _, before, whole, last = state
            if self.kind(c) == "space":
                return 0, (WHITE, whole, self.feed(whole, c), c)
            if last == " ":  # the last blank of a run begins the next word
                return before[1], (RUN, self.kind(c), self.feed(_NOTHING, " " + c))
            return before[1] + self[last], self.opened(c)
        return 0, self.opened(c)

    def flush(self, state: tuple) -> int:
        """Tokens of what is pending where a text or a word ends."""
        if state[0] == APOSTROPHE:
            return self["'"] + (self[state[1]] if state[1] else 0)
        return 0 if state[0] == BOUNDARY else state[2][1]

    def read(self, state: tuple, text: str) -> tuple[int, tuple]:
        count = 0
        if len(self.next) >= TRANSITIONS:
            self.reset()
        for c in text:
            n, state = self.step(state, c)
            count += n
        return count, state

    def chunk_map(self, text: str) -> tuple:
        """(head, count, exit): from any entry state, what the head makes of it is closed, and count and exit's tokens follow.

        Without a closing place count is None, and the map is the head alone.
        """
        white, special = _SYNC.search(text), self.find_special.search(text) if self.find_special else None
        if not white and not special:
            return (text, None, None)
        first = min(m for m in (white and white.start() + 1, special and special.start()) if m is not None)
        last = max(0 if not white else _LAST_SYNC.search(text).start() + 1, max((m.end() for m in self.find_special.finditer(text)), default=0) if special else 0)
        return (text[:first], self.plain(text[first:last]), self.read(START, text[last:]))

    def apply(self, chunk: tuple, state: tuple) -> tuple[int, tuple]:
        """What a map makes of an entry state: (tokens emitted, exit state)."""
        head, count, leave = chunk
        n, state = self.read(state, head)
        return (n, state) if count is None else (n + self.flush(state) + count + leave[0], leave[1])

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if left[1] is None:
            return (left[0] + right[0], right[1], right[2])
        n, state = self.apply(right, left[2][1])
        return (left[0], left[1], (left[2][0] + n, state))

    def scan(self, maps: list[tuple]) -> int:
        """The tokens of a text from the maps of its chunks, composed in pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        n, state = self.apply(maps[0], START)
        return n + self.flush(state)

    def chunks(self, text: str) -> list[str]:
        """A text in parts of CHUNK code points, or a few more where a special string would be cut."""
        cuts, most = [0], max(map(len, self.special), default=1)
        while len(text) - cuts[-1] > CHUNK:
            at = cuts[-1] + CHUNK
            near = self.find_special.finditer(text, max(cuts[-1], at - most + 1), at + most - 1) if self.find_special else ()
            cuts.append(next((m.end() for m in near if m.start() < at < m.end()), at))
        return [text[x:y] for x, y in zip(cuts, [*cuts[1:], len(text)])]

    def count(self, text: str) -> int:
        return self.scan(list(map(self.chunk_map, self.chunks(text))))


#: The inner machine before any byte.
_NOTHING = ((b"", ((-1, 0),)), 0)
_KINDS = [("space", regex.compile(f"[{SPACE}]")), ("letter", regex.compile(f"[{LETTER}]")), ("number", regex.compile(f"[{NUMBER}]"))]
_SYNC = regex.compile(rf"[^{SPACE}](?=[{SPACE}])")
_LAST_SYNC = regex.compile(rf"(?r)[^{SPACE}](?=[{SPACE}])")
_LOADED: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    if path not in _LOADED:
        _LOADED[path] = Machine(vocabulary_path(path))
    return _LOADED[path]


_COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, home bigint, place int, text string"


def _rows(path: str):
    """A row with its count for each text, or one for each chunk of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(text.encode()) if text else 0
                if len(text or "") <= LONG:
                    rows.append((doc, size, m.count(text) if text else 0, None, None, None))
                    continue
                home = int.from_bytes(os.urandom(8), "little", signed=True)
                rows += [(doc, size, None, home, i, part) for i, part in enumerate(m.chunks(text))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _COUNTED.replace(",", "").split()[::2])

    return run


def _maps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            made = [pickle.dumps(m.chunk_map(text)) for text in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], ["doc_id", "n_bytes", "home", "place", "map"])

    return run


def _scan(path: str):
    def run(t: pa.Table) -> pa.Table:
        made = [x for _, x in sorted(zip(t.column("place").to_pylist(), t.column("map").to_pylist()))]
        return pa.table({"doc_id": t.column("doc_id")[:1], "n_bytes": t.column("n_bytes")[:1], "n_tokens": pa.array([machine(path).scan(list(map(pickle.loads, made)))], pa.int64())})

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over the limit, of every whole text."""
    counted = materialize(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(_rows(vocabulary), _COUNTED), "token-counts")
    out = ("doc_id", "n_bytes", "n_tokens")
    chunks = counted.filter("home IS NOT NULL").select("doc_id", "n_bytes", "home", "place", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps = chunks.repartition(parts, "home", "place").mapInArrow(_maps(vocabulary), "doc_id bigint, n_bytes bigint, home bigint, place int, map binary")
    whole = counted.filter("home IS NULL").select(*out).unionByName(maps.groupBy("home").applyInArrow(_scan(vocabulary), "doc_id bigint, n_bytes bigint, n_tokens bigint"))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
