"""BPE encoding and decoding for the word_bpe vocabulary family, by a contiguous rank array.

A word is held as its part boundaries (as ids of the parts between them) and the ranks of adjacent parts in one flat
array. The smallest rank is found by a scan, its boundary deleted, and only the two neighbouring ranks are looked up
anew. Words of more than LONG parts, for which repeated scans would be quadratic, keep the same ranks in a heap.
Results of words are remembered per Python worker, MEMO words and the MEMO before them.

Letters and capitals of the latest Unicode versions are pinned to the library's tables (UNASSIGNED, CAPITALS), whatever
those of Python and of the regex module say; a test sweeps all code points.

Defined results: null and empty texts have no tokens; a null doc_id and rows that repeat one are documents of their own;
any other column is ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "word_bpe_49k.json"
LONG, MEMO = 256, 150_000
#: Bits of an id in the keys and values of the merge table, and what stands for no merge.
BITS, MASK, NONE = 20, (1 << 20) - 1, 1 << 62
#: White space as the Unicode property has it, which differs from Python's \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str) -> str:
    """The vocabulary files' place is that of the public_tokenizers package; a path given in full is used as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) if b in plain else "" for b in range(256)]
    for n, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + n)
    return out


#: Code points that the regex module's tables have as letters or numbers, but not the library's.
UNASSIGNED = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 "
    "1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals that Python's tables may not know yet, as (first, last, small letter of the first).
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_LOWER = {a + i: small + i for a, z, small in CAPITALS for i in range(z - a + 1)}
#: Texts without one of these, the least code point of the tables above, need none of them.
_LATE = re.compile("[\u0558-\U0010FFFF]").search


class WordBpe(dict):
    """Maps a word to (ids joined by spaces, tokens joined by spaces, number of ids), computed when first asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.before: dict[str, tuple[str, str, int]] = {}
        # by (left << BITS | right): rank << BITS | merged
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge.setdefault(self.vocab[a] << BITS | self.vocab[b], rank << BITS | self.vocab[a + b])
        symbols = byte_symbols()
        self.inner, self.last = ([self.vocab[c + end] for c in symbols] for end in ("", self.end))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        pattern = pattern.replace(r"\s", SPACE)
        free = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in UNASSIGNED.split())
        self.words, self.has_unassigned = regex.compile(pattern).findall, re.compile(f"[{free}]").search
        for c in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(c, f"[{c}--[{free}]]")
        self.words_unassigned = regex.compile(pattern, regex.V1).findall

    def __missing__(self, word: str) -> tuple[str, str, int]:
        if (found := self.before.get(word)) is None:
            ids = self.encode_word(word)
            found = " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        parts = list(map(self.inner.__getitem__, raw))
        parts[-1] = self.last[raw[-1]]
        return self.by_rank_array(parts) if len(parts) <= LONG else self.by_heap(parts)

    def by_rank_array(self, parts: list[int]) -> list[int]:
        find = self.merge.get
        ranks = [find(a << BITS | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1] << BITS | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = find(parts[i] << BITS | parts[i + 1], NONE)
        return parts

    def by_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merge.get(parts[i] << BITS | parts[after[i]])) is not None:
                heapq.heappush(heap, (m, i, parts[i], parts[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else -1
            if j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = m & MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[tuple[str, str, int]]:
        """One entry for each word or special token of a text."""
        found: list[tuple[str, str, int]] = []
        for piece in self.split_special.split(text) if self.split_special and "<|" in text else (text,):
            if (i := self.special.get(piece)) is not None:
                found.append((str(i), piece, 1))
            elif piece:
                text = normalize(piece)
                words = self.words_unassigned if not text.isascii() and _LATE(text) and self.has_unassigned(text) else self.words
                found += map(self.__getitem__, words(text))
        return found


def normalize(text: str) -> str:
    """NFC, then lower case letter by letter: a final capital sigma becomes the plain small one."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return (text.translate(_LOWER) if _LATE(text) else text).lower()


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The worker's one copy."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(vocabulary_path(path))
    return _LOADED[path]


SCHEMA = "doc_id bigint, ids string, decoded string, n_tokens bigint"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _rows(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids, decoded, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = bpe.encode(text) if text else []
                one, two, n = map(list, zip(*found)) if found else ([], [], [])
                one, two = " ".join(one), " ".join(two)
                counts.append(sum(n))
                ids.append(hashlib.sha256(one.encode()).hexdigest() if digest else one)
                decoded.append(hashlib.sha256(two.encode()).hexdigest() if digest else two)
            doc, n, a, b = batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays([doc, n, a, b], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) if digest else pa.RecordBatch.from_arrays(
                [doc, a, b, n], ["doc_id", "ids", "decoded", "n_tokens"]
            )

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, digest: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text; with digest, their SHA-256 in hexadecimal instead."""
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(_rows(vocabulary, digest), DIGEST if digest else SCHEMA)
