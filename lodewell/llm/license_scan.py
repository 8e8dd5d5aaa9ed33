"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

The blocks of a template are all windows of SLACK times its number of words, one at every word of a text. A template
matches a block that holds at least ``threshold`` of the template's distinct words; a template of ORDERED words at most
must also be found in order, as a common subsequence of as large a share. Template words are ordered by how often the
corpus uses them, rarest first. If a block may lack s words of a template, it must hold one of the first s + 1 (prefix
filter), so only windows around such words are looked at; a text of fewer words than are needed has no block (length
filter); and of the first 2 s + 1 places every one without its word costs one of the s, so s + 1 of them must be filled
(positional filter). What passes is counted exactly by one sweep over the template's words, so every match is found, in
time linear in the text.

Defined results: null and empty texts have no words and no labels; a null doc_id and rows that repeat one are documents
of their own; other columns are ignored; an empty table gives none. The templates are a fixed list of a few lines, so
they travel with the code.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.common import texts

#: Phrases that are looked for word by word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Texts of common licenses, paragraph by paragraph, and of their notices, with their labels.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

THRESHOLD, SLACK, ORDERED = 0.9, 1.25, 12

_WORDS = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORDS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORDS[_c] = _c + 32
_WORDS = bytes(_WORDS)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def share(threshold: float, n: int) -> int:
    """The least whole number that is ``threshold`` of n."""
    return math.ceil(threshold * n - 1e-9)


def in_order(template: list[bytes], block: list[bytes]) -> int:
    """The length of the longest common subsequence."""
    row = [0] * (len(template) + 1)
    for word in block:
        left = 0
        for i, own in enumerate(template, 1):
            left, row[i] = row[i], left + 1 if own == word else max(row[i], row[i - 1])
    return row[-1]


class Template:
    """A label's words, its blocks' width, and its distinct words by rising frequency."""

    def __init__(self, label: str, text: str, frequency: dict[bytes, int], threshold: float) -> None:
        self.label, self.words = label, text.encode().split()
        self.width = math.ceil(SLACK * len(self.words))
        self.order = sorted(set(self.words), key=lambda w: (frequency.get(w, 0), w))
        self.need = share(threshold, len(self.order))
        spare = len(self.order) - self.need
        self.tokens, self.filled = frozenset(self.order), spare + 1
        self.prefix, self.places = frozenset(self.order[: spare + 1]), frozenset(self.order[: 2 * spare + 1])
        self.ordered = share(threshold, len(self.words)) if len(self.words) <= ORDERED else 0

    def match(self, words: list[bytes], hits: list[int]) -> tuple[int, int] | None:
        """(words shared, start) of the best block around the places of prefix words, the first of equals."""
        best, at = None, 0
        while at < len(hits):
            end = at
            while end + 1 < len(hits) and hits[end + 1] - hits[end] < 2 * self.width:
                end += 1
            a, b = max(0, hits[at] - self.width + 1), min(len(words), hits[end] + self.width)
            at = end + 1
            own = [i for i in range(a, b) if words[i] in self.tokens]
            if len({words[i] for i in own} & self.places) < min(self.filled, len(self.places)):
                continue
            found = self.sweep(words, own, best[0] + 1 if best else self.need)
            best = found or best
        return best

    def sweep(self, words: list[bytes], own: list[int], least: int) -> tuple[int, int] | None:
        """The best block among those that begin at a word of the template, which no other block exceeds."""
        best, end, held = None, 0, Counter()
        for start in own:
            while end < len(own) and own[end] < start + self.width:
                held[words[own[end]]] += 1
                end += 1
            if len(held) >= least and (not self.ordered or in_order(self.words, words[start : start + self.width]) >= self.ordered):
                best, least = (len(held), start), len(held) + 1
            held[words[start]] -= 1
            if not held[words[start]]:
                del held[words[start]]
        return best


class Matcher:
    """The templates with the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> None:
        self.templates = [Template(label, text, frequency, threshold) for label, text in templates]
        self.index: dict[bytes, list[int]] = {}
        for n, t in enumerate(self.templates):
            for w in t.prefix:
                self.index.setdefault(w, []).append(n)

    def blocks(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """Label to (best containment, start of the first such block)."""
        index, found, hits = self.index, {}, {}
        for i, w in enumerate(words):
            if w in index:
                for n in index[w]:
                    hits.setdefault(n, []).append(i)
        for n, at in sorted(hits.items()):
            t = self.templates[n]
            if len(words) < t.need or not (best := t.match(words, at)):
                continue
            if best[0] / len(t.order) > found.get(t.label, (0.0, 0))[0]:
                found[t.label] = (best[0] / len(t.order), best[1])
        return found


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place of every phrase."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at, last, n = line.find(needle), 0, 0
        while at >= 0:
            n += line.count(b" ", last, at)
            found.append((n, label))
            last, at = at, line.find(needle, at + 1)
    return found


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                counts.update([w for w in words_of(text) if w in vocabulary])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _rows(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in texts(batch.column(1)):
                words = words_of(text)
                base, blocks = base_places(words), matcher.blocks(words)
                own = {label for _, label in base}
                starts = [at for at, _ in base]
                row = (
                    len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | blocks.keys())),
                    1.0 if base else max((s for s, _ in blocks.values()), default=0.0),
                    [{"label": k, "containment": s, "start": at} for k, (s, at) in sorted(blocks.items())],
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _BLOCKS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    return run


_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("start", pa.int64())]))
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "blocks array<struct<label: string, containment: double, start: bigint>>"
)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base phrases and matched blocks of every whole text; score is 1 with a base phrase, else the best containment."""
    vocabulary = frozenset(w.encode() for _, text in templates for w in text.split())
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "word binary, n bigint")
    # one row for each template word
    frequency = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(_rows(Matcher(templates, frequency, threshold)), SCHEMA)
