"""Language ID by prediction by partial matching over bytes.

For each language a context tree of orders 0 to ORDER holds how often each byte followed each context. The statistics
are frozen after training. The code length of a byte is that of PPM with escape method C: in the longest context seen,
count / (total + distinct), or the escape, distinct / (total + distinct), and then the next shorter context; order -1
is uniform over 256 bytes. The language with the shortest code for the whole text wins.

Since frozen statistics make a byte's cost a function of its last ORDER + 1 bytes, a text is scored by table look-ups
over n-grams, in blocks of BLOCK bytes, and a text of any length is scored to its end.

Training reads a bounded sample: about ``sample_docs`` labelled documents of each language, drawn by hash of the id.

Defined results: a null text or one without a letter is "und" with score 0, as is every text if nothing could be
learned; equal code lengths go to the first language in order; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.common import crc_mod, texts

ORDER, SAMPLE_DOCS, BLOCK = 3, 600, 1 << 20
UND = "und"


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as one integer; a text begins after zero bytes."""
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _lowered(text: bytes) -> np.ndarray:
    return np.frombuffer(text.lower(), np.uint8)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                keys, n = np.unique(grams(_lowered(text), order), return_counts=True)
                total.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), n.tolist())))
        for lang, found in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    return run


class Trees:
    """The frozen statistics of all languages as sorted n-gram tables, one pair of tables an order."""

    def __init__(self, counts: dict[str, dict[int, int]], order: int) -> None:
        self.langs, self.order = sorted(counts), order
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lower = None
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            seen = []
            for lang in self.langs:
                g = np.fromiter(counts[lang], np.uint64, len(counts[lang])) & mask
                n = np.fromiter(counts[lang].values(), np.float64, len(counts[lang]))
                keys, at = np.unique(g, return_inverse=True)
                seen.append((keys, np.bincount(at, n, len(keys))))
            keys = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.empty((len(keys), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            for j, (g, n) in enumerate(seen):
                at = np.searchsorted(contexts, g >> np.uint64(8))
                total, distinct = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(distinct[known] / (total + distinct)[known])
                below = np.full(len(keys), 8.0) if lower is None else lower(keys & (mask >> np.uint64(8)))[:, j]
                cost[:, j] = escape[np.searchsorted(contexts, keys >> np.uint64(8)), j] + below
                cost[np.searchsorted(keys, g), j] = -np.log2(n / (total + distinct)[at])
            self.tables.append((keys, cost.astype(np.float32), contexts, escape.astype(np.float32)))
            lower = lambda g, k=k: self.costs(g, k)

    def costs(self, g: np.ndarray, k: int) -> np.ndarray:
        """Code lengths in bits of the last byte of each n-gram after its k bytes of context, for every language."""
        if k < 0:
            return np.full((len(g), len(self.langs)), 8.0, np.float32)
        keys, cost, contexts, escape = self.tables[k]
        if not len(keys):
            return np.full((len(g), len(self.langs)), 8.0, np.float32)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        out = cost[at]
        miss = np.flatnonzero(keys[at] != g)
        if len(miss):
            left = g[miss]
            ctx = left >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            esc = np.where((contexts[c] == ctx)[:, None], escape[c], np.float32(0))
            out[miss] = esc + self.costs(left & np.uint64((1 << 8 * k) - 1), k - 1)
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Summed over the texts that end at ``ends`` in data, each begun anew."""
        total = np.zeros((len(ends), len(self.langs)))
        starts = np.append(0, ends[:-1])
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            back = min(a, self.order)
            g = grams(data[a - back : b], self.order)[back:]
            first = np.searchsorted(starts, a)
            for s in starts[first : np.searchsorted(starts, b)]:
                for k in range(min(self.order, b - s)):  # contexts do not reach into the text before
                    if a <= s + k < b:
                        g[s + k - a] &= np.uint64((1 << 8 * (k + 1)) - 1)
            if back and a not in starts:
                s = starts[np.searchsorted(starts, a) - 1]
                for k in range(int(a - s), self.order):
                    if k < b - s and s + k >= a:
                        g[s + k - a] &= np.uint64((1 << 8 * (k + 1)) - 1)
            # n-grams of a block repeat: each is priced once
            uniq, at = np.unique(g.astype(np.uint32) if self.order <= 3 else g, return_inverse=True)
            price = self.costs(uniq.astype(np.uint64), self.order)
            doc = np.searchsorted(ends, np.arange(a, b), side="right")
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(doc, price[at, j].astype(np.float64), len(ends))
        return total


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))




_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Trees:
    """Trees from text and lang of the documents given; about sample_docs of each language are read."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Trees({}, order)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < rate[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_count(order), "lang string, gram bigint, n bigint")
    counts: dict[str, dict[int, int]] = {}
    # n-grams of the bounded sample, not of the corpus
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Trees(counts, order)


def _judged(model: Trees, column) -> tuple[list, list, list]:
    """Languages, scores and bits a byte of a column of texts."""
    rows = texts(column)
    scored = [t if model.langs and has_letter(t) else b"" for t in rows]
    langs, scores, rate = [], [], []
    if model.langs:
        bits = model.code_lengths(_lowered(b"".join(scored)), np.cumsum([len(t) for t in scored]))
    for i, text in enumerate(scored):
        if not text:
            langs.append(UND)
            scores.append(0.0)
            rate.append(None)
            continue
        best = int(np.argmin(bits[i]))
        langs.append(model.langs[best])
        scores.append(float(1.0 / np.sum(np.exp2(np.maximum(bits[i][best] - bits[i], -1000)))))
        rate.append(float(bits[i][best] / len(text)))
    return langs, scores, rate


def _predict(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rate = _judged(trees.value, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rate, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return run


def predict(docs: DataFrame, trees: Trees, fold: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the language under equal priors), bits_per_byte."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod("doc_id", fold) == 0).alias("held_out"), F.col("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample
    return rows.mapInArrow(_predict(shipped), "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, fold: int = 5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Predictions for all documents by trees learned from those outside the held-out fold."""
    return predict(docs, learn(docs.filter(crc_mod("doc_id", fold) != 0), sample_docs), fold)


def drop_unidentified(docs: DataFrame, fold: int = 5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents whose language the trees tell: all but "und", however short or close the call."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(crc_mod("doc_id", fold) != 0), sample_docs))

    def sure(column: pa.Array) -> pa.Array:
        langs, _, _ = _judged(shipped.value, column)
        return pa.array([lang != UND for lang in langs], pa.bool_())

    return docs.filter(F.arrow_udf(sure, "boolean")("text"))
