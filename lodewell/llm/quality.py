"""Quality rules by distribution divergence, in DataFrame functions throughout.

Each text gives a histogram over character classes and, for each language, one over the language's common words and
the rest. A language has a reference if LEAST_DOCS documents or more name it. Its common words are the TOP most frequent
ones with a letter and its reference the summed histograms, both over all its documents in the whole corpus. A
document's verdict rests on its smallest Jensen-Shannon distance to any reference: a document fails if its characters
or its words are farther from every language than the limits, where it is long enough to tell. A document that names a
language without a reference is not held to the word limit.

Repeated windows are found inside the row: hashes of five-word windows are compared by a distinct count, and only a
text that repeats one sorts its hashes to mark the words that repeats cover. Small letters and white space are taken out
of a text once, and the character classes are counted in what is left. Nothing but per-language sums and each task's
counts of its words is shuffled.

Defined results: null and empty texts have no words and fail the base rule; documents without a language add to no
reference; without any reference the verdict is the base rule's; a null doc_id and rows that repeat one are documents of
their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.common import materialize

TOP, LEAST_DOCS = 16, 20
MIN_WORDS, MIN_CHARS, CHAR_LIMIT, WORD_LIMIT = 60, 200, 0.3, 0.285
WINDOW = 5
_GAP = r"[\x20\x09-\x0D]+"
#: Capitals, digits, ASCII punctuation, symbols, other scripts' and accented characters; the rest is the sixth class.
CLASSES = ["[A-Z]", "[0-9]", """[!"'(),\\-./:;?]""", r"[#*$%&|<>+=@\[\]\\^_`{}~]", r"[^\x00-\x7F]"]


def _marked(pairs: Column) -> Column:
    """The number of words that repeated windows cover, from (hash, start) of all windows in order."""
    none = F.array(F.lit(None).cast(_PAIR))
    beside = F.arrays_zip(pairs.alias("a"), F.concat(none, pairs).alias("b"), F.concat(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), none).alias("c"))
    # starts of windows whose hash equals a neighbour's in sorted order
    dup = F.filter(beside, lambda z: z["a"].isNotNull() & ((z["a"]["h"] == z["b"]["h"]).eqNullSafe(True) | (z["a"]["h"] == z["c"]["h"]).eqNullSafe(True)))
    return F.aggregate(
        F.sort_array(F.transform(dup, lambda z: z["a"]["i"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), s["end"] - i)).cast("bigint").alias("n"), (i + F.lit(WINDOW)).alias("end")),
        lambda s: s["n"],
    )


_PAIR = "struct<h: bigint, i: int>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def common_words(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> dict[str, list[str]]:
    """The most frequent words of each language that enough documents name, in all its documents, ties in the order of code points."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs).collect()}  # a row a language
    if not sizes:
        return {}
    named = known.filter(F.col("lang").isin(list(sizes)))
    counted = named.select("lang", F.explode(_words(F.coalesce("text", F.lit("")))).alias("word")).filter(~F.col("word").rlike(r"^[\x00-\x40\x5B-\x60\x7B-\x7F]*$"))
    counted = counted.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in counted.filter("n >= 2").withColumn("place", place).filter(F.col("place") <= top).orderBy("lang", "place").collect():
        out[r["lang"]].append(r["word"])
    return out


def features(docs: DataFrame, common: list[str]) -> DataFrame:
    """One row a document: the base measures, chars (class histogram) and words (counts of the common words)."""
    zero = F.lit(0).cast("bigint")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        "lang",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "").alias("left"),
    )
    many = F.size("words") >= WINDOW
    at = lambda i: F.xxhash64(*[F.col("word_hashes")[i + k] for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), at)
    split = split.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashed = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("left", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.array(*[F.regexp_count("left", F.lit(c)).cast("bigint") for c in CLASSES]).alias("classes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(many, windows).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
        F.filter("words", lambda w: w.isin(common) if common else F.lit(False)).alias("common"),
    )
    seen = F.transform(F.array_distinct("common"), lambda w: F.struct(w, F.size(F.filter("common", lambda x: x == w)).cast("bigint")))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    hashed = hashed.withColumns({"counts": F.map_from_entries(seen), "repeats": repeats})
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("pairs", F.when(F.col("repeats"), pairs)).drop("hashes", "common")
    counts = F.array(*[F.coalesce(F.col("counts")[w], zero) for w in common]).cast("array<bigint>")
    rest = F.greatest(F.col("word_chars") - F.aggregate("classes", zero, lambda a, b: a + b), F.lit(0))
    return hashed.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("repeats"), _marked(F.col("pairs"))).otherwise(zero).alias("n_repeat_words"),
        F.concat("classes", F.array(rest)).alias("chars"),
        counts.alias("words"),
    )


def references(found: DataFrame, langs: list[str], n_common: int) -> DataFrame:
    """One row for each of the languages: summed histograms of its documents."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(6)] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(n_common)]
    return found.filter(F.col("lang").isin(langs)).groupBy("lang").agg(F.sum("n_words").alias("n_words"), *sums)


def shares(counts: list[int]) -> list[float]:
    """Relative frequencies, with half a count added so that no bin is empty."""
    total = sum(counts) + 0.5 * len(counts)
    return [(c + 0.5) / total for c in counts]


def _divergence(counts: Column, total: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance (root of the divergence in bits) of a histogram from a reference."""
    term = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    parts = F.zip_with(
        counts, F.array(*map(F.lit, reference)), lambda c, q: term(c / F.greatest(total, F.lit(1)), q) + q * F.log2(2 * q / (c / F.greatest(total, F.lit(1)) + q))
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2))


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The features, base_failed, the smallest distances to any language's reference, and kept."""
    common = common_words(docs)
    words = sorted({w for ws in common.values() for w in ws})
    found = materialize(features(docs, words), "quality-features")
    refs = {r["lang"]: r for r in references(found, list(common), len(words)).collect()} if common else {}  # a row a language
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    char_distances, word_distances = [], []
    for lang, r in sorted(refs.items()):
        char_distances.append(_divergence(F.col("chars"), F.col("word_chars"), shares([r[f"c{i}"] for i in range(6)])))
        at = [words.index(w) for w in common[lang]]
        own = [r[f"w{i}"] for i in at]
        picked = F.array(*[F.col("words")[i] for i in at]).cast("array<bigint>")
        rest = F.greatest(F.col("n_words") - F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0))
        word_distances.append(_divergence(F.concat(picked, F.array(rest)), F.col("n_words"), shares([*own, r["n_words"] - sum(own)])))
    least = lambda ds: F.array_min(F.array(*ds)) if ds else F.lit(0.0)
    out = found.withColumns({"base_failed": failed, "char_distance": least(char_distances), "word_distance": least(word_distances)})
    foreign = F.col("lang").isNotNull() & ~F.coalesce(F.col("lang").isin(list(refs)), F.lit(False)) if refs else F.lit(False)
    far = (F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > char_limit) | ~foreign & (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > word_limit)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)
