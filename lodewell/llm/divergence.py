"""How far apart the sources of each language are, in words: sums over all terms, from an inverted index with a baseline.

Each language keeps the V terms that at least MIN_DOCS of its documents hold. A group (language, source) and the language
as a whole give a kept term with ``count`` occurrences of N the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two
shares differ by f(p, q) = floor((p - q)^2 / (p + q)).

Two sources differ by the sum of f over all V terms, most of which neither of them may hold. So every pair starts at V
times f of two zero counts, and the index corrects that:

* a posting (term, source, count) corrects each pair of its source by f(count, 0) - f(0, 0). Postings of a source with the
  same count give the same correction, so they are folded to one row with their number before they meet other sources;
* two postings of one term correct their pair by what is then still wrong, f(a, b) - f(a, 0) - f(0, b) + f(0, 0).

Only corrections other than zero are summed, in partial sums before the shuffle. Work is the number of posting pairs of a
term, and results are pairs of sources: neither grows with the length of texts or the number of documents. Everything is
integer arithmetic; a count above 9 * 10^9 is multiplied in DECIMAL.

Each row is a document. Null text, language and source count as ''. A group without a term, or a language that keeps none,
gives its pairs all the same (0 where V is 0). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.common import materialize, texts

MIN_DOCS, TOP = 10, 10
#: Bytes of letters: A to Z, a to z and all of what is not ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries that a task counts before it gives them out, and bytes of a text whose terms may be held as a list.
ENTRIES, LISTED = 250_000, 1 << 20


def _count(batches: Iterator) -> Iterator:
    """(lang, source, term, n, docs), summed within a task as far as ENTRIES go; a row without a term for each group."""
    import pyarrow as pa

    groups: dict = {}  # (lang, source): occurrences and documents of its terms

    def given(key):
        n, docs = groups[key]
        lang, source = (pa.scalar(x, pa.binary()).cast(pa.string()) for x in key)
        rows = len(n) + 1
        columns = [pa.repeat(lang, rows), pa.repeat(source, rows), pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    entries = 0
    for batch in batches:
        lang, source, text = (texts(batch.column(c)) for c in ("lang", "source", "text"))
        for *key, t in zip(lang, source, text, strict=True):
            n, docs = groups.setdefault(tuple(key), (Counter(), Counter()))
            before = len(n)
            if len(t) <= LISTED:
                found = TERM.findall(t.lower())
                n.update(found)
                docs.update(set(found))
            else:
                found = Counter(m.group().lower() for m in TERM.finditer(t))
                n.update(found)
                docs.update(found.keys())
            entries += len(n) - before
            if entries + len(groups) >= ENTRIES:
                yield from map(given, groups)
                groups.clear()
                entries = 0
    yield from map(given, groups)


def counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term in each (lang, source); term null and 0 for every group that occurs."""
    part = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count among n occurrences of v kept terms."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """f of two shares, which are at most 10^9 + 1, so that the square fits a BIGINT."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and its top terms.

    Part ``pair`` ranks the other sources by their distance, largest first. Part ``term`` ranks the kept terms that the
    source holds with a larger share than its language does, by f of the two shares, and keeps ``top`` of them.
    """
    every = materialize(counts(docs), "divergence-counts")
    held = every.filter(F.col("term").isNotNull())
    kept = materialize(held.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    postings = materialize(held.drop("docs").join(kept, ["lang", "term"]), "divergence-postings")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = every.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v")))
    groups = materialize(groups.na.fill(0, ["group_n", "v", "lang_n"]).withColumn("p0", zero), "divergence-groups")

    return _pairs(groups, postings).unionByName(_terms(groups, postings, top))


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    left = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v", F.col("group_n").alias("a_n"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"), F.col("group_n").alias("b_n"))
    p = lambda side, n: share(F.col(n), F.col(f"{side}_n"), F.col("v"))
    base = gap(F.col("a0"), F.col("b0"))

    start = left.join(right, "lang").filter("a <> b").select("lang", "a", "b", F.coalesce(F.col("v") * base, F.lit(0)).alias("value"))

    folded = postings.groupBy("lang", F.col("source").alias("a"), "n").agg(F.count(F.lit(1)).alias("times"))
    near = folded.join(left, ["lang", "a"]).withColumn("pa", p("a", "n")).join(right, "lang").filter("a <> b")
    one = near.select("lang", "a", "b", (F.col("times") * (gap(F.col("pa"), F.col("b0")) - base)).alias("value")).filter("value <> 0")
    one = one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    other = one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")

    mine = postings.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na")).join(left, ["lang", "a"]).withColumn("pa", p("a", "na"))
    his = postings.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb")).join(right.join(left.select("lang", "v").distinct(), "lang"), ["lang", "b"])
    mine = mine.select("lang", "term", "a", "a0", "pa")
    his = his.select("lang", "term", "b", "b0", p("b", "nb").alias("pb"))
    still = gap(F.col("pa"), F.col("pb")) - gap(F.col("pa"), F.col("b0")) - gap(F.col("a0"), F.col("pb")) + base
    two = mine.join(his, ["lang", "term"]).filter("a < b").select("lang", "a", "b", still.alias("value")).filter("value <> 0")
    two = materialize(two.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-two")
    back = two.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")

    summed = start.unionByName(one).unionByName(other).unionByName(two).unionByName(back).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), "b")
    return summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))


def _terms(groups: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    found = postings.join(groups, ["lang", "source"])
    found = found.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v"))).withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("v"))).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top)
