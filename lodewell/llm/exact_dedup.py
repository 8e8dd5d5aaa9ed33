"""Exact dedup by progressive refinement, in DataFrame functions alone.

Texts are told apart by what is cheap first: by length, then by the hash of their first characters, and only texts that
share both with another one have their whole content hashed.

The first scan writes two numbers a text (length and prefix hash). Texts whose length no other text has leave; of the
rest, those with a prefix that no other text of their length has leave. What survives is known to the second scan as a
set of at most SLOTS numbers, hashes of (length, prefix): its size is bounded whatever the tables' sizes, so it is
broadcast and no text is shuffled. A text that meets a survivor's number by chance costs one hash more and nothing else.
Surviving texts are then grouped by SHA-256. A group may hold any share of the rows: its members are counted before the
shuffle, and joined with their group as many_to_one does.

Null counts as the empty text, and so equals it. Every row counts by itself: of rows with equal text and equal doc_id one
stays. A null doc_id is smaller than any other. An empty table gives no rows. Other columns, whatever their names, are
ignored by duplicates() and carried by drop_duplicates().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.common import many_to_one, materialize

#: Characters whose hash is compared before whole texts are.
PREFIX = 256
#: The most numbers by which the second scan knows the survivors.
SLOTS = 1 << 20

_TEXT, _LENGTH, _HEAD, _SLOT, _HIT, _SHA, _RANK = (f"__lodewell_{x}" for x in ("text", "length", "head", "slot", "hit", "sha", "rank"))


def _survivors(texts: DataFrame) -> DataFrame:
    """At most SLOTS numbers, with those of all texts that share length and first characters with another text."""
    signs = materialize(texts.select(F.octet_length(_TEXT).alias(_LENGTH), F.xxhash64(F.substring(_TEXT, 1, PREFIX)).alias(_HEAD)), "exact-signs")
    shared = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    lengths = materialize(shared(signs, _LENGTH), "exact-lengths")
    heads = shared(signs.join(lengths, _LENGTH, "left_semi"), _LENGTH, _HEAD)
    return materialize(heads.select(F.pmod(F.xxhash64(_LENGTH, _HEAD), F.lit(SLOTS)).alias(_SLOT)).distinct(), "exact-slots")


def _marked(docs: DataFrame, digests: bool) -> DataFrame:
    """docs with _HIT (whether an equal text is possible) and _SHA, which other texts have only if digests are asked for."""
    texts = docs.withColumn(_TEXT, F.coalesce(F.col("text"), F.lit("")))
    slots = F.broadcast(_survivors(texts).withColumn(_HIT, F.lit(True)))
    own = F.pmod(F.xxhash64(F.octet_length(_TEXT), F.xxhash64(F.substring(_TEXT, 1, PREFIX))), F.lit(SLOTS))
    found = texts.withColumn(_SLOT, own).join(slots, _SLOT, "left").withColumn(_HIT, F.coalesce(_HIT, F.lit(False)))
    sha = F.sha2(_TEXT, 256)
    return found.withColumn(_SHA, sha if digests else F.when(F.col(_HIT), sha)).drop(_TEXT, _SLOT)


def duplicates(docs: DataFrame, digests: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Of equal texts the row of the largest doc_id stays. text_sha256 is null where the whole text was not read; with
    digests every text is.
    """
    rows = materialize(_marked(docs.select("doc_id", "text"), digests).select(F.monotonically_increasing_id().alias("r"), "doc_id", _HIT, _SHA), "exact-rows")
    hits = rows.filter(_HIT)
    groups = hits.groupBy(_SHA).agg(F.max(F.struct("doc_id", "r")).alias("last"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    together = many_to_one(hits, materialize(groups, "exact-groups"), _SHA, "left")
    single = F.col("last").isNull()
    told = together.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("last.r") == F.col("r"))).alias("kept"),
        F.col(_SHA).alias("text_sha256"),
    )
    alone = rows.filter(~F.col(_HIT)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col(_SHA).alias("text_sha256"))
    return told.unionByName(alone)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those whose text a row of larger doc_id has.

    Rows that no text can equal stay where they are. Of the others each task sends on one row a text, the one of the
    largest doc_id, and of those one stays.
    """
    marked = _marked(docs, False)
    last = Window.partitionBy(_SHA).orderBy(F.col("doc_id").desc_nulls_last())
    kept = marked.filter(_HIT).withColumn(_RANK, F.row_number().over(last)).filter(F.col(_RANK) == 1)
    return kept.select(docs.columns).unionByName(marked.filter(~F.col(_HIT)).select(docs.columns))
