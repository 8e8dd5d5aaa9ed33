"""The registered query of each text operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import bpe, divergence, exact_dedup, langid, license_scan, line_dedup, lm, minhash, mixing, prefix_trie, quality, token_counts, topk
from lodewell.llm.common import bounded_batches, documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), "kept")
    return out.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2(F.col("kept.text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, i, string_split(coalesce(d.text, ''), chr(10))[i] AS line
  FROM documents d, generate_series(1, len(string_split(coalesce(d.text, ''), chr(10)))) AS g(i)),
keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.largest AS dropped
  FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixing.training_order(plan.select("doc_id", "size", "source_size", "target", "taken", "position"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null')) AS draw,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS s,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rnk FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, (SELECT sum(s) FROM totals)::BIGINT AS t FROM totals),
filled AS (
  SELECT *, coalesce(sum(s) OVER (ORDER BY s / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
    sum(w) OVER (ORDER BY s / w DESC, rnk DESC)::BIGINT AS rest_w FROM weighted),
level AS (
  SELECT below AS b, rest_w AS rw FROM filled WHERE w * (3 * t - 4 * below) <= 4 * s * rest_w ORDER BY s / w, rnk LIMIT 1),
plan AS (
  SELECT source AS psource, s, rnk, CASE WHEN w * (3 * t - 4 * b) > 4 * s * rw THEN (2 * s)::DOUBLE
    ELSE (w * (3 * t - 4 * b))::DOUBLE / (2 * rw)::DOUBLE END AS target FROM filled, level),
placed AS (
  SELECT d.*, p.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, floor(target + 0.5)::BIGINT AS words
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.psource),
taking AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE words // s END AS epochs, CASE WHEN rnk % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0,
    off::DOUBLE / target AS x FROM placed),
done AS (
  SELECT *, (epochs * size + greatest(0, least(words - epochs * s - off, size)))::BIGINT AS taken FROM taking)
SELECT doc_id, size, s AS source_size, target, taken,
  CASE WHEN taken > 0 THEN 2 * x / (w0 + sqrt(w0 * w0 + 2 * ((2 - w0) - w0) * x)) END AS position FROM done
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("blocks")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


OP3_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
placed AS MATERIALIZED (SELECT r, u.place, u.word FROM (SELECT r, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'place': i - 1, 'word': ws[i]})) AS u FROM w)),
-- places of phrases
phrases AS (SELECT string_split(phrase, ' ') AS ps, label FROM (VALUES $PHRASES) AS v(phrase, label)),
base AS (SELECT w.r, p.place, label FROM phrases JOIN placed p ON p.word = ps[1] JOIN w ON w.r = p.r WHERE ws[place + 1:place + len(ps)] = ps),
bases AS (SELECT r, count(*)::BIGINT AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY r),
-- windows at template words that hold 0.9 of a template's distinct words; short templates also in order
templates AS (
  SELECT n, label, ts, len(list_distinct(ts)) AS size, ceil(1.25 * len(ts))::BIGINT AS width, ceil(0.9 * len(list_distinct(ts)) - 1e-9)::BIGINT AS need,
    CASE WHEN len(ts) > 12 THEN 0 ELSE ceil(0.9 * len(ts) - 1e-9) END AS ordered FROM (SELECT n, label, string_split(body, ' ') AS ts FROM (VALUES $TEMPLATES) AS v(n, label, body))),
hits AS (SELECT DISTINCT r, n, place, word, size, width, need FROM placed JOIN (SELECT n, size, width, need, unnest(ts) AS word FROM templates) USING (word)),
likely AS (SELECT * FROM hits JOIN (SELECT r, n FROM hits GROUP BY r, n, need HAVING count(DISTINCT word) >= need) USING (r, n)),
held AS (SELECT a.r, a.n, a.place, count(DISTINCT b.word) AS held FROM likely a JOIN likely b ON a.r = b.r AND a.n = b.n AND b.place BETWEEN a.place AND a.place + a.width - 1 GROUP BY a.r, a.n, a.place, a.need HAVING count(DISTINCT b.word) >= a.need),
blocks AS (SELECT held.r, label, held / size::DOUBLE AS containment, ts, ordered, array_to_string(ws[place + 1:place + width], ' ') AS line FROM held JOIN templates USING (n) JOIN w ON w.r = held.r),
fine AS (
  SELECT r, label, containment FROM blocks WHERE ordered = 0 OR regexp_matches(line, '(^| )' || array_to_string(ts, '( .*)? ') || '( |$)')
    OR ordered < len(ts) AND len(list_filter(range(1, len(ts) + 1), lambda i: regexp_matches(line, '(^| )' || array_to_string(list_concat(ts[1:i - 1], ts[i + 1:]), '( .*)? ') || '( |$)'))) > 0),
found AS (SELECT r, list(DISTINCT label) AS more, max(containment) AS best FROM fine GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN bases USING (r) LEFT JOIN found USING (r)
""".replace("$PHRASES", _values(license_scan.PHRASES.items())).replace("$TEMPLATES", _values((n, *t) for n, t in enumerate(license_scan.TEMPLATES)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), digest=True)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir).select("doc_id", "lang", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS MATERIALIZED (
  SELECT r, doc_id, lang, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    [len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[!"''(),\-./:;?]')),
     len(regexp_extract_all(text, '[#*$%&|<>+=@\[\]\\^_`{}~]')), len(regexp_extract_all(text, '[^\x00-\x7F]'))] AS cs FROM w),
-- five-word windows found twice or more, and the words that they cover
win AS (SELECT r, u.i, count(*) OVER (PARTITION BY r, u.k) AS n FROM (SELECT r, unnest(list_transform(range(1, len(ws) - 3), lambda i: {'i': i, 'k': array_to_string(ws[i:i + 4], ' ')})) AS u FROM w)),
covered AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM win, range(5) AS o(j) WHERE n >= 2 GROUP BY r),
-- the languages that have a reference, and their common words
langs AS (SELECT lang, floor(least(1.0::DOUBLE, 2000::DOUBLE / count(*)) * 4294967296)::BIGINT AS rate FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
sampled AS (SELECT lang, unnest(ws) AS word FROM w JOIN langs USING (lang) WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT < rate),
counted AS (SELECT lang, word, count(*) AS n FROM sampled WHERE regexp_matches(word, '[^\x00-\x40\x5B-\x60\x7B-\x7F]') GROUP BY lang, word HAVING count(*) >= 2),
common AS MATERIALIZED (SELECT lang, word FROM counted QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 16),
-- histograms of documents: classes of characters, and words common in each language
chars AS MATERIALIZED (SELECT r, lang, word_chars, b, CASE WHEN b < 6 THEN cs[b] ELSE greatest(word_chars - list_sum(cs), 0) END AS c FROM f, range(1, 7) AS t(b)),
uses AS MATERIALIZED (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(ws) AS word FROM w) WHERE word IN (SELECT word FROM common) GROUP BY r, word),
char_refs AS (SELECT lang, b, (sum(c) + 0.5::DOUBLE) / (sum(sum(c)) OVER (PARTITION BY lang) + 3) AS q FROM chars JOIN langs USING (lang) GROUP BY lang, b),
sizes AS (SELECT lang, sum(n_words) AS n FROM f JOIN langs USING (lang) GROUP BY lang),
own AS (SELECT k.lang, k.word, coalesce(sum(u.c), 0) AS c FROM common k LEFT JOIN (SELECT lang, word, c FROM uses JOIN w USING (r)) u ON u.lang = k.lang AND u.word = k.word GROUP BY k.lang, k.word),
own_all AS (SELECT lang, word, c FROM own UNION ALL SELECT lang, NULL, n - coalesce((SELECT sum(c) FROM own WHERE own.lang = sizes.lang), 0) FROM sizes),
word_refs AS (SELECT lang, word, (c + 0.5::DOUBLE) / (sum(c) OVER (PARTITION BY lang) + 0.5 * count(*) OVER (PARTITION BY lang)) AS q FROM own_all),
picked AS MATERIALIZED (SELECT f.r, f.n_words, k.lang, k.word, coalesce(u.c, 0) AS c FROM f CROSS JOIN common k LEFT JOIN uses u ON u.r = f.r AND u.word = k.word),
words AS (SELECT r, n_words, lang, word, c FROM picked
  UNION ALL SELECT f.r, f.n_words, l.lang, NULL, greatest(f.n_words - coalesce(p.c, 0), 0) FROM f CROSS JOIN langs l LEFT JOIN (SELECT r, lang, sum(c) AS c FROM picked GROUP BY r, lang) p ON p.r = f.r AND p.lang = l.lang),
-- Jensen-Shannon distances to every reference, and the least of them
char_parts AS (SELECT c.r, x.lang, c.c / greatest(c.word_chars, 1)::DOUBLE AS p, x.q FROM chars c JOIN char_refs x USING (b)),
word_parts AS (SELECT c.r, x.lang, c.c / greatest(c.n_words, 1)::DOUBLE AS p, x.q FROM words c JOIN word_refs x ON x.lang = c.lang AND x.word IS NOT DISTINCT FROM c.word),
char_far AS (SELECT r, min(d) AS d FROM (SELECT r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2)) AS d FROM char_parts GROUP BY r, lang) GROUP BY r),
word_far AS (SELECT r, min(d) AS d FROM (SELECT r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2)) AS d FROM word_parts GROUP BY r, lang) GROUP BY r),
judged AS (
  SELECT f.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
    word_chars >= 200 AND coalesce(cf.d, 0) > 0.3 AS char_failed,
    n_words >= 60 AND coalesce(wf.d, 0) > 0.285 AND (lang IS NULL OR lang IN (SELECT lang FROM langs)) AS word_failed
  FROM f LEFT JOIN covered USING (r) LEFT JOIN char_far cf USING (r) LEFT JOIN word_far wf USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT char_failed AND NOT word_failed AS kept FROM judged
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = topk.valid_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk.top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS p,
    sha256(strlen(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
-- crc32, bit by bit, of the id in decimal
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM own),
crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, x: list_reduce(
    list_prepend(xor(c, x), list_transform(range(8), lambda k: 0::BIGINT)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS r FROM ids),
h AS (SELECT conv_id, xor(r, 4294967295) % 4 AS h FROM crc),
rebuilt AS (
  SELECT c.conv_id, o.p AS p, o.digest, o.tokens FROM h c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.p <= c.h
  UNION ALL SELECT c.conv_id, o.p + 4, o.digest, o.tokens FROM h c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.h),
seen AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, tokens, md5(string_agg(digest, ',') OVER w) AS node, lead(1) OVER w IS NULL AS last FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM h),
nodes AS MATERIALIZED (
  SELECT node, any_value(depth)::BIGINT AS depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(tokens) AS tokens, bool_and(last) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM seen GROUP BY node),
parents AS (SELECT DISTINCT a.node, b.node AS up FROM seen a JOIN seen b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
children AS (SELECT up AS node, count(*)::BIGINT AS n_children FROM parents GROUP BY up),
below AS (SELECT DISTINCT a.node, b.node AS at FROM seen a JOIN seen b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT below.node, (count(*) FILTER (WHERE leaf))::BIGINT AS n_leaves, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens FROM below JOIN nodes ON nodes.node = below.at GROUP BY below.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes u ON u.node = p.up
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS all_n FROM kept GROUP BY lang),
cell AS (SELECT grp.lang, grp.source, kept.term, coalesce(t.n, 0)::HUGEINT AS n, kept.n AS lang_n FROM grp JOIN kept USING (lang) LEFT JOIN t ON t.lang = grp.lang AND t.source = grp.source AND t.term = kept.term),
p AS MATERIALIZED (
  SELECT cell.lang, source, term, cell.n, 1 + (1000000000 * (cell.n + 2)) // (sum(cell.n) OVER (PARTITION BY cell.lang, source) + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (all_n + 2 * v) AS q
  FROM cell JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, (count(*) OVER (PARTITION BY text))::BIGINT AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256 FROM d
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_top_k": op10_top_k,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op3_license_scan": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op8_quality_rules": OP8_SQL, "op10_top_k": OP10_SQL,
           "op11_prefix_trie": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_exact_dedup": OP13_SQL}
