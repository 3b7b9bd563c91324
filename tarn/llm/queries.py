"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import table
from tarn.llm import minhash, quality
from tarn.llm.decontamination import leaked_items
from tarn.llm.fingerprints import fingerprint_edits
from tarn.llm.html_text import extract
from tarn.llm.language_model import language_scores
from tarn.llm.merkle import manifest
from tarn.llm.mixing import mix
from tarn.llm.pii import personal_data
from tarn.llm.ranking import search
from tarn.llm.sharding import assign_shards
from tarn.llm.simhash import near_duplicates
from tarn.llm.suffixes import without_repeats


def op1_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_max_scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("first_slot", F.array_min("slots")).drop("slots")


def op4_undisguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_minhash_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_spaced_seed_leaks, op2_max_scoring_text, op3_source_mix, op4_undisguised_pii, op5_suffix_array_dedup, op6_jump_shards, op7_suffix_tree_scores, op8_pu_quality, op9_multiset_fingerprint, op10_simhash_pivots, op11_minhash_postings, op12_merkle_manifest, op13_tput_search)}

ORACLE = {
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS shuffle
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY key = '', key) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY key),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT key, source_size,
         coalesce(least(cap::DOUBLE, w * (SELECT arg_min(level, cap / w) FROM levels WHERE w * level < cap)), cap::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT doc_id, key, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS take,
         CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY shuffle, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized JOIN targets USING (key)),
quotas AS (
  SELECT *, (take // source_size) * blocks + (take % source_size + 1023) // 1024 AS quota
  FROM (SELECT key, source_size, CAST(floor(target + 0.5) AS BIGINT) AS take, (source_size + 1023) // 1024 AS blocks FROM targets) WHERE take > 0),
points AS (
  SELECT *, CAST(coalesce(sum(quota) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low,
         CAST(ceil(log2(sum(quota) OVER ())) AS INTEGER) AS bits FROM quotas),
slots AS (
  SELECT key, source_size, blocks, take, list_sum(list_transform(range(bits), lambda i: ((low + u) >> i & 1) << (bits - 1 - i)))::BIGINT AS slot
  FROM (SELECT *, unnest(range(quota)) AS u FROM points)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM slots),
uses AS (
  SELECT key, slot, rank % blocks AS block,
         least(1024, CASE WHEN rank // blocks < take // source_size THEN source_size ELSE take % source_size END - (rank % blocks) * 1024) AS words FROM ranked),
firsts AS (
  SELECT p.key, p.start, min(slot) AS first_slot FROM placed p JOIN uses u ON u.key = p.key AND u.block * 1024 < p.start + p.size AND p.start < u.block * 1024 + u.words
  WHERE p.size > 0 GROUP BY p.key, p.start)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN first_slot END AS first_slot,
       CASE WHEN size = 0 THEN 0 ELSE CAST((take // source_size) * size + greatest(least(start + size, take % source_size) - start, 0) AS BIGINT) END AS taken
FROM placed LEFT JOIN firsts USING (key, start)
""",
    "op11_minhash_postings": r"""
WITH RECURSIVE
words AS (
  SELECT DISTINCT text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT text, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
numbered AS (SELECT row_number() OVER () AS node, * FROM (SELECT list_sort(s) AS s FROM sets GROUP BY ALL) WHERE len(s) > 0),
named AS (SELECT text, coalesce(node, 0) AS node, len(t.s) AS n FROM sets t LEFT JOIN numbered m ON list_sort(t.s) = m.s),
postings AS (SELECT node, len(s) AS n, unnest(s) AS shingle FROM numbered),
links AS (
  SELECT a.node AS u, b.node AS v FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, other) AS (SELECT node, node FROM numbered UNION SELECT r.node, b.v FROM reach r JOIN ways b ON r.other = b.u),
ids AS (SELECT d.doc_id, n.node, n.n FROM documents d JOIN named n ON d.text IS NOT DISTINCT FROM n.text),
lows AS (SELECT r.node, min(doc_id) AS component_id FROM reach r JOIN ids ON ids.node = r.other GROUP BY r.node),
found AS (SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM ids LEFT JOIN lows USING (node))
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, b)) AS t),
ids AS (
  SELECT DISTINCT doc_id,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
             lambda x, c: xor(x // 256, t[xor(x % 256, c) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM documents, crc_table WHERE doc_id IS NOT NULL),
fields AS (
  SELECT doc_id, coalesce('=' || lang, '') AS run,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS number, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM (SELECT f.doc_id, run, sha256(head || number || tail) AS leaf,
               CASE WHEN coalesce(crc % 7 = 0, false) THEN sha256(head || more || tail) ELSE sha256(head || number || tail) END AS now
        FROM fields f LEFT JOIN ids USING (doc_id))),
nodes AS (
  SELECT run, place, leaf AS h, 0 AS level, count(*) OVER (PARTITION BY run) AS n FROM leaves
  UNION ALL
  SELECT run, place // 2, sha256(string_agg(h, '' ORDER BY place)), level + 1, (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY run, place // 2, level, n),
subroots AS (SELECT run, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(run)) - 1 AS place FROM nodes WHERE n = 1),
over AS (
  SELECT place, subroot AS h, 0 AS level, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT place // 2, sha256(string_agg(h, '' ORDER BY place)), level + 1, (n + 1) // 2 FROM over WHERE n > 1 GROUP BY place // 2, level, n),
top AS (SELECT h AS root, level AS height FROM over WHERE n = 1),
steps AS (
  SELECT l.run, l.place AS leaf_place, g.level, (l.place >> g.level) % 2 = 1 AS on_left, s.h AS sibling
  FROM leaves l JOIN subroots r USING (run), unnest(range(r.height)) g(level)
  LEFT JOIN nodes s ON s.run = l.run AND s.level = g.level AND s.place = xor(l.place >> g.level, 1)
  UNION ALL
  SELECT l.run, l.place, r.height + g.level, (r.place >> g.level) % 2 = 1, s.h
  FROM leaves l JOIN subroots r USING (run), top, unnest(range(top.height)) g(level)
  LEFT JOIN over s ON s.level = g.level AND s.place = xor(r.place >> g.level, 1)),
paths AS (SELECT run, leaf_place, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY ALL),
folds AS (
  SELECT run, place AS leaf_place, now AS h, 0 AS level FROM leaves
  UNION ALL
  SELECT f.run, f.leaf_place, sha256(CASE WHEN on_left THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END), f.level + 1
  FROM folds f JOIN steps s ON s.run = f.run AND s.leaf_place = f.leaf_place AND s.level = f.level),
ends AS (SELECT run, leaf_place, arg_max(h, level) AS folded_root FROM folds GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots USING (run) CROSS JOIN top JOIN ends e ON e.run = l.run AND e.leaf_place = l.place
LEFT JOIN paths p ON p.run = l.run AND p.leaf_place = l.place
""",
    "op13_tput_search": r"""
WITH words AS (
  SELECT doc_id, copy, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS copy FROM documents)),
asked AS (
  SELECT item_id, item, term, count(*) AS times
  FROM (SELECT item_id, item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark)) GROUP BY ALL),
postings AS (SELECT doc_id, copy, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY copy) AS n FROM words GROUP BY doc_id, copy, term),
sizes AS (SELECT count(DISTINCT copy) AS texts, count(*) AS terms FROM words),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, sizes GROUP BY term, texts),
scores AS (
  SELECT item_id, item, doc_id, copy, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n::BIGINT * texts) // terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY item_id, item, doc_id, copy)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
}
