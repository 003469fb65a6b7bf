"""The registered queries of the numbered operators on the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierlens.llm import chat, collocations, decontaminate, extraction, licenses, lm, mixing, prefix_trie, quality, rules, sharding, simhash, tokens
from tierlens.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s),
f AS (
  SELECT *, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_size,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_weight
  FROM w WINDOW o AS (ORDER BY lim / CAST(weight AS DOUBLE), source IS NULL, source)),
l AS (SELECT place, left_size, left_weight FROM f WHERE lim * left_weight > left_size * weight ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN f.place >= (SELECT place FROM l)
              THEN CAST((SELECT left_size FROM l) * weight AS DOUBLE) / (SELECT left_weight FROM l) ELSE CAST(lim AS DOUBLE) END AS target
  FROM f),
q AS (
  SELECT d.*, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.*, r.round, (upto + r.round * source_size) / target AS finish
  FROM q, (VALUES (0), (1), (2)) r(round) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, round, key, size, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c),
n AS (SELECT doc_id, count(*) AS times FROM o WHERE running <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.times, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n USING (doc_id)
""")
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_simhash_components")
def simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_histogram_shards", r"""
WITH poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size,
         substr(md5(coalesce(text, '')), 1, 16) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents),
h AS (SELECT *, string_split(hex(encode(t)), '') AS digits FROM d),
c AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(digits) / 2 AS BIGINT)),
           lambda i: (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
           lambda r, b: xor(r >> 8, step[(xor(r, b) & 255) + 1]))) AS text_crc32
  FROM h, poly),
o AS (
  SELECT doc_id, key, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM d),
s AS (SELECT *, CAST(least(23, (12 * (2 * upto - size)) // total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN c USING (doc_id)
""")
def histogram_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return sharding.with_shards(docs, keep=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_suffix_contamination", r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
t AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS width, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (
  SELECT doc_id, i, width, array_to_string(words[i : i + width - 1], ' ') AS win
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM w, (SELECT DISTINCT width FROM t))),
m AS (SELECT doc_id, i, t.width, item_id FROM g JOIN t USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS p FROM m) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def suffix_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("longest")


@query("op2_random_indexing_quality")
def random_indexing_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))


_COUNTS = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS MATERIALIZED (
  SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '[!#$%&*+/<=>@\\^_`{|}~\[\]]')) AS BIGINT) AS n_marks,
         CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper
  FROM l LEFT JOIN repeated USING (doc_id)),
"""


@query("op4_weak_supervision_rules", _COUNTS + rules.em_sql("counts") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND posterior >= 0.5 AS kept
FROM verdicts
""")
def weak_supervision_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judged(table(spark, sf, "documents"), keep=["doc_id"]).select("doc_id", *rules.BASE, "kept")


@query("op5_license_diagonals", "WITH " + licenses.spans_sql() + """
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN f USING (doc_id)
""")
def license_diagonals(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_report(table(spark, sf, "documents"))


@query("op8_seekable_token_files")
def seekable_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = tokens.write_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: A conversation of control strings, beside those of the table.
_TRICKY = r"\### Assistant: </turn> ok"


@query("op10_prefix_target_chat", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
         length(text) + len(regexp_extract_all(text, '\\|</?turn')) + length(role) + len(regexp_extract_all(role, '[\\<>\n]')) + 17 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = turns) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""")
def prefix_target_chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat.TARGET_ROLE).alias("role"), F.lit(_TRICKY).alias("text")
    )
    return chat.digests(written(chat.examples(turns.unionByName(tricky)), "chat-examples"))


@query("op9_backoff_automaton_scores")
def backoff_automaton_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf, "documents"))


@query("op11_trie_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, words[i : i + k - 1] AS ws, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT g.lang, g.phrase, g.f AS a, l.f AS l, r.f AS r, j, CAST(CAST(2000000 AS HUGEINT) * g.f // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k > 1) g
  JOIN g l ON l.lang = g.lang AND l.phrase = array_to_string(g.ws[1 : j], ' ') JOIN g r ON r.lang = g.lang AND r.phrase = array_to_string(g.ws[j + 1 :], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (
  SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(f) AS above
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM g, (VALUES (2), (3)) v(j) WHERE j < k) GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN s USING (lang, phrase) WHERE above IS NULL OR 100 * CAST(above AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
""")
def trie_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


#: In these tables the article element holds the main text and nothing else, which SQL can cut out; the chain isn't told so.
@query("op12_chain_extraction", r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*(>|$)', '', 'g') AS bare FROM a),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(bare, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
""")
def chain_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query("op13_prefix_trie", r"""
WITH poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))),
             lambda r, b: xor(r >> 8, step[(xor(r, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), poly),
r AS (
  SELECT c.conv_id, 0 AS part, rn, role, text FROM c JOIN t ON t.conv_id = c.base AND rn <= h
  UNION ALL SELECT conv_id, 1, rn, role, text FROM c JOIN t USING (conv_id) WHERE rn > h),
p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, rn ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS MATERIALIZED (
  SELECT node, min(conv_id) AS conv_id, min(p.depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (p.depth = l.depth), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY node),
k AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (
  SELECT d.top AS node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b USING (conv_id) WHERE b.depth >= a.depth) d JOIN n USING (node) LEFT JOIN k USING (node)
  GROUP BY d.top)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON u.node = left(n.node, length(n.node) - 32) AND n.depth > 0 LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node
""")
def prefix_trie_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf, "conversations"))
