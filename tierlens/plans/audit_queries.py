"""Consistency, leakage, duplicate and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.functions import labels as L, notation as N
from tierlens.functions.hashing import tagged_hash
from tierlens.operators import audit as A, compare as P, profile as R
from tierlens.operators.ranking import order_statistic, top_examples
from tierlens.plans import bindings as B
from tierlens.plans.registry import query, with_ctes
from tierlens.session import materialize
from tierlens.sources import samples as S

# lines of an order against what the order header promises
_LAYOUT = """
layout AS (SELECT o_orderkey AS row_id, o_custkey AS parent, o_orderstatus AS status,
                  o_totalprice >= 100000 AS upper_present, o_orderstatus <> 'F' AS count_present, o_totalprice < 300000 AS lower_present FROM orders),
lines AS (SELECT l_orderkey AS row_id, l_linestatus AS status, ['upper', 'count', 'lower'][l_linenumber % 3 + 1] AS tier_name FROM lineitem)"""


def _layout(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") >= 100000).alias("upper_present"), (F.col("o_orderstatus") != "F").alias("count_present"), (F.col("o_totalprice") < 300000).alias("lower_present"),
    )


def _lines(spark, sf):
    role = F.element_at(F.array(*[F.lit(r) for r in N.ROLES]), F.col("l_linenumber") % 3 + 1)
    return B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linestatus").alias("status"), role.alias("tier_name"))


@query("j01_layout_mismatch", with_ctes("""
SELECT CASE WHEN y.row_id IS NULL THEN 'missing_layout' ELSE 'layout_differs' END AS problem, x.status, count(*) AS rows
FROM lines x LEFT JOIN layout y ON x.row_id = y.row_id WHERE y.row_id IS NULL OR x.status IS DISTINCT FROM y.status GROUP BY ALL""", _LAYOUT))
def j01(spark, sf):
    bad = A.layout_mismatches(_lines(spark, sf), _layout(spark, sf), "row_id", ["status"])
    return bad.groupBy("problem", "status").agg(F.count(F.lit(1)).alias("rows"))


@query("j02_tier_presence", with_ctes("""
SELECT e.row_id, e.tier_name, CASE WHEN expected THEN 'expected_absent' ELSE 'unexpected_present' END AS state
FROM (SELECT row_id, unnest(['upper', 'count', 'lower']) AS tier_name, unnest([upper_present, count_present, lower_present]) AS expected FROM layout) e
LEFT JOIN (SELECT DISTINCT row_id, tier_name FROM lines) f ON e.row_id = f.row_id AND e.tier_name = f.tier_name
WHERE expected <> (f.row_id IS NOT NULL)""", _LAYOUT))
def j02(spark, sf):
    return A.tier_presence(_layout(spark, sf), _lines(spark, sf), "row_id", "tier_name")


@query("j03_orphans", """
SELECT 'documents' AS tables, coalesce(d.doc_id, l.doc_id) AS key, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM documents d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
UNION ALL
SELECT 'customers', coalesce(c.c_custkey, o.k), CASE WHEN o.k IS NULL THEN 'left_only' ELSE 'right_only' END
FROM customer c FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.c_custkey = o.k WHERE c.c_custkey IS NULL OR o.k IS NULL""")
def j03(spark, sf):
    t = lambda n: B.table(spark, sf, n)
    a = A.orphans(t("documents"), t("labels"), "doc_id").select(F.lit("documents").alias("tables"), F.col("doc_id").alias("key"), "side")
    c = A.orphans(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), "k")
    return a.unionByName(c.select(F.lit("customers").alias("tables"), F.col("k").alias("key"), "side"))


@query("j04_reconcile_pages", """
WITH p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice < 50000),
u AS (SELECT k, k IN (SELECT k FROM p) AS p, k IN (SELECT k FROM c) AS c, k IN (SELECT k FROM f) AS f FROM (SELECT k FROM p UNION SELECT k FROM c UNION SELECT k FROM f))
SELECT k AS page, unnest(list_filter([CASE WHEN c AND NOT p THEN 'completed_without_tiers' END, CASE WHEN p AND NOT c THEN 'parents_not_completed' END, CASE WHEN f AND p THEN 'failed_pages_with_tiers' END,
  CASE WHEN f AND NOT p THEN 'failed_pages_without_tiers' END, CASE WHEN f AND NOT c THEN 'failed_pages_not_completed' END, CASE WHEN c AND NOT p AND NOT f THEN 'completed_without_tiers_and_no_failure' END], lambda x: x IS NOT NULL)) AS difference FROM u""")
def j04(spark, sf):
    o = B.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "page")
    produced = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page")).distinct()
    return A.reconcile_pages(produced, o.where("o_orderstatus <> 'P'"), o.where("o_totalprice < 50000"), "page")


_TEXT_SPLITS = """
owned AS (SELECT sha256(text) AS h, CASE WHEN s < '3' THEN 'test' WHEN s < '6' THEN 'validation' ELSE 'train' END AS split
          FROM (SELECT text, substr(sha256('split:42:' || doc_id), 1, 1) AS s FROM documents))"""


def _text_splits(spark, sf):
    first = F.substr(tagged_hash("split:42:", F.col("doc_id")), F.lit(1), F.lit(1))
    split = F.when(first < "3", "test").when(first < "6", "validation").otherwise("train")
    return B.table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), split.alias("split"))


@query("j05_split_leakage", with_ctes("SELECT DISTINCT a.h, a.split AS split_a, b.split AS split_b FROM owned a JOIN owned b ON a.h = b.h AND a.split < b.split", _TEXT_SPLITS))
def j05(spark, sf):
    return A.split_overlap(_text_splits(spark, sf), "h", "split")


@query("j06_key_owners", with_ctes("SELECT h, string_agg(split, ';' ORDER BY split) AS splits FROM (SELECT DISTINCT h, split FROM owned) GROUP BY h HAVING count(*) > 1", _TEXT_SPLITS))
def j06(spark, sf):
    return A.split_owners(_text_splits(spark, sf), "h", "split").select("h", F.array_join("splits", ";").alias("splits"))


@query("j07_novel_candidates", """
WITH keyed AS (SELECT doc_id, lang, sha256(lower(trim(x))) AS k FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x FROM documents)),
hist AS (SELECT sha256(lower(trim(x))) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark))
SELECT k, min(doc_id) AS doc_id FROM keyed WHERE k NOT IN (SELECT k FROM hist) GROUP BY k""")
def j07(spark, sf):
    """First document per line key that no benchmark passage holds."""
    key = lambda df, *c: df.select(*c, F.explode(F.split("text", "\n")).alias("x")).select(*c, F.sha2(F.lower(F.trim("x")), 256).alias("k"))
    docs = key(B.table(spark, sf, "documents"), "doc_id")
    return A.novel_keys(docs, key(B.table(spark, sf, "benchmark")), "k", [F.col("doc_id")]).select("k", "doc_id")


@query("j08_matched_controls", """
WITH r AS (SELECT o_orderkey AS id, o_custkey AS parent, o_orderpriority AS grp, o_orderstatus, sha256(o_orderpriority) AS h, (o_orderkey // 2) * 2 AS control FROM orders),
c AS (SELECT * FROM r WHERE o_orderstatus <> 'F'),
j AS (SELECT r.*, c.id AS cid, c.parent AS cp, c.grp AS cg, c.h AS ch FROM r LEFT JOIN c ON r.control = c.id)
SELECT id, unnest(list_filter([CASE WHEN cid IS NULL THEN 'control_missing' END, CASE WHEN cid IS NOT NULL AND parent IS DISTINCT FROM cp THEN 'parent_differs' END,
  CASE WHEN cid IS NOT NULL AND grp IS DISTINCT FROM cg THEN 'grp_differs' END, CASE WHEN cid IS NOT NULL AND h IS DISTINCT FROM ch THEN 'control_hash_differs' END], lambda x: x IS NOT NULL)) AS violation FROM j""")
def j08(spark, sf):
    o = B.table(spark, sf, "orders")
    r = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("grp"), "o_orderstatus",
        F.sha2("o_orderpriority", 256).alias("h"), (F.floor(F.col("o_orderkey") / 2) * 2).alias("control"),
    )
    return A.matched_controls(r, "id", "control", ["parent", "grp"], "h", "h", F.col("o_orderstatus") != "F")


_SOURCE_KEYS = """
d AS (SELECT doc_id, split_part(x, chr(10), 1) AS head, sha256(x) AS text_hash, CASE WHEN s < '3' THEN 'test' WHEN s < '6' THEN 'validation' ELSE 'train' END AS split
      FROM (SELECT doc_id, text AS x, substr(sha256('split:42:' || doc_id), 1, 1) AS s FROM documents)),
k AS (SELECT doc_id, text_hash, sha256(lower(regexp_replace(x, '\\s+', '', 'g'))) AS semantic_hash, split FROM (SELECT d.*, t.text AS x FROM d JOIN documents t USING (doc_id)))"""


@query("j09_source_matches", with_ctes("""
SELECT a.doc_id, string_agg(DISTINCT b.split, ';' ORDER BY b.split) AS splits, string_agg(DISTINCT m, ';' ORDER BY m) AS matched_by
FROM (SELECT doc_id, text_hash AS h, 'text_hash' AS m FROM k WHERE split = 'test' UNION ALL SELECT doc_id, semantic_hash, 'semantic_hash' FROM k WHERE split = 'test') a
LEFT JOIN (SELECT text_hash AS h, split, 'text_hash' AS mb FROM k WHERE split <> 'test' UNION ALL SELECT semantic_hash, split, 'semantic_hash' FROM k WHERE split <> 'test') b ON a.h = b.h AND a.m = b.mb
WHERE b.h IS NOT NULL GROUP BY a.doc_id""", _SOURCE_KEYS))
def j09(spark, sf):
    """Test documents found in other splits by text hash or by whitespace-free lower-case hash."""
    first = F.substr(tagged_hash("split:42:", F.col("doc_id")), F.lit(1), F.lit(1))
    k = B.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("text_hash"), F.sha2(F.lower(F.regexp_replace("text", r"\s+", "")), 256).alias("semantic_hash"),
        F.when(first < "3", "test").when(first < "6", "validation").otherwise("train").alias("split"),
    )
    found = A.match_sources(k.where("split = 'test'"), k.where("split <> 'test'"), "doc_id", ["text_hash", "semantic_hash"], "split")
    return found.where(F.size("splits") > 0).select("doc_id", F.array_join("splits", ";").alias("splits"), F.array_join("matched_by", ";").alias("matched_by"))


@query("j10_inherit_parent", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS parent_id, o_orderpriority AS category FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j10(spark, sf):
    """Variants take the attributes of their parent; Spark picks the join by the size it measures."""
    parents = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("category"))
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parents, "l_orderkey")


@query("j13_label_agreement", with_ctes(r"""
, l AS (SELECT page, string_split(string_agg(upper || chr(10) || CASE WHEN tax = 8 THEN count || 'a' ELSE count END || chr(10) || lower || chr(10), chr(10) ORDER BY row), chr(10)) AS x FROM notation GROUP BY page),
t AS (SELECT page, r::INT AS row_index, x[r * 4 + 1] AS u, x[r * 4 + 2] AS c, x[r * 4 + 3] AS d FROM (SELECT page, x, unnest(range(0, (len(x) + 1) // 4)) AS r FROM l)),
j AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY row) - 1)::INT AS row_index, upper AS u, count AS c, lower AS d FROM notation WHERE discount > 0)
SELECT coalesce(t.page, j.page) AS page, coalesce(t.row_index, j.row_index) AS row_index, CASE WHEN j.page IS NULL THEN 'only_in_text' WHEN t.page IS NULL THEN 'only_in_json' ELSE 'text_differs' END AS state
FROM t FULL OUTER JOIN j ON t.page = j.page AND t.row_index = j.row_index WHERE t.page IS NULL OR j.page IS NULL OR (t.u, t.c, t.d) IS DISTINCT FROM (j.u, j.c, j.d)""".strip(), B.NOTATION_SQL))
def j13(spark, sf):
    """Label texts (some with a miscopied count) against annotation rows (some missing)."""
    from pyspark.sql import Window

    rows = materialize(B.notation(spark, sf).drop("runs"), "notation")     # both sides derive from them
    count = F.when(F.col("tax") == 8, F.concat("count", F.lit("a"))).otherwise(F.col("count"))
    block = F.concat(F.col("upper"), F.lit("\n"), count, F.lit("\n"), F.col("lower"), F.lit("\n"))
    texts = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", block.alias("b")))), lambda r: r["b"]), "\n").alias("text"))
    parsed = S.parse_rows(texts, "page", "text").where("error is null")
    notes = rows.where("discount > 0").withColumn("row_index", F.row_number().over(Window.partitionBy("page").orderBy("row")) - 1)
    return S.label_agreement(parsed, notes, "page")


@query("j14_leave_one_out", """
SELECT fold, count(*) AS train_rows, count(DISTINCT lang) AS train_groups, sum(n_chars)::BIGINT AS characters
FROM documents, (SELECT unnest(['de', 'en', 'es', 'fr']) AS fold) WHERE lang <> fold GROUP BY fold""")
def j14(spark, sf):
    d = B.table(spark, sf, "documents").select("lang", "n_chars")
    rows = P.leave_one_out(d, "lang", ["de", "en", "es", "fr"])
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("train_rows"), F.countDistinct("lang").alias("train_groups"), F.sum("n_chars").alias("characters"))


@query("j14_fold_sizes", "SELECT source AS fold, count(*) AS heldout_rows, (SELECT count(*) FROM documents) - count(*) AS train_rows FROM documents GROUP BY source")
def j14b(spark, sf):
    """Fold sizes for every source without expanding a row."""
    return P.fold_sizes(B.table(spark, sf, "documents"), "source")


@query("j15_box_overlap", """
WITH b AS (SELECT l_orderkey AS page, l_linenumber, l_partkey, l_suppkey % 97 AS x0, l_suppkey % 97 + l_quantity AS x1, l_linenumber * 10 AS y0, l_linenumber * 10 + 8 AS y1, l_returnflag AS f FROM lineitem),
r AS (SELECT * FROM b WHERE f = 'R'), t AS (SELECT row_number() OVER () AS box, page, l_linenumber, l_partkey, x0, x1, y0, y1 FROM b WHERE f <> 'R')
SELECT page, l_linenumber, l_partkey, x0, x1, hit FROM (SELECT t.box, t.page, t.l_linenumber, t.l_partkey, t.x0, t.x1, coalesce(bool_or(r.page IS NOT NULL AND greatest(t.x0, r.x0) < least(t.x1, r.x1) AND greatest(t.y0, r.y0) < least(t.y1, r.y1)), false) AS hit
FROM t LEFT JOIN r ON t.page = r.page GROUP BY ALL)""")
def j15(spark, sf):
    li = B.table(spark, sf, "lineitem")
    x0, y0 = F.col("l_suppkey") % 97, F.col("l_linenumber") * 10
    b = li.select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), y0.alias("y0"), (y0 + 8).alias("y1"), "l_returnflag")
    hit = P.box_overlaps(b.where("l_returnflag = 'R'"), b.where("l_returnflag <> 'R'").drop("l_returnflag"), ["page"])
    return hit.select("page", "l_linenumber", "l_partkey", "x0", "x1", "hit")


# -- audits and profiles -----------------------------------------------------

@query("a01_split_summary", with_ctes("""
SELECT split, count(*) AS tiers, count(DISTINCT tier_id) AS distinct_ids, count(DISTINCT row_id) AS distinct_rows, count(DISTINCT parent_image_id) AS distinct_parents,
  count(*) FILTER (WHERE tier_name = 'upper') AS upper_tiers, count(*) FILTER (WHERE tier_name = 'count') AS count_tiers, count(*) FILTER (WHERE tier_name = 'lower') AS lower_tiers,
  count(*) FILTER (WHERE training_label = '') AS empty_labels, count(*) FILTER (WHERE unknown_characters <> '') AS unknown_vocabulary, count(*) FILTER (WHERE NOT ctc_feasible) AS ctc_infeasible,
  count(*) FILTER (WHERE leading_offset > 0) AS with_leading_spaces, min(crnn_output_length - ctc_required_timesteps) AS min_margin, max(crnn_output_length - ctc_required_timesteps) AS max_margin, max(label_length) AS max_label_length
FROM tiers GROUP BY split""", B.TIERS_SQL))
def a01(spark, sf):
    return A.split_summary(B.tiers(spark, sf))


_QS = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {R.quantile_name(q)}" for q in R.PROFILE_QUANTILES)


@query("a02_numeric_profile", with_ctes(f"SELECT split, count(*) AS rows, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, {_QS} FROM (SELECT split, label_length AS v FROM tiers) GROUP BY split", B.TIERS_SQL))
def a02(spark, sf):
    """Label length profile per split."""
    p = R.numeric_profile(B.tiers(spark, sf), "label_length", ["split"])
    return p.select("split", "rows", "min", "max", *[F.round(c, 6).alias(c) for c in p.columns[4:]])


@query("a02_measure_profile", f"SELECT l_returnflag, count(*) AS rows, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, {_QS} FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY l_returnflag")
def a02b(spark, sf):
    """Profile of a real-valued measure; values are ranked in ranges, never gathered."""
    p = R.numeric_profile(B.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return p.select("l_returnflag", "rows", "min", "max", F.round("mean", 4).alias("mean"), *[F.round(c, 6).alias(c) for c in p.columns[5:]])


@query("a02_histogram", with_ctes("SELECT tier_name, label_length, count(*) AS rows FROM tiers GROUP BY ALL", B.TIERS_SQL))
def a02c(spark, sf):
    return R.histogram(B.tiers(spark, sf), "label_length", ["tier_name"])


@query("a03_character_counts", with_ctes("""
SELECT split, c AS character, count(*) AS occurrences FROM (SELECT split, unnest(string_split(training_label, '')) AS c FROM tier_base) WHERE c <> '' GROUP BY ALL""", B.TIER_BASE_SQL))
def a03(spark, sf):
    t = B.raw_tiers(spark, sf).select("split", L.clean_label(F.col("raw_label")).alias("training_label"))
    return R.character_counts(t, "training_label", ["split"])


@query("a03_class_coverage", with_ctes(r"""
SELECT s.split, v.c AS character, v.k::INT AS class_id, count(x.c) AS occurrences
FROM (SELECT substr(a, g, 1) AS c, g AS k FROM (SELECT a, unnest(range(1, 66)) AS g FROM (SELECT ' ''()*+,ABCDEFGHIJKLMNPQRSTUVWXYZ[\]^_abcdefghijklmnopqrstuvwxyz{|' AS a))) v
CROSS JOIN (SELECT DISTINCT split FROM tier_base) s LEFT JOIN (SELECT split, unnest(string_split(training_label, '')) AS c FROM tier_base) x ON x.c = v.c AND x.split = s.split GROUP BY ALL""", B.TIER_BASE_SQL))
def a03b(spark, sf):
    t = B.raw_tiers(spark, sf).select("split", L.clean_label(F.col("raw_label")).alias("training_label"))
    return R.class_coverage(t, "training_label", N.VOCABULARY, ["split"])


@query("a19_duplicates", "SELECT doc_id, h, n AS group_size FROM (SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1")
def a19(spark, sf):
    """Members of identical-content groups with the size of their group."""
    d = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return A.with_group_size(d, "h").where("group_size > 1").select("doc_id", "h", "group_size")


@query("a22_family_quartets", """
SELECT o_custkey AS parent, count(*) FILTER (WHERE o_orderstatus <> 'F' AND day(o_orderdate) <= 15) AS valid_clean, count(*) FILTER (WHERE o_orderstatus <> 'F' AND day(o_orderdate) > 15) AS valid_illuminated,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND day(o_orderdate) <= 15) AS invalid_clean, count(*) FILTER (WHERE o_orderstatus = 'F' AND day(o_orderdate) > 15) AS invalid_illuminated,
  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS categories,
  valid_clean = 1 AND valid_illuminated = 1 AND invalid_clean = 1 AND invalid_illuminated = 1 AND categories = 1 AS complete
FROM orders GROUP BY o_custkey""")
def a22(spark, sf):
    r = B.images(spark, sf).select(F.col("parent_id").alias("parent"), "validity", "variant", "paired_category")
    return A.family_quartets(r, "parent", "validity", "variant", "paired_category")


_GATE_SQL = """
manifest AS (SELECT * REPLACE (CASE WHEN doc_id % 61 = 0 THEN 'd' || (doc_id - doc_id % 10) ELSE parent_image_id END AS parent_image_id, CASE WHEN (doc_id + line) % 97 = 0 THEN 'margin' ELSE tier_name END AS tier_name),
  doc_id * 31 + line * 7 AS k FROM tiers WHERE doc_id % 53 <> 0),
copied AS (SELECT * FROM manifest UNION ALL SELECT * FROM manifest WHERE k % 101 = 0),
single AS (SELECT split, tier_id AS example, unnest(list_filter([CASE WHEN k % 31 = 0 THEN 'missing_images' END, CASE WHEN k % 29 = 0 THEN 'missing_labels' END, CASE WHEN k % 29 <> 0 AND k % 41 = 0 THEN 'unreadable_labels' END,
   CASE WHEN k % 29 <> 0 AND k % 41 <> 0 AND k % 43 = 0 THEN 'metadata_label_mismatch' END, CASE WHEN training_label = '' THEN 'empty_ocr_targets' END, CASE WHEN k % 31 <> 0 AND k % 37 = 0 THEN 'invalid_dimensions' END,
   CASE WHEN NOT ctc_feasible THEN 'ctc_infeasible' END, CASE WHEN tier_name = 'margin' THEN 'unknown_tier_names' END, CASE WHEN k % 101 = 0 THEN 'duplicate_tier_ids' END], lambda x: x IS NOT NULL)) AS issue FROM copied),
page AS (SELECT DISTINCT split, parent_image_id FROM manifest), wanted_page AS (SELECT DISTINCT split, parent_image_id FROM tiers),
gap AS (SELECT coalesce(p.split, w.split) AS split, coalesce(p.parent_image_id, w.parent_image_id) AS example FROM page p FULL JOIN wanted_page w ON w.split = p.split AND w.parent_image_id = p.parent_image_id WHERE p.split IS NULL OR w.split IS NULL),
leak AS (SELECT a || ' <-> ' || b AS scope, x.parent_image_id AS example FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(a, b) JOIN page x ON x.split = a JOIN page y ON y.split = b AND y.parent_image_id = x.parent_image_id),
every_issue AS (SELECT split AS scope, issue, example FROM single UNION ALL SELECT split, 'completed_page_mismatch', example FROM gap UNION ALL SELECT scope, 'parent_leakage', example FROM leak),
grid AS (SELECT s AS scope, i AS issue FROM (SELECT unnest(['train', 'validation', 'test']) AS s), (SELECT unnest([{kinds}]) AS i) UNION ALL SELECT unnest(['train <-> validation', 'train <-> test', 'validation <-> test']), 'parent_leakage')""".replace("{kinds}", ", ".join(f"'{i}'" for i in A.CRITICAL))


@query("a25_readiness", with_ctes("""
SELECT g.scope, g.issue, coalesce(n, 0) AS rows, coalesce(examples, '') AS examples, coalesce(n, 0) = 0 AS ready FROM grid g
LEFT JOIN (SELECT scope, issue, count(*) AS n, array_to_string(list_sort(list(DISTINCT example))[:10], ',') AS examples FROM every_issue GROUP BY ALL) e ON e.scope = g.scope AND e.issue = g.issue""", B.TIERS_SQL, _GATE_SQL))
def a25(spark, sf):
    """Critical issues per split and pair of splits, with examples, of a manifest whose files lack, differ or can't be read by a rule."""
    every = B.tiers(spark, sf)
    k = F.col("doc_id") * 31 + F.col("line") * 7
    parent = F.when(F.col("doc_id") % 61 == 0, F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string"))).otherwise(F.col("parent_image_id"))
    manifest = materialize(
        every.where("doc_id % 53 <> 0").withColumns({
            "parent_image_id": parent, "tier_name": F.when((F.col("doc_id") + F.col("line")) % 97 == 0, "margin").otherwise(F.col("tier_name")), "k": k,
        }).select("doc_id", "split", "tier_id", "parent_image_id", "tier_name", "training_label", "image_path", "label_path", "image_width", "image_height", "ctc_feasible", "k"), "manifest")
    images = manifest.where("k % 31 <> 0").select("image_path", F.when(F.col("k") % 37 == 0, F.col("image_width") + 1).otherwise(F.col("image_width")).alias("found_width"), F.col("image_height").alias("found_height"))
    text = F.when(F.col("k") % 41 == 0, F.lit(None)).when(F.col("k") % 43 == 0, F.concat("training_label", F.lit("?"))).otherwise(F.col("training_label"))
    labels = manifest.where("k % 29 <> 0").select("label_path", text.alias("found_label"))
    gate = A.readiness_gate(manifest.unionByName(manifest.where("k % 101 = 0")), images, labels, B.raw_tiers(spark, sf).select("split", "parent_image_id"))
    return gate.withColumn("examples", F.array_join("examples", ","))


@query("a32_nearest_prototype", """
WITH m AS (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
p AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY label),
c AS (SELECT e.vec_id, e.label, p.label AS pl, list_inner_product(e.embedding::DOUBLE[], p.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(p.v, p.v)) + 1e-12) AS s FROM embeddings e, p)
SELECT vec_id, label, round(max(s) FILTER (WHERE pl = label), 6) AS matched_cosine, round(max(s) FILTER (WHERE pl <> label), 6) AS best_other_cosine,
       round(max(s) FILTER (WHERE pl = label) - max(s) FILTER (WHERE pl <> label), 6) AS margin, arg_max(pl, s) AS nearest_label, arg_max(pl, s) = label AS nearest_correct
FROM c GROUP BY vec_id, label""")
def a32(spark, sf):
    n = R.nearest_prototype(B.table(spark, sf, "embeddings"), "label", "embedding", 64)
    return n.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("matched_cosine", "best_other_cosine", "margin")], "nearest_label", "nearest_correct")


@query("o05_vocabulary_difference", with_ctes("""
, c AS (SELECT DISTINCT lang, unnest(string_split(raw_label, '')) AS character FROM tier_base)
SELECT lang, character FROM c WHERE lang <> 'en' AND character <> '' AND character NOT IN (SELECT character FROM c WHERE lang = 'en')""".strip(), B.TIER_BASE_SQL))
def o05(spark, sf):
    """Characters of the other languages that English lines lack."""
    chars = R.character_counts(B.raw_tiers(spark, sf), "raw_label", ["lang"]).select("lang", "character")
    return chars.where("lang <> 'en'").join(chars.where("lang = 'en'").select("character"), "character", "left_anti").select("lang", "character")


@query("o06_set_equality", """
SELECT count(*) FILTER (WHERE l IS NULL) AS only_left, count(*) FILTER (WHERE r IS NULL) AS only_right, count(*) = 0 AS equal
FROM (SELECT a AS r, b AS l FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem) ON a = b) WHERE l IS NULL OR r IS NULL""")
def o06(spark, sf):
    a = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    gaps = A.orphans(a, b, "k")
    return gaps.agg(F.count_if(F.col("side") == "left_only").alias("only_left"), F.count_if(F.col("side") == "right_only").alias("only_right"), (F.count(F.lit(1)) == 0).alias("equal"))


@query("w12_examples_per_issue", with_ctes("""
SELECT issue, tier_id, example_rank FROM (
  SELECT issue, tier_id, row_number() OVER (PARTITION BY issue ORDER BY tier_id)::INT AS example_rank FROM (
    SELECT tier_id, unnest(list_filter([CASE WHEN unknown_characters <> '' THEN 'unknown_characters' END, CASE WHEN NOT ctc_feasible THEN 'ctc_infeasible' END, CASE WHEN training_label = '' THEN 'empty' END], lambda x: x IS NOT NULL)) AS issue FROM tiers))
WHERE example_rank <= 20""", B.TIERS_SQL))
def w12(spark, sf):
    names = L.named_issues([("unknown_characters", F.col("unknown_characters") != ""), ("ctc_infeasible", ~F.col("ctc_feasible")), ("empty", F.col("training_label") == "")])
    each = B.tiers(spark, sf).select("tier_id", F.explode(names).alias("issue"))
    return top_examples(each, ["issue"], 20, [F.col("tier_id")]).select("issue", "tier_id", "example_rank")


@query("w17_calibration", """
SELECT variant, count(*) AS rows, list_sort(list(v))[least((count(*) * 0.05::DOUBLE)::BIGINT - CASE WHEN (count(*) * 0.05::DOUBLE)::BIGINT > count(*) * 0.05::DOUBLE THEN 1 ELSE 0 END, count(*) - 1) + 1] AS threshold
FROM (SELECT CASE WHEN day(o_orderdate) <= 15 THEN 'clean' ELSE 'illuminated' END AS variant, o_totalprice / 500000 AS v FROM orders WHERE o_orderstatus <> 'F') GROUP BY variant""")
def w17(spark, sf):
    """Order-statistic threshold of accepted images; a group of fewer than 20 values stops the job."""
    img = B.images(spark, sf).where("validity = 'VALID'").select("variant", (F.col("price") / 500000).alias("v"))
    return order_statistic(img, "v", 0.05, ["variant"], minimum=20)
