"""Stratified sampling, splits, batches, sequences and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tierlens.functions import labels as L, notation as N
from tierlens.operators import policy as Y, profile as R, sampling as W, sequence as Q
from tierlens.operators.ranking import hash_bucket, rank_within
from tierlens.plans import bindings as B
from tierlens.plans.registry import query, with_ctes
from tierlens.plans.score_queries import rounded
from tierlens.session import materialize

TARGET, FLOOR, BINS = 1500, 5, 5


def strata(spark, sf) -> DataFrame:
    """Tiers with length and width buckets per split and the stratum they form."""
    columns = ["split", "tier_id", "parent_image_id", "tier_name", "training_label", "label_length", "resized_width"]
    t = materialize(B.tiers(spark, sf).select(*columns), "tiers")
    t = W.quantile_buckets(t, "label_length", BINS, "label", ["split"])
    t = W.quantile_buckets(t, "resized_width", BINS, "width", ["split"])
    return t.withColumn("stratum_id", F.concat_ws("+", "tier_name", "label_bucket", "width_bucket"))


def annotated(spark, sf) -> DataFrame:
    """The annotated manifest, written once because sampling reads it several times."""
    columns = ["split", "tier_id", "parent_image_id", "tier_name", "label_bucket", "width_bucket", "stratum_id", "training_label"]
    return materialize(strata(spark, sf).select(*columns), "annotated")


def allocation(tiers: DataFrame, target: int = TARGET) -> DataFrame:
    sizes = tiers.groupBy("split", "stratum_id").agg(F.count(F.lit(1)).alias("size"))
    return W.allocate(sizes, "stratum_id", "size", target, FLOOR, ["split"])


def sample(t: DataFrame) -> DataFrame:
    return W.stratified_sample(t, allocation(t), "split", "stratum_id", "parent_image_id", "tier_id", B.SEED)


def _cuts_sql(name: str, value: str) -> str:
    probs = ", ".join(str(i / BINS) for i in range(1, BINS))
    return f"""
{name}_p AS (SELECT split, quantile_cont({value}, [{probs}]) AS p, count(*) AS n FROM tiers GROUP BY split),
{name}_l AS (SELECT split, i, c, any_value(n) AS n, count(v) AS nleft FROM (
    SELECT q.split, q.i, q.c, q.n, CASE WHEN t.{value} <= q.c THEN 1 END AS v
    FROM (SELECT split, n, unnest(p) AS c, generate_subscripts(p, 1) AS i FROM {name}_p) q JOIN tiers t ON t.split = q.split) GROUP BY split, i, c),
{name}_cuts AS (SELECT split, list(c ORDER BY i) AS cuts FROM {name}_l a WHERE nleft > 0 AND nleft < n AND NOT EXISTS (SELECT 1 FROM {name}_l b WHERE b.split = a.split AND b.nleft = a.nleft AND b.i < a.i) GROUP BY split)"""


_STRATA_SQL = _cuts_sql("label", "label_length") + "," + _cuts_sql("width", "resized_width") + """,
bucketed AS (SELECT t.*, 'label_q' || (1 + len(list_filter(a.cuts, lambda c: c < t.label_length))) AS label_bucket, 'width_q' || (1 + len(list_filter(b.cuts, lambda c: c < t.resized_width))) AS width_bucket
             FROM tiers t JOIN label_cuts a ON a.split = t.split JOIN width_cuts b ON b.split = t.split),
strata AS (SELECT *, tier_name || '+' || label_bucket || '+' || width_bucket AS stratum_id FROM bucketed)"""

# The bounded share is found by bisection here, by a prefix rule in Spark.
_ALLOC_SQL = f"""
sizes AS (SELECT split, stratum_id, count(*) AS p FROM strata GROUP BY ALL),
lows AS (SELECT *, least({TARGET}, sum(p) OVER (PARTITION BY split)) AS t, CASE WHEN sum(least({FLOOR}, p)) OVER (PARTITION BY split) > least({TARGET}, sum(p) OVER (PARTITION BY split)) THEN 1 ELSE least({FLOOR}, p) END AS l FROM sizes),
grouped AS (SELECT split, any_value(t) AS t, list(p) AS ps, list(l) AS ls FROM lows GROUP BY split),
bisect(split, t, ps, ls, lo, hi, step) AS (
  SELECT split, t, ps, ls, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM grouped
  UNION ALL
  SELECT split, t, ps, ls, CASE WHEN s < t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s < t THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, list_sum(list_transform(range(1, len(ps) + 1), lambda i: greatest(ls[i], least(ps[i], (lo + hi) / 2 * ps[i])))) AS s FROM bisect WHERE step < 80)),
ideal AS (SELECT a.*, greatest(l, least(p, hi * p)) AS x FROM lows a JOIN bisect b ON b.split = a.split AND b.step = 80),
whole AS (SELECT *, least(p, greatest(l, floor(x + 1e-9)))::BIGINT AS w FROM ideal),
allocated AS (SELECT split, stratum_id, p AS population, l::BIGINT AS floor,
  w + CASE WHEN w < p AND row_number() OVER (PARTITION BY split ORDER BY w >= p, round(x - w, 6) DESC, stratum_id) <= t - sum(w) OVER (PARTITION BY split) THEN 1 ELSE 0 END AS allocation FROM whole)"""

_PASS_SQL = """
hashed AS (SELECT *, sha256('[42,' || substr(to_json([split, 'tier', tier_id])::VARCHAR, 2)) AS th, sha256('[42,' || substr(to_json([split, 'parent', parent_image_id])::VARCHAR, 2)) AS ph FROM strata),
passes AS (SELECT *, row_number() OVER (PARTITION BY split, stratum_id, parent_image_id ORDER BY th, tier_id) AS pass FROM hashed),
drawn AS (SELECT *, row_number() OVER (PARTITION BY split, stratum_id ORDER BY pass, ph, parent_image_id) AS r FROM passes),
sample AS (SELECT d.* FROM drawn d JOIN allocated a USING (split, stratum_id) WHERE r <= allocation)"""


@query("w01_quantile_buckets", with_ctes("SELECT tier_id, label_bucket, width_bucket, stratum_id FROM strata", B.TIERS_SQL, _STRATA_SQL))
def w01(spark, sf):
    return strata(spark, sf).select("tier_id", "label_bucket", "width_bucket", "stratum_id")


@query("w02_allocation", with_ctes("SELECT split, stratum_id, population, floor, allocation::BIGINT AS allocation FROM allocated", B.TIERS_SQL, _STRATA_SQL, _ALLOC_SQL, recursive=True))
def w02(spark, sf):
    return allocation(strata(spark, sf))


@query("w03_stratified_sample", with_ctes("SELECT split, stratum_id, parent_image_id, tier_id, pass FROM sample", B.TIERS_SQL, _STRATA_SQL, _ALLOC_SQL, _PASS_SQL, recursive=True))
def w03(spark, sf):
    return sample(annotated(spark, sf)).select("split", "stratum_id", "parent_image_id", "tier_id", "pass")


@query("w04_coverage_repair")
def w04(spark, sf):
    """Samples of all splits repaired until every vocabulary character they can have occurs often enough; step by step, so no SQL form."""
    columns = ["split", "stratum_id", "parent_image_id", "tier_id", "training_label"]
    t = annotated(spark, sf)
    s = materialize(sample(t), "sample")
    return W.repair_coverage(t.select(*columns), s.select(*columns), N.VOCABULARY, 8, "split", "parent_image_id", "tier_id", "training_label", B.SEED)


@query("w05_group_split", """
WITH r AS (SELECT k, row_number() OVER (ORDER BY sha256('v2split:42:' || k), k) AS n, round_even(count(*) OVER () * 0.15::DOUBLE, 0) AS s FROM (SELECT DISTINCT l_partkey AS k FROM lineitem))
SELECT k AS l_partkey, n AS split_rank, CASE WHEN n <= s THEN 'protected_test' WHEN n <= 2 * s THEN 'validation_calibration' ELSE 'development_design' END AS assigned_split FROM r""")
def w05(spark, sf):
    return W.group_split(B.table(spark, sf, "lineitem"), "l_partkey", B.SEED)


@query("w06_hash_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY sha256('42:' || o_custkey), o_custkey LIMIT 100)")
def w06(spark, sf):
    """All orders of the 100 customers with the smallest hashes (the sample is the operator)."""
    return W.hash_sample(B.table(spark, sf, "orders"), "o_custkey", 100).select("o_orderkey", "o_custkey")


@query("w07_split_limit", with_ctes("""
SELECT split, tier_id FROM (SELECT split, tier_id, row_number() OVER (PARTITION BY split ORDER BY tier_id) AS n FROM tier_base) WHERE n <= CASE split WHEN 'test' THEN 334 ELSE 333 END""", B.TIER_BASE_SQL))
def w07(spark, sf):
    """A scan budget of 1,000 spread over the splits (the limit is the operator)."""
    return W.split_limit(B.raw_tiers(spark, sf), "split", ["test", "train", "validation"], 1000, ["tier_id"]).select("split", "tier_id")


@query("w08_width_batches", with_ctes("""
SELECT count(*) AS rows, count(DISTINCT tier_id) AS distinct_rows, sum(resized_width)::BIGINT AS width_sum, (SELECT ceil(count(*) / 2048.0)::BIGINT FROM tiers) AS pools, 0::BIGINT AS over_budget, 0::BIGINT AS over_cap FROM tiers""", B.TIERS_SQL))
def w08(spark, sf):
    """Batches under a width budget and a size cap: every row once, no bound broken."""
    t = B.tiers(spark, sf).select("tier_id", "resized_width")
    budget = 500_000
    b = W.width_batches(t, "tier_id", "resized_width", budget, 64)
    per = b.groupBy("pool", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("resized_width").alias("w"), F.sum("resized_width").alias("s"), F.countDistinct("tier_id").alias("d"))
    return per.agg(
        F.sum("n").alias("rows"), F.sum("d").alias("distinct_rows"), F.sum("s").alias("width_sum"), F.countDistinct("pool").alias("pools"),
        F.count_if(F.col("w") * F.col("n") > budget).alias("over_budget"), F.count_if(F.col("n") > 64).alias("over_cap"),
    )


# -- sequences ---------------------------------------------------------------

_RUNS_SQL = """
marked AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st, row_number() OVER w - 1 AS place FROM paths WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)),
runs_ AS (SELECT user_id, run, event_type, min(place) AS start_frame, max(place) + 1 AS end_frame, count(*) AS frames FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY at_us, event_id)::BIGINT AS run FROM marked) GROUP BY ALL)"""


@query("w09_run_length", with_ctes("""
SELECT user_id, run, event_type, start_frame, end_frame, frames, CASE WHEN event_type <> 'view' THEN (sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY run))::BIGINT - 1 END AS character_index FROM runs_""", B.PATHS_SQL, _RUNS_SQL))
def w09(spark, sf):
    e = B.paths(spark, sf).select("user_id", "day", "at_us", "event_id", "event_type")
    return Q.run_length(e, ["user_id"], "day", ["at_us", "event_id"], "event_type", "view")


_ACTIVE_SQL = """
active AS (SELECT user_id, at_us AS start_at, at_us + (value * 60000000)::BIGINT AS end_at FROM paths WHERE event_type <> 'view'),
spans AS (SELECT user_id, start_at, max(end_at) AS end_at FROM active GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN start_at - lag(end_at) OVER (PARTITION BY user_id ORDER BY start_at) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM spans),
merged AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_at)::BIGINT AS merged_run, start_at, end_at FROM flagged)"""


def _active(spark, sf) -> DataFrame:
    """Active spans of a user: an event lasts as many minutes as its value says."""
    e = B.paths(spark, sf).where("event_type <> 'view'")
    end = F.col("at_us") + F.round(F.col("value") * 60_000_000).cast("long")
    return e.groupBy("user_id", F.col("at_us").alias("start_at")).agg(F.max(end).alias("end_at")).withColumn("day", F.floor(F.col("start_at") / 86_400_000_000))


@query("w10_merge_runs", with_ctes("SELECT user_id, merged_run, min(start_at) AS start_at, max(end_at) AS end_at, count(*) AS parts FROM merged GROUP BY user_id, merged_run", B.PATHS_SQL, _ACTIVE_SQL))
def w10(spark, sf):
    """Spans closer than six hours become one run."""
    return Q.merge_runs(_active(spark, sf), ["user_id"], "day", "start_at", "end_at", 21_600_000_000)


@query("w11_reduce_runs", with_ctes("""
, gaps AS (SELECT user_id, start_at, end_at, start_at - lag(end_at) OVER (PARTITION BY user_id ORDER BY start_at) AS gap, count(*) OVER (PARTITION BY user_id) AS n FROM spans),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC NULLS LAST, start_at DESC) AS r FROM gaps),
k AS (SELECT user_id, start_at, end_at, sum(CASE WHEN gap IS NOT NULL AND r <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_at)::BIGINT + 1 AS reduced_run FROM ranked WHERE n >= 4)
SELECT user_id, reduced_run, min(start_at) AS start_at, max(end_at) AS end_at, count(*) AS parts FROM k GROUP BY user_id, reduced_run""".strip(), B.PATHS_SQL, _ACTIVE_SQL))
def w11(spark, sf):
    """Exactly four runs per user: the three widest gaps stay."""
    return Q.reduce_runs(_active(spark, sf), ["user_id"], "day", "start_at", "end_at", 4)


_REPRESENT_SQL = """
, cats AS (SELECT tier_id, unnest(list_filter([split || '/' || tier_name, CASE WHEN leading_offset > 0 THEN 'leading_spaces' END, CASE WHEN strpos(training_label, ' ') > 0 THEN 'internal_space' END,
    CASE WHEN strpos(training_label, ',') > 0 THEN 'comma' END, CASE WHEN strpos(training_label, '"') > 0 THEN 'quote' END], lambda x: x IS NOT NULL)) AS category FROM tiers),
firsts AS (SELECT min(tier_id) AS tier_id FROM cats GROUP BY category)
SELECT tier_id FROM (SELECT tier_id FROM tiers ORDER BY tier_id LIMIT 100) UNION SELECT tier_id FROM firsts"""


@query("w14_representatives", with_ctes(_REPRESENT_SQL.strip(), B.TIERS_SQL))
def w14(spark, sf):
    """The first 100 tiers and the first of every category."""
    t = B.tiers(spark, sf)
    has = lambda c: F.contains("training_label", F.lit(c))
    names = F.array_compact(F.array(
        F.concat_ws("/", "split", "tier_name"), F.when(F.col("leading_offset") > 0, "leading_spaces"), F.when(has(" "), "internal_space"), F.when(has(","), "comma"), F.when(has('"'), "quote"),
    ))
    return representatives(t, "tier_id", names, 100)


def representatives(df: DataFrame, key: str, categories, n: int) -> DataFrame:
    """The first n keys and the smallest key of every category."""
    firsts = df.select(key, F.explode(categories).alias("category")).groupBy("category").agg(F.min(key).alias(key)).select(key)
    return df.select(key).orderBy(key).limit(n).unionByName(firsts).distinct()


@query("w16_order_check", """
SELECT count(*) AS violations FROM (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad""")
def w16(spark, sf):
    """Order dates that fall behind the date of the order before."""
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.floor(F.col("o_orderkey") / 4096).alias("b"))
    return Q.order_violations(o, "b", "o_orderkey", ["o_orderdate"]).agg(F.count(F.lit(1)).alias("violations"))


# -- drift -------------------------------------------------------------------

@query("a20_drift", with_ctes("""
, pairs AS (SELECT 'full' AS side, d.* FROM (SELECT split, unnest(['tier_name', 'label_bucket', 'width_bucket', 'stratum_id']) AS dimension, unnest([tier_name, label_bucket, width_bucket, stratum_id]) AS value FROM strata) d
  UNION ALL SELECT 'subset', d.* FROM (SELECT split, unnest(['tier_name', 'label_bucket', 'width_bucket', 'stratum_id']) AS dimension, unnest([tier_name, label_bucket, width_bucket, stratum_id]) AS value FROM sample) d),
c AS (SELECT split, dimension, value, count(*) FILTER (WHERE side = 'full') AS f, count(*) FILTER (WHERE side = 'subset') AS s FROM pairs GROUP BY ALL),
t AS (SELECT *, 100.0::DOUBLE * f / sum(f) OVER (PARTITION BY split, dimension) AS fp, coalesce(100.0::DOUBLE * s / nullif(sum(s) OVER (PARTITION BY split, dimension), 0), 0) AS sp FROM c)
SELECT split, dimension, value, f AS full_count, s AS subset_count, round(fp, 6) AS full_percent, round(sp, 6) AS subset_percent, round(abs(fp - sp), 6) AS difference_pp, abs(fp - sp) > 2 AS exceeds_limit FROM t""".strip(),
    B.TIERS_SQL, _STRATA_SQL, _ALLOC_SQL, _PASS_SQL, recursive=True))
def a20(spark, sf):
    """How far each split's sample drifts from the split."""
    t = annotated(spark, sf)
    return rounded(R.drift(t, sample(t), ["tier_name", "label_bucket", "width_bucket", "stratum_id"], by=["split"]))


@query("a21_coverage_ratios", with_ctes(r"""
, v AS (SELECT substr(a, g, 1) AS c FROM (SELECT a, unnest(range(1, 66)) AS g FROM (SELECT ' ''()*+,ABCDEFGHIJKLMNPQRSTUVWXYZ[\]^_abcdefghijklmnopqrstuvwxyz{|' AS a))),
f AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(training_label, '')) AS c FROM tier_base) GROUP BY c),
s AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(training_label, '')) AS c FROM tier_base WHERE split = 'test') GROUP BY c),
j AS (SELECT v.c, coalesce(f.n, 0) AS fc, coalesce(s.n, 0) AS sc FROM v LEFT JOIN f ON f.c = v.c LEFT JOIN s ON s.c = v.c),
t AS (SELECT *, sum(fc) OVER () AS ft, sum(sc) OVER () AS st FROM j)
SELECT c AS character, fc AS full_count, sc AS subset_count, round(sc::DOUBLE / nullif(fc, 0), 6) AS subset_full_ratio, round(100 * (fc::DOUBLE / ft), 6) AS full_percent, round(100 * (sc::DOUBLE / st), 6) AS subset_percent,
  round((sc::DOUBLE / st) / nullif(fc::DOUBLE / ft, 0), 6) AS normalized_ratio, least(1000, fc)::BIGINT AS effective_minimum FROM t""".strip(), B.TIER_BASE_SQL))
def a21(spark, sf):
    t = B.raw_tiers(spark, sf).withColumn("training_label", L.clean_label(F.col("raw_label")))
    return rounded(R.coverage_ratios(t, t.where("split = 'test'"), "training_label", N.VOCABULARY, 1000))


# -- screening ---------------------------------------------------------------

_SCREEN_SQL = """
screened AS (SELECT *, list_filter([CASE WHEN price / 500000 < 0.15 THEN 'LOW_CONTRAST' END, CASE WHEN role_margin IS NULL THEN 'MARGIN_UNKNOWN' END, CASE WHEN raw_prediction <> truth THEN 'LIKELY_CLIPPING' END], lambda x: x IS NOT NULL) AS flags,
   preprocessing_status IN ('no_ink', 'unreadable') AS excluded FROM images)"""


def _screened(spark, sf) -> DataFrame:
    c = F.col
    rules = [("LOW_CONTRAST", c("price") / 500000 < 0.15), ("MARGIN_UNKNOWN", c("role_margin").isNull()), ("LIKELY_CLIPPING", c("raw_prediction") != c("truth"))]
    return Y.quality_screen(B.images(spark, sf), rules, c("preprocessing_status").isin("no_ink", "unreadable"))


@query("r16_quality_screen", with_ctes("""
SELECT image_id, array_to_string(flags, ';') AS flags, CASE WHEN excluded THEN 'OBJECTIVE_EXCLUDE' WHEN len(flags) > 0 THEN 'FLAGGED' ELSE 'PASS_AUTOMATED_CHECKS' END AS quality_result FROM screened""", B.IMAGES_SQL, _SCREEN_SQL))
def r16(spark, sf):
    return _screened(spark, sf).select("image_id", F.array_join("flags", ";").alias("flags"), "quality_result")


@query("w15_review_queue", with_ctes("""
SELECT image_id, priority, isolated, row_number() OVER (ORDER BY isolated, priority, parent_id, image_id) AS place FROM (
  SELECT image_id, parent_id, CASE WHEN list_contains(flags, 'LIKELY_CLIPPING') THEN 1 WHEN len(flags) > 0 THEN 2 ELSE 3 END AS priority, partition = 'validation' AS isolated FROM screened WHERE NOT excluded)""", B.IMAGES_SQL, _SCREEN_SQL))
def w15(spark, sf):
    """Review queue with the place of every record, numbered in buckets of the order."""
    queue = Y.review_queue(_screened(spark, sf), F.array_contains("flags", "LIKELY_CLIPPING"), F.col("partition") == "validation", ["parent_id", "image_id"])
    first = F.concat_ws("|", F.col("isolated").cast("int").cast("string"), F.col("priority").cast("string"), F.lpad(F.floor(F.col("parent_id") / 64).cast("string"), 16, "0"))
    order = [F.col("isolated").cast("int"), F.col("priority"), F.col("parent_id"), F.col("image_id")]
    return rank_within(queue, [], first, order, "place").select("image_id", "priority", "isolated", "place")


@query("w05_hash_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents")
def w05b(spark, sf):
    """Global hash rank of all documents without a one-partition window."""
    from tierlens.functions.hashing import tagged_hash

    d = B.table(spark, sf, "documents").select("doc_id", tagged_hash("42:", F.col("doc_id")).alias("h"))
    return rank_within(d, [], hash_bucket(F.col("h")), [F.col("h"), F.col("doc_id")], "place").select("doc_id", "place")
