"""Recognition scores, policy metrics, candidate comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tierlens.functions.labels import ratio
from tierlens.operators import compare as P, metrics as M
from tierlens.operators.ranking import top_examples
from tierlens.plans import bindings as B
from tierlens.plans.registry import query, with_ctes


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines may sum in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_METRICS = """count(*) AS samples, count(*) FILTER (WHERE exact) AS exact_matches, sum(edits)::BIGINT AS edits, sum(characters)::BIGINT AS characters,
       round(sum(edits) / nullif(sum(characters), 0)::DOUBLE, 6) AS cer, round(count(*) FILTER (WHERE exact) / count(*)::DOUBLE, 6) AS exact_accuracy"""


@query("a05_metric_slices", with_ctes(f"""
SELECT CASE WHEN grouping(role) = 0 THEN 'role' WHEN grouping(candidate) = 0 THEN 'candidate' WHEN grouping(cohort) = 0 THEN 'cohort' WHEN grouping(parent) = 0 THEN 'parent' ELSE 'overall' END AS dimension,
       coalesce(role, candidate, cohort, parent::VARCHAR, 'all') AS value, {_METRICS}
FROM scored GROUP BY GROUPING SETS ((), (role), (candidate), (cohort), (parent))""", B.READINGS_SQL))
def a05(spark, sf):
    return rounded(M.metric_slices(M.score_pairs(B.readings(spark, sf)), ["role", "candidate", "cohort", "parent"]))


_R0 = B.outcomes_sql("r0", "R0")
_R1 = B.outcomes_sql("r1", "R1")


@query("a06_three_way_confusion", with_ctes("""
SELECT validity, count(*) FILTER (WHERE outcome = 'ACCEPT') AS "ACCEPT", count(*) FILTER (WHERE outcome = 'REJECT_INVALID') AS "REJECT_INVALID", count(*) FILTER (WHERE outcome = 'REVIEW_UNCERTAIN') AS "REVIEW_UNCERTAIN"
FROM r1 GROUP BY validity""", B.IMAGES_SQL, _R1))
def a06(spark, sf):
    return M.three_way(B.outcomes(spark, sf))


_COUNTS_SQL = """count(*) AS images, count(*) FILTER (WHERE validity = 'VALID') AS valid, count(*) FILTER (WHERE validity = 'INVALID') AS invalid,
  count(*) FILTER (WHERE edits IS NOT NULL) AS scorable,
  count(*) FILTER (WHERE validity = 'INVALID' AND outcome = 'REJECT_INVALID') AS invalid_rejected, count(*) FILTER (WHERE validity = 'INVALID' AND outcome = 'ACCEPT') AS invalid_accepted,
  count(*) FILTER (WHERE validity = 'INVALID' AND outcome = 'REVIEW_UNCERTAIN') AS invalid_review, count(*) FILTER (WHERE validity = 'VALID' AND outcome = 'ACCEPT') AS valid_accepted,
  count(*) FILTER (WHERE validity = 'VALID' AND outcome = 'REJECT_INVALID') AS valid_rejected, count(*) FILTER (WHERE validity = 'VALID' AND outcome = 'REVIEW_UNCERTAIN') AS valid_review,
  count(*) FILTER (WHERE outcome = 'REVIEW_UNCERTAIN') AS reviews,
  count(*) FILTER (WHERE edits IS NOT NULL AND exact) AS exact_pages, count(*) FILTER (WHERE edits IS NOT NULL AND raw_exact) AS raw_exact_pages,
  coalesce(sum(edits), 0)::BIGINT AS edits, coalesce(sum(raw_edits), 0)::BIGINT AS raw_edits, coalesce(sum(characters) FILTER (WHERE edits IS NOT NULL), 0)::BIGINT AS characters,
  count(*) FILTER (WHERE edits IS NOT NULL AND outcome = 'ACCEPT') AS accepted_scorable, count(*) FILTER (WHERE edits IS NOT NULL AND outcome = 'ACCEPT' AND exact) AS accepted_exact,
  count(*) FILTER (WHERE outcome = expected_outcome) AS expected_met, count(*) FILTER (WHERE corrections > 0) AS corrected_images, sum(corrections)::BIGINT AS corrections,
  count(*) FILTER (WHERE edits > raw_edits) AS worsened_images"""
_MORE_SQL = """, count(*) FILTER (WHERE validity = 'INVALID' AND syntax_passes) AS invalid_syntax_passes, count(*) FILTER (WHERE preprocessing_failure) AS preprocessing_failures, count(*) FILTER (WHERE segmentation_failure) AS segmentation_failures,
  count(*) FILTER (WHERE ocr_failure) AS ocr_failures, count(*) FILTER (WHERE pipeline_exception IS NOT NULL) AS pipeline_exceptions, count(*) FILTER (WHERE raw_wrong_tier) AS raw_wrong_tier_images,
  count(*) FILTER (WHERE outcome = 'REVIEW_UNCERTAIN' AND wrong_tier) AS wrong_tier_reviews, coalesce(sum(correct_edits), 0)::BIGINT AS correct_edits, coalesce(sum(incorrect_edits), 0)::BIGINT AS incorrect_edits, coalesce(sum(unknown_edits), 0)::BIGINT AS unknown_edits"""
_JUDGED = (B.IMAGES_SQL, _R1, B.judged_sql("r1", "j1"))
_RATES_SQL = ", ".join(f"round({a}::DOUBLE / nullif({b}, 0), 6) AS {k}" for k, (a, b) in M.POLICY_RATES.items())


@query("a07_policy_metrics", with_ctes(f"SELECT *, {_RATES_SQL} FROM (SELECT variant, partition, {_COUNTS_SQL}{_MORE_SQL} FROM j1 GROUP BY variant, partition)", *_JUDGED))
def a07(spark, sf):
    return rounded(M.policy_metrics(B.judged_outcomes(spark, sf), ["variant", "partition"]))


@query("a07_rule_triggers", with_ctes("""
SELECT variant, code, count(*) AS images FROM (SELECT variant, unnest(list_filter([CASE WHEN wrong_tier THEN 'DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH' END, CASE WHEN low THEN 'LOW_CONFIDENCE' END, CASE WHEN unsafe THEN 'D1_NO_SAFE_PROPOSAL' END], lambda x: x IS NOT NULL)) AS code FROM r1)
GROUP BY variant, code""", B.IMAGES_SQL, _R1))
def a07b(spark, sf):
    return M.rule_triggers(B.outcomes(spark, sf), ["variant"])


_POLICY_SLICES = ["category", "paired_category", "variant", "length_group", "row_group"]


@query("a05_policy_slices", with_ctes(f"SELECT *, {_RATES_SQL} FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {_COUNTS_SQL}{_MORE_SQL} FROM j1 GROUP BY {d}" for d in _POLICY_SLICES
) + f" UNION ALL SELECT 'overall', 'all', {_COUNTS_SQL}{_MORE_SQL} FROM j1)", *_JUDGED))
def a05b(spark, sf):
    return rounded(M.policy_slices(B.judged_outcomes(spark, sf), _POLICY_SLICES))


_MACRO = ["true_invalid_rejection_rate", "invalid_accepted_rate", "valid_acceptance_rate", "valid_interpreted_cer", "accepted_output_correctness"]


@query("a08_macro_average", with_ctes(
    f"SELECT variant, count(*) AS owners, {', '.join(f'round(avg({r}), 6) AS macro_{r}' for r in _MACRO)} FROM (SELECT *, "
    + ", ".join(f"{M.POLICY_RATES[r][0]}::DOUBLE / nullif({M.POLICY_RATES[r][1]}, 0) AS {r}" for r in _MACRO)
    + f" FROM (SELECT variant, parent_id, {_COUNTS_SQL} FROM r1 GROUP BY variant, parent_id)) GROUP BY variant", B.IMAGES_SQL, _R1))
def a08(spark, sf):
    return rounded(M.macro_average(B.outcomes(spark, sf), "parent_id", _MACRO, ["variant"]))


@query("a09_worst_case", with_ctes("""
SELECT worst_case_level, count(*) AS parents FROM (
  SELECT parent_id, CASE WHEN bool_or((validity = 'INVALID' AND outcome = 'ACCEPT') OR (validity = 'VALID' AND outcome = 'REJECT_INVALID') OR (validity = 'VALID' AND outcome = 'ACCEPT' AND NOT exact)) THEN 'critical_failure'
    WHEN bool_or(outcome = 'REVIEW_UNCERTAIN') THEN 'unresolved_review' ELSE 'all_expected_correct' END AS worst_case_level FROM r1 GROUP BY parent_id) GROUP BY 1""", B.IMAGES_SQL, _R1))
def a09(spark, sf):
    return M.worst_case(B.outcomes(spark, sf), "parent_id").groupBy("worst_case_level").agg(F.count(F.lit(1)).alias("parents"))


def _pairs(spark, sf):
    a, b = B.outcomes(spark, sf, "R0"), B.outcomes(spark, sf, "R1")
    return P.paired(a, b, "image_id", ["parent_id", "validity", "raw_prediction", "truth"], ["outcome", "exact", "edits"])


@query("j11_paired_candidates", with_ctes("""
SELECT a.image_id, a.parent_id, a.validity, a.raw_prediction, a.truth, a.outcome AS outcome_a, a.exact AS exact_a, a.edits AS edits_a, b.outcome AS outcome_b, b.exact AS exact_b, b.edits AS edits_b
FROM r0 a JOIN r1 b ON a.image_id = b.image_id""", B.IMAGES_SQL, _R0, _R1))
def j11(spark, sf):
    return P.require_paired(_pairs(spark, sf), "image_id")


@query("j12_paired_degraded", with_ctes("""
SELECT *, round(edits::DOUBLE / nullif(characters, 0), 6) AS cer, round(clean_edits::DOUBLE / nullif(characters, 0), 6) AS clean_cer, round(exact::DOUBLE / nullif(paired, 0), 6) AS exact_accuracy,
  round(clean_exact::DOUBLE / nullif(paired, 0), 6) AS clean_exact_accuracy FROM (
  SELECT s.role, count(*) AS readings, count(c.p) AS paired, coalesce(sum(length(s.truth)) FILTER (c.p IS NOT NULL), 0)::BIGINT AS characters, coalesce(sum(levenshtein(s.truth, s.prediction)) FILTER (c.p IS NOT NULL), 0)::BIGINT AS edits,
    coalesce(sum(levenshtein(s.truth, c.p)), 0)::BIGINT AS clean_edits, count(*) FILTER (c.p IS NOT NULL AND s.truth = s.prediction) AS exact, count(*) FILTER (s.truth = c.p) AS clean_exact,
    count(*) FILTER (levenshtein(s.truth, s.prediction) > levenshtein(s.truth, c.p)) AS worsened
  FROM readings s LEFT JOIN (SELECT truth, role, min(prediction) AS p FROM readings WHERE cohort = 'O' AND candidate <> 'N' OR cohort = 'O' AND page % 3 = 0 GROUP BY ALL) c ON c.truth = s.truth AND c.role = s.role WHERE s.cohort = 'F' GROUP BY s.role)""", B.READINGS_SQL))
def j12(spark, sf):
    """Degraded readings against the clean reading of the same text and role."""
    r = B.readings(spark, sf)
    clean = r.where("cohort = 'O' and (candidate <> 'N' or page % 3 = 0)")
    return rounded(P.paired_scores(r.where("cohort = 'F'"), clean, ["truth", "role"], ["role"]))


@query("a10_transitions", with_ctes("""
SELECT a.validity, a.outcome AS outcome_a, b.outcome AS outcome_b, count(*) AS images, count(DISTINCT a.parent_id) AS parents
FROM r0 a JOIN r1 b ON a.image_id = b.image_id GROUP BY ALL""", B.IMAGES_SQL, _R0, _R1))
def a10(spark, sf):
    return P.transitions(_pairs(spark, sf), "validity", "outcome_a", "outcome_b", "parent_id")


_DELTAS = ["true_invalid_rejection_rate", "invalid_accepted_rate", "valid_acceptance_rate", "false_definitive_rejection_rate", "review_rate", "valid_interpreted_cer", "exact_transcription_accuracy"]


@query("a11_metric_deltas", with_ctes(
    f"""SELECT metric, round(f, 6) AS first, round(s, 6) AS second, round(s - f, 6) AS delta, metric IN ('invalid_accepted_rate', 'false_definitive_rejection_rate') AND coalesce(s - f, 0) > 0 AS critical_regression
FROM (SELECT unnest({_DELTAS}) AS metric, unnest(list_value({', '.join('a.' + d for d in _DELTAS)})) AS f, unnest(list_value({', '.join('b.' + d for d in _DELTAS)})) AS s FROM m0 a, m1 b)""",
    B.IMAGES_SQL, _R0, _R1, *[
        f"m{k} AS (SELECT " + ", ".join(f"{M.POLICY_RATES[d][0]}::DOUBLE / nullif({M.POLICY_RATES[d][1]}, 0) AS {d}" for d in _DELTAS) + f" FROM (SELECT {_COUNTS_SQL} FROM r{k}))" for k in (0, 1)
    ]))
def a11(spark, sf):
    both = B.outcomes(spark, sf, "R0").unionByName(B.outcomes(spark, sf, "R1"))
    return rounded(P.metric_deltas(M.policy_metrics(both, ["candidate"]), "candidate", "R0", "R1", _DELTAS))


_COHORT = ["partition", "variant"]


@query("a12_common_subset", with_ctes("""
, common AS (SELECT partition, variant, case_id FROM candidate_pages WHERE correct GROUP BY ALL HAVING count(DISTINCT candidate) = 3)
SELECT partition, variant, candidate, count(*) AS samples, count(*) FILTER (WHERE truth = prediction) AS exact_matches, sum(levenshtein(truth, prediction))::BIGINT AS edits, sum(length(truth))::BIGINT AS characters,
  round(sum(levenshtein(truth, prediction)) / sum(length(truth))::DOUBLE, 6) AS cer, round(count(*) FILTER (WHERE truth = prediction) / count(*)::DOUBLE, 6) AS exact_accuracy
FROM candidate_pages SEMI JOIN common USING (partition, variant, case_id) GROUP BY partition, variant, candidate""".strip(), B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a12(spark, sf):
    pages = B.candidate_pages(spark, sf)
    common = P.common_cases(pages, _COHORT, "case_id", "candidate", B.CANDIDATES, F.col("correct"))
    return rounded(P.common_metrics(M.score_pairs(pages), common, _COHORT, "case_id", "candidate"))


@query("a13_candidate_coverage", with_ctes("""
SELECT *, round(proposals::DOUBLE / pages, 6) AS proposal_coverage, round(correct_pages::DOUBLE / pages, 6) AS correct_coverage, round(correct_pages::DOUBLE / nullif(proposals, 0), 6) AS accepted_accuracy FROM (
SELECT partition, variant, candidate, count(*) AS pages, count(DISTINCT parent_id) AS parents, count(*) FILTER (WHERE proposal) AS proposals, count(*) FILTER (WHERE correct) AS correct_pages,
  count(*) FILTER (WHERE proposal AND NOT correct) AS wrong_acceptances, count(*) FILTER (WHERE NOT proposal) AS valid_rejections FROM candidate_pages GROUP BY ALL)""", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a13(spark, sf):
    return rounded(P.candidate_coverage(B.candidate_pages(spark, sf), [*_COHORT, "candidate"]))


@query("a14_parent_outcomes", with_ctes("""
SELECT partition, variant, candidate, count(DISTINCT CASE WHEN correct THEN parent_id END) AS parents_any_correct, count(DISTINCT CASE WHEN proposal AND NOT correct THEN parent_id END) AS parents_any_wrong,
  count(DISTINCT CASE WHEN NOT proposal THEN parent_id END) AS parents_any_rejection FROM candidate_pages GROUP BY ALL""", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a14(spark, sf):
    return P.parent_outcomes(B.candidate_pages(spark, sf), [*_COHORT, "candidate"])


@query("a15_parent_bootstrap", """
WITH change AS (SELECT l_suppkey AS parent, avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0 END) AS v FROM lineitem GROUP BY l_suppkey),
slots AS (SELECT v, row_number() OVER (ORDER BY md5(parent::VARCHAR), parent) - 1 AS slot, count(*) OVER () AS n FROM change),
draws AS (SELECT resample, ('0x' || substr(md5('42:' || resample || ':' || draw), 1, 12))::BIGINT % (SELECT count(*) FROM change) AS slot
          FROM (SELECT unnest(range(0, 2000)) AS resample), (SELECT unnest(range(0, (SELECT count(*) FROM change))) AS draw)),
means AS (SELECT resample, avg(v) AS m FROM draws JOIN slots USING (slot) GROUP BY resample)
SELECT (SELECT count(*) FROM change) AS parent_count, (SELECT round(avg(v), 6) FROM change) AS mean_change, round(quantile_cont(m, 0.025), 6) AS lower95, round(quantile_cont(m, 0.975), 6) AS upper95, 2000 AS resamples FROM means""")
def a15(spark, sf):
    """Interval of the change between two per-line marks, resampling whole suppliers 2,000 times."""
    li = B.table(spark, sf, "lineitem")
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    change = li.groupBy(F.col("l_suppkey").alias("parent")).agg((one(F.col("l_linestatus") == "O") - one(F.col("l_returnflag") != "R")).alias("v"))
    return rounded(P.parent_bootstrap(change, "parent", "v", 2000))


_READ = B.READINGS_SQL[: B.READINGS_SQL.index("scored AS")].rstrip().rstrip(",")


@query("a16_confusions", with_ctes("""
SELECT candidate, e[1] AS op, string_split(e, '~')[2] AS reference, string_split(e, '~')[3] AS predicted, sum(n)::BIGINT AS occurrences
FROM (SELECT candidate, n, unnest(list_filter(string_split(log, ';'), lambda x: x <> '')) AS e
      FROM aligned JOIN (SELECT candidate, truth, prediction, count(*) AS n FROM readings GROUP BY ALL) USING (truth, prediction)) GROUP BY ALL""",
    _READ, "pairs AS (SELECT truth, prediction FROM readings)", B.ALIGN_SQL, recursive=True))
def a16(spark, sf):
    return M.confusions(B.readings(spark, sf), ["candidate"])


@query("a17_reason_counts", with_ctes("""
SELECT 'DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH' AS reason_code, count(*) AS images FROM r1 WHERE wrong_tier UNION ALL SELECT 'LOW_CONFIDENCE', count(*) FROM r1 WHERE low
UNION ALL SELECT 'D1_NO_SAFE_PROPOSAL', count(*) FROM r1 WHERE unsafe""", B.IMAGES_SQL, _R1))
def a17(spark, sf):
    return M.reason_counts(B.outcomes(spark, sf), "reason_codes")


@query("a18_failure_categories", with_ctes("SELECT reason, count(*) AS pages, count(DISTINCT parent_id) AS parents, min(case_id) AS representative FROM candidate_pages WHERE reason <> 'ok' GROUP BY reason", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a18(spark, sf):
    return M.failure_categories(B.candidate_pages(spark, sf).where("reason <> 'ok'"), "reason", "parent_id", "case_id")


@query("a23_category_summary", with_ctes("""
SELECT category, count(*) AS rows, string_agg(DISTINCT variant, ';' ORDER BY variant) AS variant, string_agg(DISTINCT outcome, ';' ORDER BY outcome) AS outcome, string_agg(DISTINCT preprocessing_status, ';' ORDER BY preprocessing_status) AS preprocessing_status
FROM r1 GROUP BY category""", B.IMAGES_SQL, _R1))
def a23(spark, sf):
    return M.category_summary(B.outcomes(spark, sf), "category", ["variant", "outcome", "preprocessing_status"])


@query("a24_page_signals", "SELECT l_orderkey AS page, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(CASE WHEN l_quantity > 10 THEN l_extendedprice END) AS price FROM lineitem GROUP BY l_orderkey")
def a24(spark, sf):
    li = B.table(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")))
    return M.page_signals(li.withColumnRenamed("l_orderkey", "page"), "page", ["l_discount", "l_tax", "price"])


@query("a26_regression_gate", with_ctes("""
, m AS (SELECT cohort, candidate, sum(edits) / sum(characters)::DOUBLE AS cer, avg(exact::INT)::DOUBLE AS ex FROM (SELECT CASE role WHEN 'upper' THEN 'clean_upper' WHEN 'count' THEN 'long_count' ELSE 'positive_lower' END AS cohort, candidate, edits, characters, exact FROM scored) GROUP BY ALL)
SELECT a.cohort, round(a.cer, 6) AS cer, round(b.cer, 6) AS base_cer, a.cer <= b.cer + CASE WHEN a.cohort LIKE 'clean%' THEN 0.0005 WHEN a.cohort LIKE 'long%' THEN 0.002 ELSE 0.001 END + 1e-12 AS cer_ok,
  a.cohort NOT LIKE 'clean%' OR a.ex >= b.ex - 0.002 - 1e-12 AS exact_ok, cer_ok AND exact_ok AS passed
FROM m a JOIN m b ON a.cohort = b.cohort WHERE a.candidate = 'R' AND b.candidate = 'A'""".strip(), B.READINGS_SQL))
def a26(spark, sf):
    s = M.score_pairs(B.readings(spark, sf))
    named = s.withColumn("cohort", F.when(F.col("role") == "upper", "clean_upper").when(F.col("role") == "count", "long_count").otherwise("positive_lower"))
    m = M.recognition_metrics(named.where("candidate in ('A', 'R')"), ["cohort", "candidate"])
    gate = P.regression_gate(m.where("candidate = 'R'"), m.where("candidate = 'A'"), ["cohort"], {"clean": (0.0005, 0.002), "long": (0.002, None)}, (0.001, None))
    return rounded(gate)


@query("a27_candidate_selection", with_ctes("""
, g AS (SELECT candidate, variant, count(*) FILTER (WHERE correct) AS c, count(*) FILTER (WHERE proposal AND NOT correct) AS w FROM candidate_pages GROUP BY ALL),
r AS (SELECT a.candidate, sum(a.c)::BIGINT AS correct, sum(a.w)::BIGINT AS wrong, bool_and(a.c >= 0.95::DOUBLE * b.c) AND sum(a.w) <= 0.5::DOUBLE * sum(b.w) AS safety_gate FROM g a JOIN g b ON a.variant = b.variant AND b.candidate = 'C5' WHERE a.candidate <> 'C5' GROUP BY a.candidate)
SELECT * FROM r ORDER BY NOT safety_gate, CASE WHEN safety_gate THEN -correct ELSE wrong END, CASE WHEN safety_gate THEN wrong ELSE -correct END, candidate LIMIT 1""".strip(), B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a27(spark, sf):
    """Best candidate against the baseline C5 (one row is the answer)."""
    return P.select_candidate(B.candidate_pages(spark, sf), "candidate", "C5", "variant").limit(1)


@query("a28_readiness_buckets", with_ctes("""
SELECT bucket, reason, count(*) AS images, count(DISTINCT parent_id) AS parents FROM (
  SELECT parent_id, CASE WHEN partition <> 'tuning' THEN 'excluded' WHEN correct AND truth = prediction THEN 'training_ready' ELSE 'manual_review' END AS bucket,
    CASE WHEN partition <> 'tuning' THEN 'parent_isolation' WHEN correct AND truth = prediction THEN 'checks_passed' WHEN NOT proposal THEN 'segmentation_rejected' WHEN NOT correct THEN 'verification_failed' ELSE 'content_review' END AS reason
  FROM candidate_pages WHERE candidate = 'C5') GROUP BY ALL""", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a28(spark, sf):
    c = F.col
    rules = [
        ("excluded", "parent_isolation", c("partition") != "tuning"), ("training_ready", "checks_passed", c("correct") & (c("truth") == c("prediction"))),
        ("manual_review", "segmentation_rejected", ~c("proposal")), ("manual_review", "verification_failed", ~c("correct")), ("manual_review", "content_review", F.lit(True)),
    ]
    return P.readiness_buckets(B.candidate_pages(spark, sf).where("candidate = 'C5'"), rules, "parent_id")


@query("a29_hit_summary", with_ctes("""
, h AS (SELECT parent_id, unnest(['row', 'tier', 'column']) AS metric, unnest([segmentation_accepted, ocr_status = 'ok' IS TRUE, role_margin IS NOT NULL]) AS e,
   unnest([price > 100000, exact, coalesce(role_margin > 0.3, false)]) AS h FROM r1 WHERE validity = 'INVALID' AND outcome = 'REVIEW_UNCERTAIN')
SELECT metric, count(*) AS denominator, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e AND h) AS hits, count(DISTINCT CASE WHEN e THEN parent_id END) AS eligible_parents,
  round(count(*) FILTER (WHERE e)::DOUBLE / count(*), 6) AS coverage, round(count(*) FILTER (WHERE e AND h)::DOUBLE / nullif(count(*) FILTER (WHERE e), 0), 6) AS conditional_accuracy, round(count(*) FILTER (WHERE e AND h)::DOUBLE / count(*), 6) AS full_recall
FROM h GROUP BY metric""".strip(), B.IMAGES_SQL, _R1))
def a29(spark, sf):
    c = F.col
    marked = B.outcomes(spark, sf).withColumns({
        "row_eligible": c("segmentation_accepted"), "row_hit": c("price") > 100000, "tier_eligible": F.coalesce(c("ocr_status") == "ok", F.lit(False)), "tier_hit": c("exact"),
        "column_eligible": c("role_margin").isNotNull(), "column_hit": F.coalesce(c("role_margin") > 0.3, F.lit(False)),
    })
    return rounded(M.hit_summary(marked, ["row", "tier", "column"], "parent_id", (c("validity") == "INVALID") & (c("outcome") == "REVIEW_UNCERTAIN")))


@query("a30_error_sizes", """
SELECT l_returnflag, count(*) AS rows, round(quantile_cont(abs(e), 0.5), 6) AS median_absolute, round(quantile_cont(abs(e), 0.95), 6) AS p95_absolute, round(avg(e), 4) AS signed_mean,
  round(quantile_cont(abs(e) / s, 0.5), 6) AS median_normalized, round(quantile_cont(abs(e) / s, 0.95), 6) AS p95_normalized, round(sum(m)::DOUBLE / sum(q), 6) AS coverage
FROM (SELECT l_returnflag, l_extendedprice / l_quantity - p_retailprice AS e, p_retailprice AS s, CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT ELSE 0 END AS m, l_quantity::BIGINT AS q FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_returnflag""")
def a30(spark, sf):
    """Unit price of a line against the list price of its part, as it is and in parts of the list price; open pieces of all pieces."""
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    e = B.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity").join(part, "l_partkey")
    pieces = F.col("l_quantity").cast("long")
    e = e.select("l_returnflag", "p_retailprice", (F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")).alias("e"), F.when(F.col("l_linestatus") == "O", pieces).otherwise(0).alias("open"), pieces.alias("pieces"))
    sized = M.error_sizes(e, "e", ["l_returnflag"], scale="p_retailprice", covered=("open", "pieces"))
    return rounded(sized).withColumn("signed_mean", F.round("signed_mean", 4))


_FLAGS_SQL = """
SELECT flag, count(*) AS images, count(DISTINCT parent_id) AS parents FROM (
  SELECT parent_id, unnest(list_filter([{items}], lambda x: x IS NOT NULL)) AS flag FROM r1) GROUP BY flag"""


def _flag_items(flags: dict[str, str]) -> str:
    return _FLAGS_SQL.format(items=", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in flags.items()))


@query("a31_flag_table", with_ctes(_flag_items({
    "positioned": "role_margin IS NOT NULL", "single_alternative": "legal_alternatives = 1", "accepted_but_invalid": "validity = 'INVALID' AND outcome = 'ACCEPT'",
    "changed": "corrections > 0", "all_good": "exact AND outcome = expected_outcome"}), B.IMAGES_SQL, _R1))
def a31(spark, sf):
    c = F.col
    flags = {
        "positioned": c("role_margin").isNotNull(), "single_alternative": c("legal_alternatives") == 1, "accepted_but_invalid": (c("validity") == "INVALID") & (c("outcome") == "ACCEPT"),
        "changed": c("corrections") > 0, "all_good": c("exact") & (c("outcome") == c("expected_outcome")),
    }
    return M.flag_table(B.outcomes(spark, sf), flags, "parent_id")


@query("a33_failure_groups", with_ctes(_flag_items({
    "invalid_accepted": "validity = 'INVALID' AND outcome = 'ACCEPT'", "invalid_review": "validity = 'INVALID' AND outcome = 'REVIEW_UNCERTAIN'", "valid_rejected": "validity = 'VALID' AND outcome = 'REJECT_INVALID'",
    "valid_review": "validity = 'VALID' AND outcome = 'REVIEW_UNCERTAIN'", "correctly_rejected_invalid": "validity = 'INVALID' AND outcome = 'REJECT_INVALID'",
    "valid_accepted_wrong_transcription": "validity = 'VALID' AND outcome = 'ACCEPT' AND NOT exact", "segmentation_failures": "segmentation_failure", "preprocessing_failures": "preprocessing_failure",
    "decoding_failures": "ocr_failure", "pipeline_exceptions": "pipeline_exception IS NOT NULL", "wrong_tier_text": "wrong_tier", "contextual_corrections": "corrections > 0", "unscorable_or_ambiguous": "uncertain"}), B.IMAGES_SQL, _R1))
def a33(spark, sf):
    return M.flag_table(B.outcomes(spark, sf), M.failure_flags(), "parent_id")


_TAGS = """tagged AS (SELECT s.*, unnest(string_split(tags, ';')) AS tag FROM (SELECT truth, edits, characters, exact, replace(truth, ' ', ';') || ';' || role AS tags FROM scored) s)"""


@query("a34_tag_metrics", with_ctes(f"SELECT tag, {_METRICS} FROM tagged GROUP BY tag", B.READINGS_SQL, _TAGS))
def a34(spark, sf):
    """Scores per word of the part name and per tier (a reading has several tags)."""
    s = M.score_pairs(B.readings(spark, sf)).withColumn("tags", F.concat_ws(";", F.replace("truth", F.lit(" "), F.lit(";")), "role"))
    return rounded(M.tag_metrics(s, "tags"))


@query("a35_coverage_transitions", with_ctes("""
SELECT b.partition, b.variant, count(*) AS scans, count(*) FILTER (WHERE b.correct) AS scans_ok, count(*) FILTER (WHERE a.correct AND NOT b.correct) AS newly_failed, count(*) FILTER (WHERE NOT a.correct AND NOT b.correct) AS already_failed
FROM candidate_pages a JOIN candidate_pages b ON a.case_id = b.case_id WHERE a.candidate = 'C5' AND b.candidate = 'C4' GROUP BY ALL""", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def a35(spark, sf):
    p = B.candidate_pages(spark, sf)
    return P.coverage_transitions(p.where("candidate = 'C5'"), p.where("candidate = 'C4'"), ["case_id"], _COHORT, "correct")


# -- order, limits, sets -----------------------------------------------------

@query("o01_total_order", """
SELECT o_orderkey, o_orderpriority, o_totalprice, rank::BIGINT AS place FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS rank FROM orders)""")
def o01(spark, sf):
    """Place of every order in the total order (priority, key), numbered without a global window."""
    from tierlens.operators.ranking import rank_within

    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    bucket = F.concat(F.col("o_orderpriority"), F.lit("|"), F.lpad(F.floor(F.col("o_orderkey") / 4096).cast("string"), 16, "0"))
    return rank_within(o, [], bucket, [F.col("o_orderpriority"), F.col("o_orderkey")], "place")


@query("o02_gated_sort", "SELECT s_suppkey, s_acctbal, place FROM (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY NOT (s_acctbal > 0), s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place <= 25")
def o02(spark, sf):
    """Top 25 under a boolean gate and descending balance (a top-k report)."""
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    key = [(~(F.col("s_acctbal") > 0)).cast("int"), F.col("s_acctbal").desc(), F.col("s_suppkey")]
    top = s.orderBy(*key).limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*key)).cast("long"))


@query("o03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o03(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("o04_candidate_union", with_ctes("SELECT candidate, image_id, outcome, exact, NULL::VARCHAR AS note FROM r0 UNION ALL SELECT candidate, image_id, outcome, exact, category FROM r1", B.IMAGES_SQL, _R0, _R1))
def o04(spark, sf):
    cols = ["candidate", "image_id", "outcome", "exact"]
    b = B.outcomes(spark, sf, "R1").select(*cols, F.col("category").alias("note"))
    return B.outcomes(spark, sf, "R0").select(*cols).unionByName(b, allowMissingColumns=True)


@query("o07_common_success", with_ctes("SELECT partition, variant, case_id FROM candidate_pages WHERE correct GROUP BY ALL HAVING count(DISTINCT candidate) = 3", B.IMAGES_SQL, B.CANDIDATE_PAGES_SQL))
def o07(spark, sf):
    """Cases in the success sets of all candidates, by one count instead of chained intersections."""
    return P.common_cases(B.candidate_pages(spark, sf), _COHORT, "case_id", "candidate", B.CANDIDATES, F.col("correct"))


@query("o08_distinct_inputs", with_ctes("SELECT page, row, role, truth, prediction, levenshtein(truth, prediction) AS edits, count(*) AS copies FROM readings GROUP BY ALL", _READ))
def o08(spark, sf):
    """Every distinct input is computed once and joined back."""
    s = M.score_pairs(B.readings(spark, sf))
    return s.groupBy("page", "row", "role", "truth", "prediction", "edits").agg(F.count(F.lit(1)).alias("copies"))


@query("w13_worst_categories", with_ctes("""
SELECT cohort, tag, cer, worst_rank::INT AS worst_rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY cer DESC, tag) AS worst_rank FROM (
  SELECT cohort, tag, round(sum(edits) / sum(characters)::DOUBLE, 6) AS cer FROM (SELECT cohort, edits, characters, unnest(string_split(truth, ' ')) AS tag FROM scored) GROUP BY ALL)) WHERE worst_rank <= 5""", B.READINGS_SQL))
def w13(spark, sf):
    """The five words with the highest error rate per cohort."""
    s = M.score_pairs(B.readings(spark, sf)).withColumn("tag", F.explode(F.split("truth", " ")))
    rates = s.groupBy("cohort", "tag").agg(F.round(ratio(F.sum("edits"), F.sum("characters")), 6).alias("cer"))
    return top_examples(rates, ["cohort"], 5, [F.col("cer").desc(), F.col("tag")]).withColumnRenamed("example_rank", "worst_rank")
