"""Paired comparison of candidates: coverage, transitions, deltas, gates, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions.labels import named_issues, ratio
from tierlens.operators.metrics import recognition_metrics
from tierlens.operators.ranking import exact_quantiles, rank_within
from tierlens.session import join_null_safe, materialize


def paired(a: DataFrame, b: DataFrame, key: str, same: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Records of two candidates side by side; a gap or drifted input is an error row by row."""
    left = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in same], *[F.col(v).alias(f"{v}_a") for v in values], F.lit(1).alias("_ina"))
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in same], *[F.col(v).alias(f"{v}_b") for v in values], F.lit(1).alias("_inb"))
    joined = left.join(right, key, "full_outer")
    checks = [("missing_in_a", F.col("_ina").isNull()), ("missing_in_b", F.col("_inb").isNull())]
    both = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    checks += [(f"{c}_differs", both & ~F.equal_null(F.col(f"_a_{c}"), F.col(f"_b_{c}"))) for c in same]
    return joined.select(
        key, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in same],
        *[f"{v}_a" for v in values], *[f"{v}_b" for v in values], named_issues(checks).alias("pair_issues"),
    )


def require_paired(pairs: DataFrame, key: str) -> DataFrame:
    """Only complete pairs may be compared; anything else stops the job."""
    fault = F.concat(F.lit("unpaired record "), F.col(key).cast("string"))
    return pairs.withColumn(key, F.when(F.size("pair_issues") > 0, F.raise_error(fault)).otherwise(F.col(key))).drop("pair_issues")


def transitions(pairs: DataFrame, validity: str, before: str, after: str, owner: str) -> DataFrame:
    return pairs.groupBy(validity, before, after).agg(F.count(F.lit(1)).alias("images"), F.countDistinct(owner).alias("parents"))


ALLOWED = {"ACCEPT": ("ACCEPT", "REVIEW_UNCERTAIN"), "REVIEW_UNCERTAIN": ("REVIEW_UNCERTAIN",), "REJECT_INVALID": ("REJECT_INVALID",)}


def monotonicity_violations(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Outcome changes a review-only policy may not make."""
    legal = F.lit(False)
    for b, options in ALLOWED.items():
        legal = legal | ((F.col(before) == b) & F.col(after).isin(*options))
    return pairs.where(~F.coalesce(legal, F.lit(False)))


def metric_deltas(metrics: DataFrame, candidate: str, first: str, second: str, names: Sequence[str]) -> DataFrame:
    """second minus first for every metric, null where either is null."""
    pick = lambda who, m: F.max(F.when(F.col(candidate) == who, F.col(m)))
    wide = metrics.agg(*[pick(first, m).alias(f"a_{m}") for m in names], *[pick(second, m).alias(f"b_{m}") for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("first"), F.col(f"b_{m}").alias("second")) for m in names])
    long = wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.col("second") - F.col("first"))
    watched = F.col("metric").isin("invalid_accepted_rate", "false_definitive_rejection_rate")
    return long.withColumn("critical_regression", watched & (F.coalesce("delta", F.lit(0.0)) > 0))


def common_cases(pages: DataFrame, cohort: Sequence[str], case: str, candidate: str, candidates: Sequence[str], ok: Column) -> DataFrame:
    """Cases of a cohort that every candidate solved."""
    solved = F.countDistinct(F.when(ok & F.col(candidate).isin(*candidates), F.col(candidate)))
    return pages.groupBy(*cohort, case).agg(solved.alias("_n")).where(F.col("_n") == len(candidates)).select(*cohort, case)


def common_metrics(scored: DataFrame, common: DataFrame, cohort: Sequence[str], case: str, candidate: str) -> DataFrame:
    """Recognition metrics of each candidate on the common cases."""
    return recognition_metrics(scored.join(common, [*cohort, case], "left_semi"), [*cohort, candidate])


def candidate_coverage(pages: DataFrame, by: Sequence[str], owner: str = "parent_id") -> DataFrame:
    """Pages, proposals, correct, wrong acceptances, safe rejections and their rates."""
    c = F.col
    wrong = c("proposal") & ~c("correct")
    sums = pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct(owner).alias("parents"),
        F.count_if("proposal").alias("proposals"), F.count_if("correct").alias("correct_pages"),
        F.count_if(wrong).alias("wrong_acceptances"), F.count_if(~c("proposal")).alias("valid_rejections"),
    )
    return sums.select(
        "*", ratio(c("proposals"), c("pages")).alias("proposal_coverage"),
        ratio(c("correct_pages"), c("pages")).alias("correct_coverage"),
        ratio(c("correct_pages"), c("proposals")).alias("accepted_accuracy"),
    )


def parent_outcomes(pages: DataFrame, by: Sequence[str], owner: str = "parent_id") -> DataFrame:
    """Distinct parents with any correct, any wrong and any rejected page."""
    c = F.col
    who = lambda cond: F.countDistinct(F.when(cond, c(owner)))
    return pages.groupBy(*by).agg(
        who(c("correct")).alias("parents_any_correct"),
        who(c("proposal") & ~c("correct")).alias("parents_any_wrong"),
        who(~c("proposal")).alias("parents_any_rejection"),
    )


#: Draws that one step of a resample lists at once.
_DRAW_BLOCK = 4_096
#: Parents up to which their values are broadcast (some 40 MB); the draws of more are shuffled.
_BROADCAST_PARENTS = 1_000_000


def parent_bootstrap(change: DataFrame, owner: str, value: str, resamples: int, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean change under resampling whole parents.

    Each resample draws as many parents as there are, with replacement.  Draw k
    of resample b takes the parent whose rank is a hash of (seed, b, k), so the
    result does not depend on the partitioning.  A resample's draws are made
    and summed in one task, none of them is shuffled while the parents' values
    can be broadcast; only sums and counts are kept for the quantiles.  Which
    side is broadcast is said here: Spark sizes the draws, an explode, by the
    resamples and would send them all to the driver.
    """
    spark = change.sparkSession
    hashed = materialize(change.select(owner, value, F.md5(F.col(owner).cast("string")).alias("_h")), "bootstrap-parents")
    ranked = rank_within(hashed, [], F.substr("_h", F.lit(1), F.lit(3)), [F.col("_h"), F.col(owner)], "_r")
    values = materialize(ranked.select((F.col("_r") - 1).alias("_slot"), value), "bootstrap-values")
    exact = F.sum(F.col(value).cast("decimal(38,18)")).cast("double")  # the digits of a sum of doubles depend on the partitioning
    owners = hashed.agg(F.count(F.lit(1)).alias("n"), (exact / F.nullif(F.count(value), F.lit(0))).alias("m"))
    drawing = (
        spark.range(resamples).withColumnRenamed("id", "resample")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "resample")
        .withColumn("_n", owners.select("n").scalar()).where("_n > 0")
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_DRAW_BLOCK).cast("long"))))
        .withColumn("draw", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (_DRAW_BLOCK - 1), F.col("_n") - 1))))
    )
    pick = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(seed), "resample", "draw")), F.lit(1), F.lit(12)), 16, 10).cast("long")
    looked_up = F.broadcast(values) if values.count() <= _BROADCAST_PARENTS else values.hint("merge")
    drawn = drawing.select("resample", (pick % F.col("_n")).alias("_slot")).join(looked_up, "_slot")
    # one row per resample; the quantiles read them several times
    means = materialize(drawn.groupBy("resample").agg(F.avg(value).alias("_mean")), "resample-means")
    limits = exact_quantiles(means, "_mean", {"lower95": 0.025, "upper95": 0.975})
    return limits.select(
        owners.select(F.struct("n", "m")).scalar().alias("_o"), "lower95", "upper95", F.lit(resamples).alias("resamples")
    ).select(F.col("_o.n").alias("parent_count"), F.col("_o.m").alias("mean_change"), "lower95", "upper95", "resamples")


def paired_scores(degraded: DataFrame, clean: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scores of degraded readings and of the clean reading of the same key, over the readings that have one.

    Both sides have truth and prediction; the clean side's prediction is scored
    against the degraded side's truth.  Of several clean readings of a key
    the smallest text counts.  Readings without a clean one are counted only.
    """
    known = clean.groupBy(*keys).agg(F.min("prediction").alias("_clean"), F.lit(True).alias("_paired"))
    joined = join_null_safe(degraded, known, keys, "left")
    pair = F.coalesce("_paired", F.lit(False))
    edits, clean_edits = F.levenshtein("truth", "prediction"), F.levenshtein("truth", "_clean")
    scored = joined.select(
        *by, pair.alias("_p"), F.when(pair, F.length("truth")).alias("_c"), F.when(pair, edits).alias("_e"), F.when(pair, clean_edits).alias("_k"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("_p").alias("paired"), total("_c").alias("characters"), total("_e").alias("edits"), total("_k").alias("clean_edits"),
        F.count_if(F.col("_e") == 0).alias("exact"), F.count_if(F.col("_k") == 0).alias("clean_exact"), F.count_if(F.col("_e") > F.col("_k")).alias("worsened"),
    )
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    return sums.select(
        "*", rate("edits", "characters").alias("cer"), rate("clean_edits", "characters").alias("clean_cer"),
        rate("exact", "paired").alias("exact_accuracy"), rate("clean_exact", "paired").alias("clean_exact_accuracy"),
    )


def regression_gate(metrics: DataFrame, baseline: DataFrame, by: Sequence[str], limits: dict[str, tuple[float, float | None]], default: tuple[float, float | None]) -> DataFrame:
    """Per cohort: CER may rise and exact rate may fall only within the limits of its class.

    `limits` maps a cohort prefix to (CER rise, exact fall or None).
    """
    base = baseline.select(*by, F.col("cer").alias("base_cer"), F.col("exact_accuracy").alias("base_exact"))
    joined = metrics.join(base, list(by))
    rise, fall = F.lit(default[0]), F.lit(default[1]).cast("double")
    for prefix, (r, f) in limits.items():
        here = F.startswith(F.col(by[0]), F.lit(prefix))
        rise = F.when(here, F.lit(r)).otherwise(rise)
        fall = F.when(here, F.lit(f).cast("double")).otherwise(fall)
    cer_ok = F.col("cer") <= F.col("base_cer") + rise + 1e-12
    exact_ok = fall.isNull() | (F.col("exact_accuracy") >= F.col("base_exact") - fall - 1e-12)
    return joined.select(*by, "cer", "base_cer", cer_ok.alias("cer_ok"), exact_ok.alias("exact_ok"), (cer_ok & exact_ok).alias("passed"))


def select_candidate(pages: DataFrame, candidate: str, baseline: str, group: str, keep: float = 0.95, wrong_share: float = 0.5) -> DataFrame:
    """Ranks candidates: those inside the safety gate first, by correct pages; others by fewest wrong.

    The gate asks for at most `wrong_share` of the baseline's wrong acceptances
    and at least `keep` of its correct pages in every group.
    """
    c = F.col
    cells = pages.groupBy(candidate, group).agg(
        F.count_if("correct").alias("correct"), F.count_if(c("proposal") & ~c("correct")).alias("wrong")
    )
    base = cells.where(c(candidate) == baseline).select(group, c("correct").alias("_bc"), c("wrong").alias("_bw"))
    joined = cells.join(base, group)
    ranking = joined.groupBy(candidate).agg(
        F.sum("correct").alias("correct"), F.sum("wrong").alias("wrong"),
        (F.bool_and(c("correct") >= keep * c("_bc")) & (F.sum("wrong") <= wrong_share * F.sum("_bw"))).alias("safety_gate"),
    ).where(c(candidate) != baseline)
    gate = c("safety_gate")
    first = F.when(gate, -c("correct")).otherwise(c("wrong"))
    second = F.when(gate, c("wrong")).otherwise(-c("correct"))
    return ranking.orderBy((~gate).cast("int"), first, second, candidate)


def readiness_buckets(pages: DataFrame, rules: Sequence[tuple[str, str, Column]], owner: str) -> DataFrame:
    """Images and parents per (bucket, reason); the first rule that holds decides."""
    chosen = F.coalesce(*[F.when(cond, F.struct(F.lit(b).alias("bucket"), F.lit(r).alias("reason"))) for b, r, cond in rules])
    return pages.withColumn("_b", chosen).groupBy("_b.bucket", "_b.reason").agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct(owner).alias("parents")
    )


def coverage_transitions(clean: DataFrame, scan: DataFrame, keys: Sequence[str], by: Sequence[str], ok: str) -> DataFrame:
    """Scans that failed although the clean page worked, and those where both failed."""
    joined = scan.join(clean.select(*keys, F.col(ok).alias("_clean_ok")), list(keys))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(ok).alias("scans_ok"),
        F.count_if(F.col("_clean_ok") & ~F.col(ok)).alias("newly_failed"),
        F.count_if(~F.col("_clean_ok") & ~F.col(ok)).alias("already_failed"),
    )


def leave_one_out(df: DataFrame, group: str, folds: Sequence) -> DataFrame:
    """Training rows of every fold: a row goes to all folds whose held-out group is not its own.

    The folds are a named short list, so rows are expanded in place without a join.
    """
    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(group))
    return df.withColumn("fold", F.explode(others))


def fold_sizes(df: DataFrame, group: str) -> DataFrame:
    """Training and held-out rows per fold without expanding the rows."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("heldout_rows"))
    total = counts.agg(F.sum("heldout_rows").alias("t")).scalar()
    return counts.select(F.col(group).alias("fold"), "heldout_rows", (total - F.col("heldout_rows")).alias("train_rows"))


def box_overlaps(regions: DataFrame, boxes: DataFrame, key: Sequence[str], cell: int = 64) -> DataFrame:
    """Boxes with a flag whether any region of the same page overlaps them.

    Every box is a row of its own, also where two are alike.  Both sides are laid on a grid and joined per grid cell, so a crowded page
    is split over its cells and only neighbours are compared.
    """
    c = F.col
    span = lambda lo, hi: F.sequence(F.floor(c(lo) / cell), F.floor(c(hi) / cell))
    grid = lambda df: df.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    sides = ("x0", "y0", "x1", "y1")
    r = grid(regions.select(*key, *sides).distinct()).select(*key, "_cx", "_cy", *[c(s).alias(f"_{s}") for s in sides])
    # written as four comparisons: greatest and least would skip the nulls of a box without neighbours
    hit = (c("x0") < c("_x1")) & (c("_x0") < c("x1")) & (c("y0") < c("_y1")) & (c("_y0") < c("y1"))
    joined = join_null_safe(grid(boxes.withColumn("_box", F.monotonically_increasing_id())), r, [*key, "_cx", "_cy"], "left")
    return joined.groupBy("_box", *boxes.columns).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit")).drop("_box")
