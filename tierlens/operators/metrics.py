"""Recognition scores, policy metrics and grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions.codes import WRONG_GLYPH
from tierlens.functions.distance import assess_correction, edit_distance, edit_events
from tierlens.functions.labels import named_issues, ratio
from tierlens.operators.ranking import exact_quantiles
from tierlens.session import join_null_safe

OUTCOMES = ("ACCEPT", "REJECT_INVALID", "REVIEW_UNCERTAIN")


def score_pairs(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction", ignore_ws: bool = False) -> DataFrame:
    """Adds edits, characters and exact per pair, in the projection.

    A reading without text keeps its row: edits and exact are null and it
    counts as a sample.
    """
    return (
        pairs.withColumn("edits", edit_distance(F.col(truth), F.col(prediction), ignore_ws))
        .withColumn("characters", F.length(truth))
        .withColumn("exact", F.col(truth) == F.col(prediction))
    )


def recognition_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("samples"),
        F.count_if("exact").alias("exact_matches"),
        F.sum("edits").cast("long").alias("edits"),
        F.sum("characters").cast("long").alias("characters"),
    ]


def with_rates(sums: DataFrame, empty: str = "null") -> DataFrame:
    return sums.withColumn("cer", ratio(F.col("edits"), F.col("characters"), empty)).withColumn(
        "exact_accuracy", ratio(F.col("exact_matches"), F.col("samples"), empty)
    )


def recognition_metrics(scored: DataFrame, by: Sequence[str] = (), empty: str = "null") -> DataFrame:
    """Micro-averaged character error rate and exact rate per group."""
    return with_rates(scored.groupBy(*by).agg(*recognition_sums()), empty)


def metric_slices(scored: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Overall and one-dimension slices in one pass over the rows (grouping sets)."""
    sets = [[]] + [[F.col(d)] for d in dimensions]
    sums = scored.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        *recognition_sums(), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    name, value = F.lit("overall"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return with_rates(sums.withColumn("dimension", name).withColumn("value", value)).select(
        "dimension", "value", "samples", "exact_matches", "edits", "characters", "cer", "exact_accuracy"
    )


def page_errors(truth: DataFrame, prediction: DataFrame, page: str, keys: Sequence[str], text: str) -> DataFrame:
    """Edits over the union of truth and predicted tiers per page, page-exact flag."""
    a = truth.select(page, *keys, F.col(text).alias("truth"))
    b = prediction.select(page, *keys, F.col(text).alias("prediction"))
    joined = a.join(b, [page, *keys], "full_outer").select(
        page, F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("prediction", F.lit("")).alias("prediction"),
        F.equal_null("truth", "prediction").alias("same"),
    )
    return joined.groupBy(page).agg(
        F.sum(F.levenshtein("truth", "prediction")).cast("long").alias("edits"),
        F.sum(F.length("truth")).cast("long").alias("characters"),
        F.bool_and("same").alias("exact"),
    )


def confusions(pairs: DataFrame, by: Sequence[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Edit operations counted by group, reference and predicted character.

    Pairs are merged with their multiplicity before they are aligned.
    """
    merged = pairs.groupBy(*by, truth, prediction).agg(F.count(F.lit(1)).alias("_n"))
    wrong = merged.where(F.col(truth) != F.col(prediction))
    aligned = wrong.select(truth, prediction).distinct().withColumn("_e", edit_events(F.col(truth), F.col(prediction)))
    events = wrong.join(aligned, [truth, prediction]).select(*by, "_n", F.explode("_e").alias("e"))
    return events.groupBy(*by, "e.op", "e.reference", "e.predicted").agg(F.sum("_n").cast("long").alias("occurrences"))


# -- policy outcomes ---------------------------------------------------------

def three_way(df: DataFrame, validity: str = "validity", outcome: str = "outcome") -> DataFrame:
    """Validity by outcome counts, zero where nothing fell."""
    return df.groupBy(validity).pivot(outcome, list(OUTCOMES)).agg(F.count(F.lit(1))).na.fill(0, list(OUTCOMES))


def policy_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Counts behind the policy rates, by name (aggregate expressions).

    Needs validity, outcome, expected_outcome, raw_edits, edits, characters,
    raw_exact, exact, reason_codes, corrections.  Counted where the table has
    them: correct_edits, incorrect_edits, unknown_edits (of edit_verdict_counts),
    interpreted_syntax, raw_reason_codes, preprocessing_failure,
    segmentation_failure, ocr_failure, pipeline_exception.
    """
    c = F.col
    have = lambda name, value: value if name in columns else F.lit(False)
    many = lambda name: F.coalesce(F.sum(c(name)), F.lit(0)).cast("long") if name in columns else F.lit(0).cast("long")
    valid, invalid = c("validity") == "VALID", c("validity") == "INVALID"
    scorable = valid & c("edits").isNotNull() & (c("characters") > 0)
    accept, reject, review = [c("outcome") == o for o in OUTCOMES]
    n = F.count_if
    total = lambda col, cond: F.coalesce(F.sum(F.when(cond, col)), F.lit(0)).cast("long")
    return {
        "images": F.count(F.lit(1)),
        "valid": n(valid), "invalid": n(invalid), "scorable": n(scorable),
        "invalid_rejected": n(invalid & reject), "invalid_accepted": n(invalid & accept), "invalid_review": n(invalid & review),
        "valid_accepted": n(valid & accept), "valid_rejected": n(valid & reject), "valid_review": n(valid & review),
        "reviews": n(review),
        "exact_pages": n(scorable & c("exact")), "raw_exact_pages": n(scorable & c("raw_exact")),
        "edits": total(c("edits"), scorable), "raw_edits": total(c("raw_edits"), scorable),
        "characters": total(c("characters"), scorable),
        "accepted_scorable": n(scorable & accept), "accepted_exact": n(scorable & accept & c("exact")),
        "expected_met": n(c("outcome") == c("expected_outcome")),
        "corrected_images": n(c("corrections") > 0), "corrections": F.sum("corrections").cast("long"),
        "worsened_images": n(scorable & (c("edits") > c("raw_edits"))),
        "invalid_syntax_passes": n(invalid & have("interpreted_syntax", c("interpreted_syntax") == "ACCEPT")),
        "preprocessing_failures": n(have("preprocessing_failure", c("preprocessing_failure"))), "segmentation_failures": n(have("segmentation_failure", c("segmentation_failure"))),
        "ocr_failures": n(have("ocr_failure", c("ocr_failure"))), "pipeline_exceptions": n(have("pipeline_exception", c("pipeline_exception").isNotNull())),
        "raw_wrong_tier_images": n(have("raw_reason_codes", F.array_contains("raw_reason_codes", WRONG_GLYPH))),
        "wrong_tier_reviews": n(review & F.array_contains(c("reason_codes").cast("array<string>"), WRONG_GLYPH)),
        "correct_edits": many("correct_edits"), "incorrect_edits": many("incorrect_edits"), "unknown_edits": many("unknown_edits"),
    }


POLICY_RATES = {
    "true_invalid_rejection_rate": ("invalid_rejected", "invalid"),
    "invalid_accepted_rate": ("invalid_accepted", "invalid"),
    "invalid_review_rate": ("invalid_review", "invalid"),
    "valid_acceptance_rate": ("valid_accepted", "valid"),
    "false_definitive_rejection_rate": ("valid_rejected", "valid"),
    "valid_review_rate": ("valid_review", "valid"),
    "review_rate": ("reviews", "images"),
    "exact_transcription_accuracy": ("exact_pages", "scorable"),
    "raw_exact_transcription_accuracy": ("raw_exact_pages", "scorable"),
    "valid_raw_cer": ("raw_edits", "characters"),
    "valid_interpreted_cer": ("edits", "characters"),
    "accepted_output_correctness": ("accepted_exact", "accepted_scorable"),
    "end_to_end_page_correctness": ("accepted_exact", "scorable"),
    "expected_outcome_accuracy": ("expected_met", "images"),
    "invalid_interpreted_syntax_pass_rate": ("invalid_syntax_passes", "invalid"),
}


def policy_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and null-safe rates of an outcome table per group."""
    counts = df.groupBy(*by).agg(*[e.alias(k) for k, e in policy_columns(df.columns).items()])
    return _with_policy_rates(counts)


def _with_policy_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[ratio(F.col(a), F.col(b)).alias(k) for k, (a, b) in POLICY_RATES.items()])


def policy_slices(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """policy_metrics overall and per value of each dimension, in one pass over the rows (grouping sets)."""
    # the rows' own columns stay apart from the dimensions, which grouping sets null out
    keys = [f"_d_{d}" for d in dimensions]
    named = df.select("*", *[F.col(d).cast("string").alias(k) for d, k in zip(dimensions, keys)])
    counts = named.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(
        *[e.alias(k) for k, e in policy_columns(df.columns).items()], *[F.grouping(k).alias(f"_g{k}") for k in keys]
    )
    name, value = F.lit("overall"), F.lit("all")
    for d, k in zip(dimensions, keys):
        name = F.when(F.col(f"_g{k}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g{k}") == 0, F.col(k)).otherwise(value)
    return _with_policy_rates(counts.withColumn("dimension", name).withColumn("value", value)).drop(*keys, *[f"_g{k}" for k in keys])


def rule_triggers(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(code, images) per group: records in which a reason code stands, however often."""
    codes = df.select(*by, F.explode(F.array_distinct("reason_codes")).alias("code"))
    return codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("images"))


def edit_verdict_counts(edits: DataFrame, key: str) -> DataFrame:
    """(key, correct_edits, incorrect_edits, unknown_edits) of character edits (key, raw, truth, index, replacement).

    Equal edits of equal texts are judged once.
    """
    parts = ["raw", "truth", "index", "replacement"]
    times = edits.groupBy(key, *parts).agg(F.count(F.lit(1)).alias("_n"))
    judged = times.select(*parts).distinct().withColumn("_a", assess_correction(F.col("raw"), F.col("truth"), F.col("index"), F.col("replacement"))["assessment"])
    known = F.col("_a").isin("correct", "incorrect")
    summed = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0)).cast("long")
    return join_null_safe(times, judged, parts).groupBy(key).agg(
        summed(F.col("_a") == "correct").alias("correct_edits"), summed(F.col("_a") == "incorrect").alias("incorrect_edits"), summed(~known).alias("unknown_edits")
    )


def macro_average(df: DataFrame, owner: str, rates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean over owners of each owner's rate; owners without a denominator are skipped."""
    per_owner = policy_metrics(df, [*by, owner])
    return per_owner.groupBy(*by).agg(F.count(F.lit(1)).alias("owners"), *[F.avg(r).alias(f"macro_{r}") for r in rates])


def worst_case(df: DataFrame, owner: str) -> DataFrame:
    """Worst level per owner: critical failure, unresolved review, all as expected."""
    c = F.col
    critical = (
        ((c("validity") == "INVALID") & (c("outcome") == "ACCEPT"))
        | ((c("validity") == "VALID") & (c("outcome") == "REJECT_INVALID"))
        | ((c("validity") == "VALID") & (c("outcome") == "ACCEPT") & c("edits").isNotNull() & ~c("exact"))
    )
    flags = df.groupBy(owner).agg(
        F.bool_or(F.coalesce(critical, F.lit(False))).alias("_c"), F.bool_or(c("outcome") == "REVIEW_UNCERTAIN").alias("_r")
    )
    level = F.when(c("_c"), "critical_failure").when(c("_r"), "unresolved_review").otherwise("all_expected_correct")
    return flags.select(owner, level.alias("worst_case_level"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """Images per reason code; a code counts once per image."""
    return df.select(F.explode(F.array_distinct(reasons)).alias("reason_code")).groupBy("reason_code").agg(F.count(F.lit(1)).alias("images"))


def flag_table(df: DataFrame, flags: dict[str, Column], owner: str) -> DataFrame:
    """Images and distinct owners per named, overlapping flag."""
    named = df.select(owner, F.explode(named_issues(flags.items())).alias("flag"))
    return named.groupBy("flag").agg(F.count(F.lit(1)).alias("images"), F.countDistinct(owner).alias("parents"))


def failure_flags() -> dict[str, Column]:
    """Overlapping failure groups of an outcome table."""
    c = F.col
    pair = lambda v, o: (c("validity") == v) & (c("outcome") == o)
    return {
        "invalid_accepted": pair("INVALID", "ACCEPT"),
        "invalid_review": pair("INVALID", "REVIEW_UNCERTAIN"),
        "valid_rejected": pair("VALID", "REJECT_INVALID"),
        "valid_review": pair("VALID", "REVIEW_UNCERTAIN"),
        "correctly_rejected_invalid": pair("INVALID", "REJECT_INVALID"),
        "valid_accepted_wrong_transcription": pair("VALID", "ACCEPT") & c("edits").isNotNull() & ~c("exact"),
        "segmentation_failures": c("segmentation_failure"),
        "preprocessing_failures": c("preprocessing_failure"),
        "decoding_failures": c("ocr_failure"),
        "pipeline_exceptions": c("pipeline_exception").isNotNull(),
        "wrong_tier_text": F.array_contains("reason_codes", "DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH"),
        "contextual_corrections": c("corrections") > 0,
        "unscorable_or_ambiguous": c("uncertain"),
    }


def tag_metrics(scored: DataFrame, tags: str, separator: str = ";") -> DataFrame:
    """Recognition metrics per tag of a multi-valued tag column."""
    exploded = scored.withColumn("tag", F.explode(F.split(tags, separator))).where("tag <> ''")
    return recognition_metrics(exploded, ["tag"])


def page_signals(df: DataFrame, page: str, signals: Sequence[str]) -> DataFrame:
    """Smallest value of each signal over the tiers of a page; missing values are skipped."""
    return df.groupBy(page).agg(*[F.min(s).alias(s) for s in signals])


def failure_categories(df: DataFrame, category: str, owner: str, case: str) -> DataFrame:
    """Pages, distinct owners and the first case per failure category."""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct(owner).alias("parents"), F.min(case).alias("representative")
    )


def category_summary(df: DataFrame, category: str, listed: Sequence[str]) -> DataFrame:
    """Rows per category and the distinct values of low-cardinality columns joined by ';'."""
    joined = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(c) for c in listed]
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("rows"), *joined)


def error_sizes(df: DataFrame, error: str, by: Sequence[str] = (), scale: str | None = None, covered: tuple[str, str] | None = None) -> DataFrame:
    """Signed mean, median and 95th percentile of the absolute error.

    With `scale` also median and 95th percentile in parts of it, with `covered`
    (part, whole) also coverage, the sum of the one over that of the other.
    """
    sums = [F.avg(error).alias("signed_mean")]
    if covered:
        sums.append(ratio(F.sum(covered[0]), F.sum(covered[1])).alias("coverage"))
    measures = [("absolute", F.abs(F.col(error)).cast("double"))]
    if scale:
        measures.append(("normalized", F.abs(F.try_divide(F.col(error).cast("double"), F.col(scale).cast("double")))))
    # both measures are ordered in one pass, as groups of one table
    sizes = df.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("_measure"), size.alias("_a")) for name, size in measures])).alias("_m")).select(*by, "_m.*")
    found = exact_quantiles(sizes, "_a", {"median": 0.5, "p95": 0.95}, [*by, "_measure"])
    of = lambda name: F.col("_measure") == name
    wide = [F.max(F.when(of("absolute"), F.col("rows"))).alias("rows")]
    wide += [F.max(F.when(of(name), F.col(q))).alias(f"{q}_{name}") for name, _ in measures for q in ("median", "p95")]
    sized = found.groupBy(*by).agg(*wide, F.count(F.lit(1)).alias("_measures"))
    if by:      # a group in which a measure has no value is left out
        sized = sized.where(F.col("_measures") == len(measures))
    sized, signed = sized.drop("_measures"), df.groupBy(*by).agg(*sums)
    if by:
        both = join_null_safe(sized, signed, list(by))
    else:
        one = sized.withColumn("_one", signed.select(F.struct(*signed.columns)).scalar())
        both = one.select(*sized.columns, *[F.col(f"_one.{c}").alias(c) for c in signed.columns])
    scaled = [f"{q}_normalized" for q in ("median", "p95")] if scale else []
    return both.select(*by, "rows", "median_absolute", "p95_absolute", *[c for c in signed.columns if c not in by], *scaled)


def hit_summary(df: DataFrame, metrics: Sequence[str], owner: str, targeted: Column) -> DataFrame:
    """Eligible, hits, coverage, conditional accuracy and full-denominator recall per metric.

    Needs `<metric>_eligible` and `<metric>_hit` columns.
    """
    rows = df.where(targeted)
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_eligible").alias("eligible"), F.col(f"{m}_hit").alias("hit")) for m in metrics])
    long = rows.select(owner, F.explode(items).alias("i")).select(owner, "i.*")
    sums = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("denominator"), F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("eligible") & F.col("hit")).alias("hits"),
        F.countDistinct(F.when(F.col("eligible"), F.col(owner))).alias("eligible_parents"),
    )
    return sums.select(
        "*", ratio(F.col("eligible"), F.col("denominator")).alias("coverage"),
        ratio(F.col("hits"), F.col("eligible")).alias("conditional_accuracy"),
        ratio(F.col("hits"), F.col("denominator")).alias("full_recall"),
    )
