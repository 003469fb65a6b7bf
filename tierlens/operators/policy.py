"""Accept / reject / review policies over observations.

Every operator takes observations without truth columns: labels are joined
only for scoring.  A tier table has one row per (page, row) with the columns
upper, count, lower; an absent tier is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions import codes, notation as N
from tierlens.functions.bind import let
from tierlens.functions.labels import fidelity_key, named_issues

VIOLATION = "struct<outcome:string,code:string,row:bigint,role:string,glyphs:string>"
WRONG_GLYPH = codes.WRONG_GLYPH


def _violation(outcome: str, code: str, row: Column, role: str | None = None, glyphs: Column | None = None) -> Column:
    return F.struct(
        F.lit(outcome).alias("outcome"), F.lit(code).alias("code"), row.cast("long").alias("row"),
        F.lit(role).cast("string").alias("role"), (F.lit(None).cast("string") if glyphs is None else glyphs).alias("glyphs"),
    )


def row_violation(row: Column, other_tiers: Column | None = None) -> Column:
    """First failed grammar check of one row, in tier order; null when it passes.

    `other_tiers` says whether the row has tiers beside the three roles.
    """
    review, reject = "REVIEW_UNCERTAIN", "REJECT_INVALID"
    checks = [F.when(F.col("count").isNull(), _violation(review, "MISSING_COUNT_TIER", row))]
    if other_tiers is not None:
        checks.append(F.when(other_tiers, _violation(review, "UNSUPPORTED_TIER_LAYOUT", row)))
    for role in N.ROLES:
        text = F.col(role)
        bad = N.strip_to(text, " " + N.AMBIGUOUS_SYMBOLS + N.tier_alphabet(role))
        checks += [
            F.when(text.isNotNull() & ~text.rlike(r"(?U)\S"), _violation(review, "EMPTY_DECODED_TIER", row, role)),
            F.when(F.contains(text, F.lit(N.AMBIGUOUS_SYMBOLS)), _violation(review, "AMBIGUOUS_NOTATION", row, role)),
            F.when(text.isNotNull() & (bad != ""), _violation(reject, WRONG_GLYPH, row, role, N.illegal_characters(bad, role))),
        ]
    checks.append(F.when(F.col("upper").isNull() & F.col("lower").isNull(), _violation(review, "COUNT_WITHOUT_SYMBOL_TIER", row)))
    return F.coalesce(*checks)


def validate_pages(pages: DataFrame, rows: DataFrame, page: str, row: str, other_tiers: Column | None = None, notes: Sequence[Column] = ()) -> DataFrame:
    """Observable-grammar outcome per page: the first failing row decides; `notes` are further aggregates of its rows."""
    marked = rows.withColumn("_v", row_violation(F.col(row), other_tiers))
    per_page = marked.groupBy(page).agg(
        F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(row))).alias("_v"), F.count(F.lit(1)).alias("decoded_rows"), *notes
    )
    found = pages.join(per_page, page, "left")
    empty = F.col("decoded_rows").isNull()
    return (
        found.withColumn("syntax_outcome", F.when(empty, "REVIEW_UNCERTAIN").otherwise(F.coalesce("_v.outcome", F.lit("ACCEPT"))))
        .withColumn("syntax_code", F.when(empty, "NO_DECODED_ROWS").otherwise(F.coalesce("_v.code", F.lit("OBSERVABLE_SYNTAX_OK"))))
        .withColumn("syntax_row", F.col("_v.row"))
        .withColumn("syntax_role", F.col("_v.role"))
        .withColumn("syntax_glyphs", F.col("_v.glyphs"))
        .withColumn("decoded_rows", F.coalesce("decoded_rows", F.lit(0)))
        .drop("_v")
    )


# -- aligned rows ------------------------------------------------------------

def aligned_runs(upper: Column, count: Column, lower: Column) -> Column:
    """Runs of an aligned row: a symbol's column opens a run, the next one ends it."""
    width = F.greatest(F.length(upper), F.length(lower))
    at = lambda text, i: F.trim(F.substr(text, i + 1, F.lit(1)))
    filled = F.filter(
        F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (at(upper, i) != "") | (at(lower, i) != ""),
    )

    def split(places: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(places, k + 1), F.length(count))
        return F.transform(
            places,
            lambda start, k: F.struct(
                start.alias("start"), at(upper, start).alias("up"), at(lower, start).alias("down"),
                F.ltrim(F.substr(count, start + 1, F.greatest(stop(k) - start, F.lit(0)))).alias("token"),
            ),
        )

    named = lambda r: F.struct(
        r["start"].alias("start"), r["up"].alias("up"), r["down"].alias("down"), F.when(r["up"] != "", r["up"]).otherwise(r["down"]).alias("symbol"),
        r["token"].alias("token"), N.decode_count(r["token"]).alias("count"),
    )
    return F.transform(let(filled, split), named)


def aligned_verdict(runs: Column, upper: Column, count: Column, lower: Column, expected_total: Column | None = None) -> Column:
    """Code of the first failed check of an aligned row, or ALIGNED_CANONICAL_OK."""

    def fault(r: Column, k: Column) -> Column:
        up, down, symbol = r["up"], r["down"], r["symbol"]
        own = lambda alphabet: F.contains(F.lit(alphabet), symbol)  # noqa: E731  (one character at this place)
        return (
            F.when((up != "") == (down != ""), "SYMBOL_POSITION_CONTRADICTION")
            .when(symbol == N.AMBIGUOUS_SYMBOLS, "AMBIGUOUS_NOTATION")
            .when(~F.when(up != "", own(N.UP_SYMBOLS)).otherwise(own(N.DOWN_SYMBOLS)), "WRONG_SYMBOL_DIRECTION")
            .when(r["count"].isNull(), "NONCANONICAL_COUNT_TOKEN")
            .when((k > 0) & (F.get(runs, k - 1)["symbol"] == symbol), "ADJACENT_IDENTICAL_RUNS")
        )

    first_fault = F.get(F.array_compact(F.transform(runs, fault)), F.lit(0))
    # asked only of rows without a fault: their tokens are canonical and their symbols stand on their own tier
    cell = lambda r, here: F.rpad(F.when(here, r["symbol"]).otherwise(" "), F.length(r["token"]), F.lit(" "))
    drawn = lambda of: F.array_join(F.transform(runs, of), "")
    same = (
        (drawn(lambda r: r["token"]) == count) & (F.rtrim(drawn(lambda r: cell(r, r["up"] != ""))) == upper)
        & (F.rtrim(drawn(lambda r: cell(r, r["up"] == ""))) == lower)
    )
    total = F.aggregate(runs, F.lit(0), lambda a, r: a + r["count"])
    code = (
        F.when(upper.isNull() | count.isNull() | lower.isNull(), "MALFORMED_ALIGNED_TEXT")
        .when((F.size(runs) == 0) | (F.get(runs, F.lit(0))["start"] != 0), "MISSING_ALIGNED_SYMBOL")
    )
    late = F.when(~same, "NONCANONICAL_ALIGNMENT")
    if expected_total is not None:
        late = late.when(total != expected_total, "ROW_SUM_MISMATCH")
    return F.coalesce(code, first_fault, late, F.lit("ALIGNED_CANONICAL_OK"))


def aligned_outcome(code: Column) -> Column:
    return (
        F.when(code == "ALIGNED_CANONICAL_OK", "ACCEPT")
        .when(code.isin("MALFORMED_ALIGNED_TEXT", "AMBIGUOUS_NOTATION"), "REVIEW_UNCERTAIN")
        .otherwise("REJECT_INVALID")
    )


def validate_aligned(rows: DataFrame, expected_total: Column | None = None) -> DataFrame:
    """Strict check of aligned canonical text; adds aligned_code, aligned_outcome, row_total."""
    u, c, l = F.col("upper"), F.col("count"), F.col("lower")
    with_runs = rows.withColumn("_runs", aligned_runs(u, c, l))
    coded = with_runs.withColumn("aligned_code", aligned_verdict(F.col("_runs"), u, c, l, expected_total))
    total = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["count"])
    return coded.withColumn("aligned_outcome", aligned_outcome(F.col("aligned_code"))).withColumn(
        "row_total", F.when(F.col("aligned_outcome") == "ACCEPT", total)
    ).withColumnRenamed("_runs", "aligned_runs")


# -- page decisions ----------------------------------------------------------

INDEPENDENT_INVALID = ("unreadable", "no_ink")     # fixed values: checked on the image itself


def baseline_decision(pages: DataFrame) -> DataFrame:
    """Availability-only decision: status columns in, outcome and reason out."""
    c = F.col
    pick = F.coalesce(
        F.when(c("preprocessing_status").isin(*INDEPENDENT_INVALID),
               F.struct(F.lit("REJECT_INVALID").alias("o"), F.concat(F.lit("INPUT_"), F.upper("preprocessing_status")).alias("r"))),
        F.when((c("preprocessing_status") != "ok") | ~c("segmentation_accepted"), F.struct(F.lit("REVIEW_UNCERTAIN").alias("o"), F.lit(codes.D1_NO_SAFE_PROPOSAL).alias("r"))),
        F.when(F.coalesce(c("ocr_status") != "ok", F.lit(True)), F.struct(F.lit("REVIEW_UNCERTAIN").alias("o"), F.lit("OCR_UNAVAILABLE").alias("r"))),
        F.struct(F.lit("ACCEPT").alias("o"), F.lit(codes.D1_PROPOSAL_E1_OUTPUT).alias("r")),
    )
    return pages.withColumn("_d", pick).withColumn("outcome", F.col("_d.o")).withColumn("reason_codes", F.array("_d.r")).drop("_d")


def confidence_reasons(thresholds: dict[str, float | None]) -> Column:
    """Missing or low confidence signals against fixed minimum values."""
    checks = []
    for name, limit in thresholds.items():
        if limit is None:
            continue
        value = F.col(name).cast("double")
        missing = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        checks.append((f"CONFIDENCE_MISSING_{name.upper()}", missing))
        checks.append((f"CONFIDENCE_LOW_{name.upper()}", ~missing & (value < F.lit(float(limit)))))
    return named_issues(checks)


def evidence_decision(pages: DataFrame, thresholds: dict[str, float | None] | None = None) -> DataFrame:
    """Rejects only on independent image evidence; text findings alone ask for review.

    Needs the status columns and the syntax columns of validate_pages.
    """
    c = F.col
    invalid = c("preprocessing_status").isin(*INDEPENDENT_INVALID)
    unsafe = ~invalid & ((c("preprocessing_status") != "ok") | ~c("segmentation_accepted"))
    ready = (c("preprocessing_status") == "ok") & c("segmentation_accepted")
    no_text = F.coalesce(c("ocr_status") != "ok", F.lit(True))
    checked = ~no_text | (c("decoded_rows") > 0)
    low = F.array().cast("array<string>") if thresholds is None else confidence_reasons(thresholds)
    findings = F.concat(
        F.array_compact(
            F.array(
                F.when(invalid, F.concat(F.lit("INPUT_"), F.upper("preprocessing_status"))),
                F.when(unsafe, codes.D1_NO_SAFE_PROPOSAL),
                F.when(no_text & ready, "OCR_UNAVAILABLE"),
                F.when(checked & (c("syntax_outcome") != "ACCEPT"), c("syntax_code")),
            )
        ),
        F.when(ready & ~no_text, low).otherwise(F.array().cast("array<string>")),
    )
    outcome = F.when(invalid, "REJECT_INVALID").when(F.size("_f") > 0, "REVIEW_UNCERTAIN").otherwise("ACCEPT")
    reasons = F.when(F.size("_f") > 0, F.array_distinct("_f")).otherwise(F.array(F.lit("OBSERVABLE_CHECKS_PASSED")))
    return pages.withColumn("_f", findings).withColumn("outcome", outcome).withColumn("reason_codes", reasons).drop("_f")


def count_gap(count: Column) -> Column:
    """A count tier with a blank inside: canonical counts have none."""
    return F.coalesce(F.contains(F.trim(count), F.lit(" ")), F.lit(False))


def gap_guard(decisions: DataFrame, rows: DataFrame, page: str) -> DataFrame:
    """Demotes ACCEPT to REVIEW where a decoded count tier has an internal gap."""
    gaps = rows.where(count_gap(F.col("count"))).groupBy(page).agg(F.count(F.lit(1)).alias("gap_rows"))
    joined = decisions.join(gaps, page, "left").withColumn("gap_rows", F.coalesce("gap_rows", F.lit(0)))
    found = F.col("gap_rows") > 0
    code = F.array_distinct(F.concat("reason_codes", F.array(F.lit(codes.R2_INTERNAL_DECODED_COUNT_GAP))))
    return (
        joined.withColumn("outcome_before", F.col("outcome"))
        .withColumn("outcome", F.when(found & (F.col("outcome") == "ACCEPT"), "REVIEW_UNCERTAIN").otherwise(F.col("outcome")))
        .withColumn("reason_codes", F.when(found, code).otherwise(F.col("reason_codes")))
    )


def apply_predicate(df: DataFrame, predicate: Callable[..., Column], name: str, **config) -> DataFrame:
    """Adds the result of a caller's rule: a function of configuration that returns a column."""
    return df.withColumn(name, predicate(**config))


# -- quality screening -------------------------------------------------------

def quality_screen(df: DataFrame, rules: Sequence[tuple[str, Column]], exclusion: Column) -> DataFrame:
    """Flags, and whether a record is excluded on objective grounds, flagged, or passes."""
    flags = named_issues(rules)
    return df.withColumn("flags", flags).withColumn(
        "quality_result",
        F.when(F.coalesce(exclusion, F.lit(False)), "OBJECTIVE_EXCLUDE").when(F.size("flags") > 0, "FLAGGED").otherwise("PASS_AUTOMATED_CHECKS"),
    )


def review_queue(df: DataFrame, urgent: Column, isolated: Column, tie: Sequence[str]) -> DataFrame:
    """Records to review: isolated scope last, urgent flags first, then flagged, then the rest."""
    priority = F.when(F.coalesce(urgent, F.lit(False)), 1).when(F.size("flags") > 0, 2).otherwise(3)
    queued = df.where("quality_result <> 'OBJECTIVE_EXCLUDE'").withColumn("priority", priority).withColumn("isolated", isolated)
    return queued.orderBy(F.col("isolated").cast("int"), "priority", *tie)


def offline_cohorts(df: DataFrame) -> DataFrame:
    """Scoring-only cohorts of decided records (truth enters here, after the decision)."""
    c = F.col
    same = lambda **kw: fidelity_key(c("prediction"), **kw) == fidelity_key(c("truth"), **kw)
    pattern, glyph = same(aliases=True), same(ink_only=True, aliases=True)
    accepted = (c("validity") == "INVALID") & (c("outcome") == "ACCEPT")
    text = F.trim(c("truth"))
    lost = F.contains(text, F.lit(" ")) & (c("prediction") != text) & (c("prediction") == F.replace(text, F.lit(" "), F.lit("")))
    return df.withColumns(
        {
            "pattern_faithful": pattern, "glyph_faithful": glyph, "invalid_accept": accepted,
            "faithful_invalid_accept": pattern & accepted, "lost_gap": lost,
            "wrong_tier_invalid_accept": accepted & F.array_contains("reason_codes", WRONG_GLYPH),
        }
    )
