"""Text-only reconstruction of stripped rows and the review policies built on it.

Tiers lose their leading blanks when they are cropped.  A row is reconstructed
by trying the leading offsets the row width allows and keeping those under
which the row is canonical.  Readings of a page are counted per row total and
multiplied, never enumerated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions import codes
from tierlens.functions.aligned import aligned_verdicts
from tierlens.operators.policy import aligned_outcome
from tierlens.session import materialize


def _unsupported(u: Column, c: Column, l: Column) -> Column:
    """Reason why a row cannot be searched at all; null when it can."""
    other_space = r"[^\S ]"
    blank_only = lambda t: (t != "") & (F.trim(t) == "")
    leads = lambda t: F.startswith(t, F.lit(" "))
    return (
        F.when(c.isNull(), codes.COUNT_TIER_UNAVAILABLE)
        .when(c == "", codes.EMPTY_COUNT_OCR_NOT_IMAGE_ABSENCE)
        .when(u.rlike(other_space) | c.rlike(other_space) | l.rlike(other_space), codes.NON_ASCII_OR_CONTROL_WHITESPACE)
        .when(blank_only(u) | blank_only(l), codes.OPTIONAL_TIER_WHITESPACE_ONLY_IS_NOT_KNOWN_EMPTY)
        .when(F.trim(c) == "", codes.COUNT_WHITESPACE_ONLY)
        .when(leads(u) | leads(c) | leads(l), codes.OBSERVED_LEADING_BLANKS_REQUIRE_UNPROVEN_COMMON_CROP_NORMALIZATION)
    )


def candidates(rows: DataFrame, page: str, row: str, max_offset: int | None = None) -> DataFrame:
    """Every candidate offset pair of every row with its verdict; rows without any keep one empty line.

    The count tier starts at 0 and one symbol tier must, so at most one tier
    moves.  `max_offset` is a compute budget; rows cut short by it carry
    exhaustive = false.
    """
    u, l = F.coalesce("upper", F.lit("")), F.coalesce("lower", F.lit(""))
    base = rows.select(page, row, u.alias("upper"), F.col("count"), l.alias("lower"))
    base = base.withColumn("unsupported", _unsupported(F.col("upper"), F.col("count"), F.col("lower")))
    width, lu, ll = F.length("count"), F.length("upper"), F.length("lower")
    fits = F.col("unsupported").isNull() & (lu <= width) & (ll <= width)
    slack_u, slack_l = F.when(lu > 0, width - lu).otherwise(0), F.when(ll > 0, width - ll).otherwise(0)
    first_u, first_l = fits & (lu > 0), fits & (ll > 0)
    limit = (lambda s: s) if max_offset is None else (lambda s: F.least(s, F.lit(max_offset)))
    none = F.array().cast("array<struct<ou:int,ol:int>>")
    pair = lambda a, b: F.struct(a.cast("int").alias("ou"), b.cast("int").alias("ol"))
    moved_l = F.when(first_u, F.transform(F.sequence(F.lit(0), limit(slack_l)), lambda o: pair(F.lit(0), o))).otherwise(none)
    start = F.when(first_u, 1).otherwise(0)
    moved_u = F.when(
        first_l & (limit(slack_u) >= start), F.transform(F.sequence(start, limit(slack_u)), lambda o: pair(o, F.lit(0)))
    ).otherwise(none)
    natural = (
        F.when(first_u, slack_l + 1).otherwise(0) + F.when(first_l, slack_u + 1).otherwise(0) - F.when(first_u & first_l, 1).otherwise(0)
    )
    opened = base.withColumn("offsets", F.concat(moved_l, moved_u)).withColumn("natural_candidates", natural)
    opened = opened.withColumn("exhaustive", F.size("offsets") == F.col("natural_candidates"))
    each = opened.withColumn("o", F.explode_outer("offsets")).drop("offsets")
    tried = each.withColumn("v", aligned_verdicts(F.col("upper"), F.col("count"), F.col("lower"), F.col("o.ou"), F.col("o.ol")))
    tried = tried.withColumn("outcome", F.when(F.col("o").isNotNull(), aligned_outcome(F.col("v.code"))))
    return tried.select(
        page, row, "upper", "count", "lower", "unsupported", "natural_candidates", "exhaustive",
        F.when(F.col("upper") != "", F.col("o.ou")).alias("upper_offset"), F.when(F.col("lower") != "", F.col("o.ol")).alias("lower_offset"),
        F.col("o").isNotNull().alias("tested"), "v.code", "outcome", "v.row_total", "v.reading",
    )


def analyse_rows(found: DataFrame, page: str, row: str) -> DataFrame:
    """Per row: tested, passing and uncertain candidates, status, contradiction, uniqueness."""
    c = F.col
    sums = found.groupBy(page, row).agg(
        F.first("unsupported").alias("unsupported"), F.first("exhaustive").alias("exhaustive"),
        F.count_if("tested").alias("tested"), F.count_if(c("outcome") == "ACCEPT").alias("passing"),
        F.count_if(c("outcome") == "REVIEW_UNCERTAIN").alias("uncertain"),
        F.countDistinct("row_total").alias("totals"),
    )
    status = (
        F.when(c("unsupported").isNotNull(), "unsupported").when(c("passing") > 1, "multiple_in_search")
        .when(c("passing") == 1, "one_in_search").otherwise("none_in_search")
    )
    complete = c("unsupported").isNull() & c("exhaustive") & (c("uncertain") == 0)
    return sums.select(
        "*", status.alias("status"), complete.alias("complete"), (complete & (c("passing") == 0)).alias("contradiction"),
        (complete & (c("passing") == 1)).alias("unique_reading"),
    )


def page_totals(found: DataFrame, row_count: DataFrame, page: str, row: str, distinct_readings: bool = False) -> DataFrame:
    """Row totals every row of a page can reach, with the number of page readings for each.

    The number of readings is the product over rows of the readings per row:
    decimal(38), null beyond.  `single` says that every row has one reading.
    """
    passing = found.where(F.col("outcome") == "ACCEPT")
    ways = F.countDistinct("reading") if distinct_readings else F.count(F.lit(1))
    per_row = passing.groupBy(page, "row_total", row).agg(ways.alias("_w"))
    exact = "decimal(38,0)"
    per_total = per_row.groupBy(page, "row_total").agg(
        F.count(F.lit(1)).alias("_rows"), F.collect_list(F.col("_w").cast(exact)).alias("_ways"), (F.max("_w") == 1).alias("single")
    )
    return per_total.join(row_count, page).where(F.col("_rows") == F.col("rows")).select(page, "row_total", _product("_ways").alias("readings"), "single")


LARGEST = (1 << 63) - 1


def _product(ways: str) -> Column:
    """Product of a list of decimals, null beyond decimal(38)."""
    exact = "decimal(38,0)"
    return F.aggregate(ways, F.lit(1).cast(exact), lambda n, w: F.try_multiply(n, w).cast(exact))


def summed_readings(readings: str = "readings", single: str = "single", counted: Column | None = None) -> list[Column]:
    """Aggregates of page totals: their number, their readings as a long and whether that long is exact.

    Readings beyond a long (or beyond decimal(38)) stop at the largest long
    with `readings_exact` false, so "one" and "more than one" stay right.
    `counted` says which totals take part, all without it; without any the number is 0.
    """
    here = F.lit(True) if counted is None else counted
    number = F.count_if(here)
    total = F.when(F.count(F.when(here, F.col(readings))) == number, F.try_sum(F.when(here, F.col(readings))))
    fits = F.coalesce(total <= F.lit(LARGEST).cast("decimal(38,0)"), F.lit(False))
    return [
        number.alias("common_totals"), F.when(fits, total.cast("long")).otherwise(F.lit(LARGEST)).alias("readings"),
        fits.alias("readings_exact"), F.bool_and(F.when(here, F.col(single))).alias("single"),
    ]


def _page_rows(found: DataFrame, page: str, row: str) -> DataFrame:
    """What the rows of a page say together, whatever totals they reach."""
    return analyse_rows(found, page, row).groupBy(page).agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and("complete").alias("exhaustive"),
        F.bool_or("contradiction").alias("row_contradiction"), F.bool_or(F.col("uncertain") > 0).alias("uncertain"),
        F.bool_or(F.col("passing") > 1).alias("multiple_candidates"), F.bool_or(F.col("status") == "unsupported").alias("unsupported"),
    )


def _page_status(joined: DataFrame) -> DataFrame:
    """Status, contradiction and uniqueness of pages from their rows and, where there are any, their common totals."""
    joined = joined.withColumns({
        "common_totals": F.coalesce("common_totals", F.lit(0)), "readings": F.coalesce("readings", F.lit(0).cast("long")),
        "readings_exact": F.coalesce("readings_exact", F.lit(True)), "single": F.coalesce("single", F.lit(False)),
    })
    contradiction = F.col("row_contradiction") | (F.col("exhaustive") & (F.col("common_totals") == 0))
    status = (
        F.when(F.col("common_totals") > 0, "consistent_candidate_found").when(contradiction, "text_contradiction_complete_model")
        .otherwise("unknown_incomplete_or_unsupported")
    )
    return joined.select(
        "*", contradiction.alias("contradiction"), status.alias("status"),
        ((F.col("common_totals") == 1) & F.col("single") & F.col("exhaustive")).alias("unique_page"),
    ).drop("single")


def combine_pages(found: DataFrame, page: str, row: str, distinct_readings: bool = False) -> DataFrame:
    """Page status from its rows: common totals, number of readings, contradiction, uniqueness."""
    per_page = _page_rows(found, page, row)
    totals = page_totals(found, per_page.select(page, "rows"), page, row, distinct_readings).groupBy(page).agg(*summed_readings())
    return _page_status(per_page.join(totals, page, "left"))


def review_policy(decisions: DataFrame, analysis: DataFrame, page: str) -> DataFrame:
    """Keeps ACCEPT only where a complete consistent reading exists; never rejects."""
    columns = ["status", "exhaustive", "readings", "uncertain", "contradiction", "unsupported", "multiple_candidates"]
    facts = analysis.select(page, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = decisions.join(facts, page, "left")
    c = F.col
    ready = (c("preprocessing_status") == "ok") & c("segmentation_accepted") & F.coalesce(c("ocr_status") == "ok", F.lit(False))
    supported = ready & F.coalesce(
        (c("_status") == "consistent_candidate_found") & c("_exhaustive") & (c("_readings") >= 1) & ~c("_uncertain"), F.lit(False)
    )
    finding = (
        F.when(~ready, codes.R3_OCR_OR_SEGMENTATION_UNAVAILABLE).when(c("_contradiction"), codes.R3_COMPLETE_TEXT_CONTRADICTION)
        .when(c("_unsupported"), codes.R3_UNSUPPORTED_REPRESENTATION).when(c("_uncertain"), codes.R3_CANONICAL_INTERPRETATION_UNCERTAIN)
        .when(~c("_exhaustive"), codes.R3_SEARCH_CAP_REACHED).otherwise(codes.R3_INSUFFICIENT_ALIGNMENT_EVIDENCE)
    )
    demoted = (c("outcome") == "ACCEPT") & ~supported
    return (
        joined.withColumn("outcome_before", c("outcome")).withColumn("_demoted", demoted)
        .withColumn("reason_codes", F.when(c("_demoted"), F.array_distinct(F.concat("reason_codes", F.array(finding)))).otherwise(c("reason_codes")))
        .withColumn("outcome", F.when(c("_demoted"), "REVIEW_UNCERTAIN").otherwise(c("outcome")))
        .withColumn("new_review", c("_demoted"))
        .drop("_demoted", *[f"_{x}" for x in columns])
    )


def match_offsets(found: DataFrame, measured: DataFrame, page: str, row: str, tolerance: float = 0.5) -> DataFrame:
    """Marks candidates whose offsets agree with measured positions, and boundary doubts.

    `measured` has (page, row, tier, offset, low, high); every offset of a
    candidate must lie within the tolerance of its measurement.
    """
    pick = lambda tier, c: F.max(F.when(F.col("tier") == tier, F.col(c)))
    wide = measured.groupBy(page, row).agg(
        *[pick(t, c).alias(f"_{t}_{c}") for t in ("upper", "lower", "count") for c in ("offset", "low", "high")]
    )
    passing = found.where(F.col("outcome") == "ACCEPT").join(wide, [page, row], "left")
    keep, boundary, outside_any, known = F.lit(True), F.lit(False), F.lit(False), F.lit(True)
    for tier, offset in (("upper", F.col("upper_offset")), ("lower", F.col("lower_offset")), ("count", F.lit(0))):
        x, lo, hi = (F.col(f"_{tier}_{c}") for c in ("offset", "low", "high"))
        used = offset.isNotNull()
        inside = (offset - tolerance <= lo) & (hi <= offset + tolerance)
        outside = (hi < offset - tolerance) | (lo > offset + tolerance)
        keep = keep & (~used | (F.abs(offset - x) <= tolerance))
        boundary = boundary | (used & ~inside & ~outside)
        outside_any = outside_any | (used & outside)
        known = known & (~used | (x.isNotNull() & lo.isNotNull() & hi.isNotNull()))
    return passing.select(
        *found.columns, F.coalesce(keep, F.lit(False)).alias("retained"),
        F.coalesce(boundary & ~outside_any, F.lit(False)).alias("boundary_uncertain"),
        F.coalesce(known, F.lit(False)).alias("measured"),
    )


def distinct_readings(found: DataFrame, row_count: DataFrame, page: str, row: str) -> DataFrame:
    """Distinct page readings and the single selected total where there is exactly one."""
    totals = page_totals(found, row_count, page, row, distinct_readings=True)
    one = (F.col("common_totals") == 1) & F.col("single")
    return totals.groupBy(page).agg(*summed_readings(), F.max("row_total").alias("_t")).select(
        page, "readings", "readings_exact", "common_totals", F.when(one, F.col("_t")).alias("selected_total")
    )


def measured_pages(found: DataFrame, measured: DataFrame, page: str, row: str) -> DataFrame:
    """Per page the columns of combine_pages and what the measured positions say of its candidates.

    `before` and `after` are distinct readings without and with the
    candidates that the measurements rule out: their number and the total
    where there is only one; `doubt` and `measured` tell how well the positions are
    known.  Every candidate is matched and every row and total grouped once.
    """
    c, exact = F.col, "decimal(38,0)"
    per_page = materialize(_page_rows(found, page, row), "page-rows")
    each = match_offsets(found, measured, page, row).groupBy(page, row, "row_total", "reading").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("retained").alias("_kept"), F.bool_or("boundary_uncertain").alias("_doubt"), F.bool_and("measured").alias("_measured")
    )
    ways = each.groupBy(page, row, "row_total").agg(
        F.sum("_n").alias("all"), F.count("reading").alias("before"), F.count_if("_kept").alias("after"), F.bool_or("_doubt").alias("_doubt"), F.bool_and("_measured").alias("_measured")
    )
    kinds = ("all", "before", "after")
    listed = [F.collect_list(F.when(c(k) > 0, c(k).cast(exact))).alias(f"_{k}") for k in kinds]
    totals = ways.groupBy(page, "row_total").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(c("after") > 0).alias("_kept_rows"), *listed, *[F.max(k).alias(f"_most_{k}") for k in kinds],
        F.bool_or("_doubt").alias("_doubt"), F.bool_and("_measured").alias("_measured"),
    )
    common = {k: (c("_kept_rows" if k == "after" else "_rows") == c("rows")) for k in kinds}
    joined = totals.join(per_page.select(page, "rows"), page).select(
        page, "row_total", "_doubt", "_measured", *[common[k].alias(f"_common_{k}") for k in kinds],
        *[F.when(common[k], _product(f"_{k}")).alias(f"_readings_{k}") for k in kinds], *[(c(f"_most_{k}") == 1).alias(f"_single_{k}") for k in kinds],
    )
    sums = {k: summed_readings(f"_readings_{k}", f"_single_{k}", c(f"_common_{k}")) for k in kinds}
    grouped = joined.groupBy(page).agg(
        F.struct(*sums["all"]).alias("_all"), *[F.struct(*sums[k], F.max(F.when(c(f"_common_{k}"), c("row_total"))).alias("total")).alias(f"_{k}") for k in kinds[1:]],
        F.bool_or(F.when(c("_common_before"), c("_doubt"))).alias("doubt"), F.bool_and("_measured").alias("measured"),
    )
    one = lambda k: F.when((c(f"_{k}.common_totals") == 1) & c(f"_{k}.single"), c(f"_{k}.total"))
    facts = grouped.select(
        page, "_all.*", *[F.when(c(f"_{k}.common_totals") > 0, c(f"_{k}.readings")).alias(f"{k}_readings") for k in kinds[1:]], *[one(k).alias(f"{k}_total") for k in kinds[1:]], "doubt", "measured"
    )
    facts = facts.withColumns({k: F.when(c("common_totals") > 0, c(k)) for k in ("readings", "readings_exact", "single")})
    return _page_status(per_page.join(facts, page, "left"))


def measured_policy(decisions: DataFrame, analysis: DataFrame, page: str) -> DataFrame:
    """Resolves remaining ambiguity by measured offsets, from measured_pages; may only turn ACCEPT into REVIEW."""
    facts = analysis.select(
        page, F.coalesce("before_readings", F.lit(0).cast("long")).alias("readings_before"), (F.col("exhaustive") & ~F.col("uncertain")).alias("_complete"),
        F.col("after_readings").alias("readings_after"), F.col("after_total").alias("_after_total"), F.col("before_total").alias("_before_total"),
        F.col("doubt").alias("_doubt"), F.col("measured").alias("_measured"),
    )
    joined = decisions.join(facts, page, "left")
    c = F.col
    n_before, n_after = F.coalesce("readings_before", F.lit(0)), F.coalesce("readings_after", F.lit(0))
    positioned = F.coalesce("_measured", F.lit(False)) & ~F.coalesce("_doubt", F.lit(False))
    finding = (
        F.when(~F.coalesce("_complete", F.lit(False)) | (n_before == 0), codes.R3_1_ALIGNMENT_UNAVAILABLE)
        .when(positioned & (n_after == 0), codes.R3_1_MEASURED_POSITION_MISMATCH)
        .when(positioned & (n_after > 1), codes.R3_1_AMBIGUOUS_AFTER_MEASUREMENT)
        .when(~positioned & (n_before != 1), codes.R3_1_POSITION_UNAVAILABLE)
    )
    asked = c("outcome") == "ACCEPT"
    return (
        joined.withColumn("finding", F.when(asked, finding))
        .withColumn("selected_total", F.when(asked & c("finding").isNull(), F.when(positioned, c("_after_total")).otherwise(c("_before_total"))))
        .withColumn("position_verified", asked & c("finding").isNull() & positioned)
        .withColumn("outcome_before", c("outcome"))
        .withColumn("outcome", F.when(c("finding").isNotNull(), "REVIEW_UNCERTAIN").otherwise(c("outcome")))
        .drop("_complete", "_after_total", "_before_total", "_doubt", "_measured")
    )
