"""Role-aware interpretation of decoded characters: evidence for roles, equivalents by rendering scope, edits and their verdicts.

A tier table has one row per (page, row) with the columns upper, count, lower;
an absent tier is null.  Truth enters only in `correction_verdicts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions import codes, notation as N
from tierlens.functions.bind import let
from tierlens.functions.distance import assess_correction
from tierlens.functions.labels import named_issues
from tierlens.operators.policy import evidence_decision, validate_pages
from tierlens.session import join_null_safe, materialize

#: What an equivalent was verified for: it holds for pages rendered this way and no others.
SCOPE = ("font_sha256", "font_size_px", "source_mode", "anchor")
EDIT = "array<struct<index:int,original_character:string,replacement_character:string>>"


def scoped_equivalents(mapping: DataFrame) -> DataFrame:
    """Per rendering scope and role, the verified legal targets of each source character, as one map a role.

    `mapping` has one row per pair: source, target, target_role, status,
    verified_sizes and the scope columns; it is as long as the look-alikes of a font.
    """
    legal = F.lit(False)
    for role in N.ROLES:
        legal = legal | ((F.col("target_role") == role) & F.contains(F.lit(" " + N.tier_alphabet(role)), F.col("target")))
    good = mapping.where((F.col("status") == codes.VERIFIED_IN_SCOPE) & (F.length("target") == 1) & legal)
    sized = good.withColumn("font_size_px", F.explode("verified_sizes"))
    per_source = sized.groupBy(*SCOPE, "target_role", "source").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    pair = F.struct("source", "targets")
    return per_source.groupBy(*SCOPE).agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("target_role") == role, pair))).alias(f"_targets_{role}") for role in N.ROLES]
    )


def page_reasons(margin: float) -> Column:
    """Reasons of a page why none of its tier roles may be trusted."""
    c = F.col
    alternatives, gap = c("legal_alternatives"), c("role_margin")
    supported = (alternatives == 1) | ((alternatives >= 2) & gap.isNotNull() & ~F.isnan(gap) & (F.abs(gap) < float("inf")) & (gap >= margin))
    ready = (c("preprocessing_status") == "ok") & c("segmentation_accepted") & F.coalesce(c("ocr_status") == "ok", F.lit(False))
    return named_issues([
        (codes.D1_OR_OCR_NOT_READY, ~F.coalesce(ready, F.lit(False))),
        (codes.D1_ROLE_CONFIDENCE_NOT_SUPPORTED, ~F.coalesce(supported, F.lit(False))),
        (codes.D1_REJECTION_PRESENT, F.coalesce(c("rejection"), F.lit("")) != ""),
    ])


def role_evidence(rows: DataFrame, pages: DataFrame, metadata: DataFrame, page: str, row: str, margin: float, roles: Sequence[str] = N.ROLES) -> DataFrame:
    """`rows` with the page's columns and, per tier, the reasons why its role isn't reliably known; null where the tier is absent.

    `metadata` has one row per record of a tier: page, row, role, kind
    (`segmentation`, `observed` or `path`), box, prediction.  A role needs one
    segmented and one observed tier with the decoded text, in the same box, and
    a place in the page's path.
    """
    kind, own = F.col("kind"), lambda r: F.col("role") == r
    # texts and boxes are compared by 64-bit hashes: numbers aggregate in place, strings would have to be sorted
    text, box = (F.when(F.col(x).isNotNull(), F.xxhash64(x)) for x in ("prediction", "box"))
    facts = []
    for r in roles:
        seen = lambda k: own(r) & (kind == k)  # noqa: B023,E731
        facts += [
            F.count_if(seen("segmentation")).alias(f"_cut_{r}"), F.count_if(seen("observed")).alias(f"_seen_{r}"),
            F.max(F.when(seen("observed"), text)).alias(f"_text_{r}"), F.max(F.when(seen("observed"), box)).alias(f"_box_{r}"),
            F.max(F.when(seen("segmentation"), box)).alias(f"_cutbox_{r}"), F.bool_or(seen("path")).alias(f"_path_{r}"),
        ]
    told = metadata.groupBy(page, row).agg(*facts)
    joined = rows.join(told, [page, row], "left").join(pages.withColumn("_page_reasons", page_reasons(margin)), page)
    for r in roles:
        one = (F.coalesce(F.col(f"_cut_{r}"), F.lit(0)) == 1) & (F.coalesce(F.col(f"_seen_{r}"), F.lit(0)) == 1) & F.equal_null(F.col(f"_text_{r}"), F.xxhash64(r))
        own_reasons = named_issues([
            (codes.D1_ROW_TIER_METADATA_CONFLICT, ~one),
            (codes.D1_CROP_METADATA_CONFLICT, one & ~F.equal_null(F.col(f"_box_{r}"), F.col(f"_cutbox_{r}"))),
            (codes.D1_PATH_ROLE_CONFLICT, ~F.coalesce(F.col(f"_path_{r}"), F.lit(False))),
        ])
        joined = joined.withColumn(f"evidence_{r}", F.when(F.col(r).isNotNull(), F.concat("_page_reasons", own_reasons)))
    return joined.drop("_page_reasons", *[f"_{x}_{r}" for r in roles for x in ("cut", "seen", "text", "box", "cutbox", "path")])


def interpreted_tier(text: Column, role: str, targets: Column, evidence: Column, conflicting: Column) -> Column:
    """struct<text, edits, uncertain, reasons> of one tier.

    Only characters that the role doesn't allow are touched, only by a single
    equivalent verified in the page's scope, and either all of them or none.
    """
    kept = lambda reasons: F.struct(text.alias("text"), F.array().cast(EDIT).alias("edits"), F.lit(True).alias("uncertain"), reasons.alias("reasons"))
    if role not in N.ROLES:
        return kept(F.array(F.lit(codes.T1_MISSING_OR_UNKNOWN_ROLE)))
    allowed = " " + N.tier_alphabet(role)
    legal = lambda c: F.contains(F.lit(allowed), c)
    options = lambda c: F.coalesce(F.try_element_at(targets, c), F.array().cast("array<string>"))
    every = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    wrong = F.filter(
        F.transform(every, lambda c, i: F.struct(i.alias("index"), c.alias("original_character"), options(c).alias("targets"))), lambda x: ~legal(x["original_character"])
    )

    def judged(found: Column) -> Column:
        open_questions = F.array_distinct(F.transform(
            F.filter(found, lambda x: F.size(x["targets"]) != 1),
            lambda x: F.when(F.size(x["targets"]) == 0, codes.T1_NO_VERIFIED_ROLE_EQUIVALENT).otherwise(codes.T1_MULTIPLE_ROLE_EQUIVALENTS),
        ))
        edits = F.transform(found, lambda x: F.struct(x["index"], x["original_character"], x["targets"][0].alias("replacement_character"))).cast(EDIT)
        fixed = F.array_join(F.transform(every, lambda c: F.when(legal(c), c).otherwise(options(c)[0])), "")
        done = F.struct(fixed.alias("text"), edits.alias("edits"), F.lit(False).alias("uncertain"), F.array(F.lit(codes.T1_VERIFIED_GLYPH_ROLE_DISAMBIGUATION)).alias("reasons"))
        return F.when(F.size(open_questions) > 0, kept(open_questions)).when(N.strip_to(fixed, allowed) != "", kept(F.array(F.lit(codes.T1_RESULT_NOT_ROLE_LEGAL)))).otherwise(done)

    unchanged = F.struct(text.alias("text"), F.array().cast(EDIT).alias("edits"), F.lit(False).alias("uncertain"), F.array(F.lit(codes.T1_NO_CHANGE_NEEDED)).alias("reasons"))
    return (
        F.when(F.coalesce(conflicting, F.lit("")) != "", kept(F.array(F.lit(codes.T1_CONFLICTING_EVIDENCE))))
        .when(F.size(evidence) > 0, kept(F.array(F.lit(codes.T1_ROLE_NOT_RELIABLY_ESTABLISHED))))
        .when(N.strip_to(text, allowed) == "", unchanged)
        .otherwise(let(wrong, judged))
    )


def interpret_rows(evidenced: DataFrame, mapping: DataFrame, page: str, row: str, roles: Sequence[str] = N.ROLES) -> DataFrame:
    """Tier table after interpretation: (page, row, tiers, edits, corrections, uncertain, reasons).

    `evidenced` comes from role_evidence; its pages carry the scope columns,
    provenance and conflicting_evidence.  Equivalents apply only to pages whose
    scope is canonical metadata.  edits has role, index, both characters and
    the tier's raw text; reasons has role and code.
    """
    scopes = scoped_equivalents(mapping)
    canonical = F.col("provenance") == codes.CANONICAL_RENDERING
    asked = evidenced.select("*", *[F.when(canonical, F.col(c)).alias(f"_scope_{c}") for c in SCOPE])
    joined = asked.join(scopes.select(*[F.col(c).alias(f"_scope_{c}") for c in SCOPE], *[f"_targets_{r}" for r in N.ROLES]), [f"_scope_{c}" for c in SCOPE], "left")
    none = F.create_map().cast("map<string,array<string>>")
    for role in roles:
        targets = F.coalesce(F.col(f"_targets_{role}"), none) if role in N.ROLES else none
        tier = interpreted_tier(F.col(role), role, targets, F.col(f"evidence_{role}"), F.col("conflicting_evidence"))
        joined = joined.withColumn(f"_{role}", F.when(F.col(role).isNotNull(), tier))

    def edits_of(r: str) -> Column:
        made = F.transform(f"_{r}.edits", lambda e: F.struct(
            F.lit(r).alias("role"), e["index"].alias("index"), e["original_character"].alias("original_character"), e["replacement_character"].alias("replacement_character"),
            F.col(r).alias("raw"),
        ))
        return F.coalesce(made, F.array().cast("array<struct<role:string,index:int,original_character:string,replacement_character:string,raw:string>>"))

    def reasons_of(r: str) -> Column:
        given = F.transform(f"_{r}.reasons", lambda code: F.struct(F.lit(r).alias("role"), code.alias("code")))
        return F.coalesce(given, F.array().cast("array<struct<role:string,code:string>>"))

    edits, reasons = (F.flatten(F.array(*[of(r) for r in roles])) for of in (edits_of, reasons_of))
    doubt = F.lit(False)
    for r in roles:
        doubt = doubt | F.coalesce(F.col(f"_{r}.uncertain"), F.lit(False))
    # the edits' raw text is the tier before interpretation, so they stand apart from the select that renames
    judged = joined.select(page, row, *[F.col(f"_{r}.text").alias(f"_new_{r}") for r in roles], edits.alias("edits"), doubt.alias("uncertain"), reasons.alias("reasons"))
    return judged.select(page, row, *[F.col(f"_new_{r}").alias(r) for r in roles], "edits", "uncertain", "reasons", F.size("edits").alias("corrections"))


def contextual_decision(
    pages: DataFrame, rows: DataFrame, metadata: DataFrame, mapping: DataFrame, page: str, row: str, margin: float, enabled: bool = True
) -> DataFrame:
    """Decision on raw text, on interpreted text, and the guarded final outcome.

    With `enabled=False` text is left alone and the raw decision stands.
    """
    raw = evidence_decision(validate_pages(pages, rows, page, row)).select(
        *pages.columns, F.col("outcome").alias("raw_outcome"), F.col("reason_codes").alias("raw_reasons"), F.col("syntax_outcome").alias("raw_syntax"),
    )
    if not enabled:
        return raw.select(
            "*", F.col("raw_outcome").alias("outcome"), F.col("raw_reasons").alias("reason_codes"),
            F.lit(0).cast("long").alias("corrections"), F.lit(False).alias("uncertain"), F.lit(False).alias("syntax_resolved"),
        )
    fixed = interpret_rows(role_evidence(rows, pages, metadata, page, row, margin), mapping, page, row)
    notes = [F.sum("corrections").cast("long").alias("corrections"), F.bool_or("uncertain").alias("uncertain")]
    new = evidence_decision(validate_pages(raw, fixed, page, row, notes=notes))  # the rows are interpreted once
    doubt = F.coalesce("uncertain", F.lit(False))
    held = doubt & (F.col("outcome") == "ACCEPT")
    return (
        new.withColumn("reason_codes", F.when(held, F.concat("reason_codes", F.array(F.lit(codes.T1_CONTEXT_UNCERTAIN)))).otherwise(F.col("reason_codes")))
        .withColumn("outcome", F.when(held, "REVIEW_UNCERTAIN").otherwise(F.col("outcome")))
        .withColumn("syntax_resolved", (F.col("raw_syntax") != "ACCEPT") & (F.col("syntax_outcome") == "ACCEPT"))
        .withColumn("corrections", F.coalesce("corrections", F.lit(0)))
        .withColumn("uncertain", doubt)
    )


def correction_verdicts(interpreted: DataFrame, truth: DataFrame, page: str, row: str, roles: Sequence[str] = N.ROLES) -> DataFrame:
    """One row per edit with its verdict over all minimum-edit alignments of the tier's raw text and truth.

    (page, row, role, index, original_character, replacement_character,
    assessment, possible, deletion_possible); an edit of a tier that the truth
    lacks can't be judged.  Equal (raw, truth, index) are aligned once.
    """
    # an explode of a bare column would filter on it first and so interpret every row twice; written, as pairs and verdicts both read them
    each = F.transform("edits", lambda e: F.struct(*[e[c].alias(c) for c in ("role", "index", "original_character", "replacement_character", "raw")]))
    edits = materialize(interpreted.select(page, row, F.explode(each).alias("e")).select(page, row, "e.*"), "edits")
    texts = truth.select(page, row, *[F.col(r).alias(f"_true_{r}") for r in roles])
    known = F.coalesce(*[F.when(F.col("role") == r, F.col(f"_true_{r}")) for r in roles])
    paired = edits.join(texts, [page, row], "left").withColumn("truth", known).drop(*[f"_true_{r}" for r in roles])
    key = ["raw", "truth", "index", "replacement_character"]
    judged = paired.select(*key).distinct().withColumn("a", assess_correction(F.col("raw"), F.col("truth"), F.col("index"), F.col("replacement_character")))
    return join_null_safe(paired, judged, key).select(page, row, "role", "index", "original_character", "replacement_character", "a.*")
