"""Consistency, leakage and duplicate audits over manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.functions import labels as L
from tierlens.functions.notation import ROLES
from tierlens.session import join_null_safe


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself; missing columns are an error when the plan is built."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def value_checks(df: DataFrame, boolean: str, label: str, length: str) -> DataFrame:
    """Adds scan-time issues: bad boolean text, empty label, wrong length."""
    flag = F.col(boolean).cast("string")
    return df.withColumn(
        "issues",
        L.named_issues(
            [
                ("bad_boolean", flag.isNull() | ~flag.isin("0", "1", "true", "false")),
                ("empty_label", F.coalesce(F.length(label), F.lit(0)) == 0),
                ("length_mismatch", F.coalesce(F.length(label), F.lit(-1)) != F.coalesce(F.col(length).cast("int"), F.lit(-2))),
            ]
        ),
    )


def layout_mismatches(tiers: DataFrame, layout: DataFrame, row: str, checks: Sequence[str]) -> DataFrame:
    """Rows without a layout entry, or whose checked columns differ from it."""
    other = layout.select(F.col(row), F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in checks])
    joined = tiers.join(other, row, "left")
    differs = F.lit(False)
    for c in checks:
        differs = differs | ~F.equal_null(F.col(c), F.col(f"_{c}"))
    problem = F.when(F.col("_found").isNull(), "missing_layout").when(differs, "layout_differs")
    return joined.withColumn("problem", problem).where("problem is not null").drop("_found", *[f"_{c}" for c in checks])


def tier_presence(layout: DataFrame, tiers: DataFrame, row: str, tier: str, roles: Sequence[str] = ROLES) -> DataFrame:
    """Tiers the layout promises but the manifest lacks, and the reverse."""
    flags = layout.unpivot([row], [f"{r}_present" for r in roles], tier, "expected").withColumn(
        tier, F.regexp_replace(tier, "_present$", "")
    )
    counts = tiers.groupBy(row, tier).agg(F.count(F.lit(1)).alias("found"))
    state = F.when(F.col("expected") & F.col("found").isNull(), "expected_absent").when(
        ~F.col("expected") & F.col("found").isNotNull(), "unexpected_present"
    )
    return flags.join(counts, [row, tier], "left").withColumn("state", state).where("state is not null").select(row, tier, "state")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; the fact side is reduced to distinct keys first."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).where("side is not null")


def reconcile_pages(produced: DataFrame, completed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The six set differences between produced, completed and failed pages, in one pass."""
    tagged = produced.select(key, F.lit(1).alias("p"), F.lit(0).alias("c"), F.lit(0).alias("f")).unionByName(
        completed.select(key, F.lit(0).alias("p"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    ).unionByName(failed.select(key, F.lit(0).alias("p"), F.lit(0).alias("c"), F.lit(1).alias("f")))
    state = tagged.groupBy(key).agg(*[(F.max(c) == 1).alias(c) for c in "pcf"])
    p, c, f = F.col("p"), F.col("c"), F.col("f")
    names = L.named_issues(
        [
            ("completed_without_tiers", c & ~p),
            ("parents_not_completed", p & ~c),
            ("failed_pages_with_tiers", f & p),
            ("failed_pages_without_tiers", f & ~p),
            ("failed_pages_not_completed", f & ~c),
            ("completed_without_tiers_and_no_failure", c & ~p & ~f),
        ]
    )
    return state.select(key, F.explode(names).alias("difference"))


def split_owners(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys owned by more than one split, with the splits (never more than there are splits)."""
    owners = df.select(key, split).distinct().groupBy(key).agg(F.sort_array(F.collect_list(split)).alias("splits"))
    return owners.where(F.size("splits") > 1)


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Shared keys for every ordered pair of splits."""
    pairs = F.filter(
        F.flatten(F.transform("splits", lambda a: F.transform("splits", lambda b: F.struct(a.alias("split_a"), b.alias("split_b"))))),
        lambda p: p["split_a"] < p["split_b"],
    )
    return split_owners(df, key, split).select(key, F.explode(pairs).alias("p")).select(key, "p.split_a", "p.split_b")


def novel_keys(candidates: DataFrame, history: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First candidate per key that no history table knows; rejected keys are not refilled."""
    packed = F.struct(*[F.col(c) for c in candidates.columns])
    firsts = candidates.groupBy(key).agg(F.min_by(packed, F.struct(*order)).alias("_r")).select("_r.*")
    return firsts.join(history.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def with_group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Size of the identical-content group of every record (counts joined back, no list of members)."""
    return join_null_safe(df, df.groupBy(key).agg(F.count(F.lit(1)).alias(out)), [key])


def matched_controls(records: DataFrame, record_id: str, control_id: str, same: Sequence[str], control_hash: str, own_hash: str, is_control: Column) -> DataFrame:
    """Violations of the rule that a variant names a valid control of its own family."""
    control = records.where(is_control).select(
        F.col(record_id).alias("_id"), *[F.col(c).alias(f"_{c}") for c in same], F.col(own_hash).alias("_hash")
    )
    joined = records.join(control, F.col(control_id) == F.col("_id"), "left")
    lost = F.col("_id").isNull()
    checks = [("control_missing", lost)]
    checks += [(f"{c}_differs", ~lost & ~F.equal_null(F.col(c), F.col(f"_{c}"))) for c in same]
    checks += [("control_hash_differs", ~lost & ~F.equal_null(F.col(control_hash), F.col("_hash")))]
    return joined.select(record_id, F.explode(L.named_issues(checks)).alias("violation"))


def match_sources(parents: DataFrame, reference: DataFrame, parent: str, keys: Sequence[str], split: str) -> DataFrame:
    """Splits in which a parent turns up by any of several keys, and by which key."""
    found = None
    for k in keys:
        known = reference.where(F.col(k).isNotNull()).select(k, split).distinct()
        part = parents.select(parent, k).join(known, k).select(parent, F.col(split).alias("split"), F.lit(k).alias("matched_by"))
        found = part if found is None else found.unionByName(part)
    found = found.distinct()
    grouped = found.groupBy(parent).agg(
        F.sort_array(F.collect_set("split")).alias("splits"), F.sort_array(F.collect_set("matched_by")).alias("matched_by")
    )
    return parents.select(parent).distinct().join(grouped, parent, "left").select(
        parent, F.coalesce("splits", F.array().cast("array<string>")).alias("splits"),
        F.coalesce("matched_by", F.array().cast("array<string>")).alias("matched_by"),
    )


def sample_issues(df: DataFrame, split: str, vocabulary: str, inventory: DataFrame | None = None) -> DataFrame:
    """The 14 named issues of a manifest row, exploded as (tier_id, issue)."""
    if inventory is not None:
        known = inventory.select(F.col("path"), F.lit(True).alias("_ok"))
        for k in ("image_path", "label_path"):
            df = df.join(known.select(F.col("path").alias(k), F.col("_ok").alias(f"_has_{k}")), k, "left")
    else:
        df = df.withColumn("_has_image_path", F.lit(True)).withColumn("_has_label_path", F.lit(True))
    c = F.col
    target, raw = c("training_label"), c("raw_label")
    width = L.resized_width(c("image_width"), c("image_height"))
    steps, need = L.ctc_steps(width), L.ctc_required(target)
    image_ok = L.valid_path(c("image_path"), split, "images")
    label_ok = L.valid_path(c("label_path"), split, "labels")
    checks = [
        ("wrong_split", c("split") != split),
        ("invalid_image_path", ~image_ok),
        ("invalid_label_path", ~label_ok),
        ("missing_images", image_ok & c("_has_image_path").isNull()),
        ("missing_labels", label_ok & c("_has_label_path").isNull()),
        ("empty_training_labels", target == ""),
        ("unknown_characters", (L.unknown_characters(target, vocabulary) != "") | (c("unknown_characters") != "")),
        ("label_semantics_mismatch", L.clean_label(raw) != target),
        ("label_length_mismatch", c("label_length") != F.length(target)),
        ("leading_offset_mismatch", c("leading_offset") != F.length(raw) - F.length(target)),
        ("resized_width_mismatch", c("resized_width") != width),
        ("ctc_infeasible", (need > steps) | ~c("ctc_feasible")),
        ("ctc_metadata_mismatch", (c("ctc_required_timesteps") != need) | (c("crnn_output_length") != steps)),
        ("source_status_not_ok", (c("image_status") != "ok") | (c("label_status") != "ok")),
    ]
    return df.select("tier_id", F.explode(L.named_issues(checks)).alias("issue"))


def split_summary(tiers: DataFrame, split: str = "split") -> DataFrame:
    """Counts, distinct owners, per-tier counts, issue counters and margin range per split."""
    margin = F.col("crnn_output_length") - F.col("ctc_required_timesteps")
    n = lambda cond: F.count_if(cond)
    return tiers.groupBy(split).agg(
        F.count(F.lit(1)).alias("tiers"),
        F.countDistinct("tier_id").alias("distinct_ids"),
        F.countDistinct("row_id").alias("distinct_rows"),
        F.countDistinct("parent_image_id").alias("distinct_parents"),
        *[n(F.col("tier_name") == r).alias(f"{r}_tiers") for r in ROLES],
        n(F.col("training_label") == "").alias("empty_labels"),
        n(F.col("unknown_characters") != "").alias("unknown_vocabulary"),
        n(~F.col("ctc_feasible")).alias("ctc_infeasible"),
        n(F.col("leading_offset") > 0).alias("with_leading_spaces"),
        F.min(margin).alias("min_margin"), F.max(margin).alias("max_margin"),
        F.max("label_length").alias("max_label_length"),
    )


#: Kinds of critical issue, per split.
CRITICAL = (
    "completed_page_mismatch", "missing_images", "missing_labels", "unreadable_labels", "metadata_label_mismatch", "empty_ocr_targets",
    "duplicate_tier_ids", "invalid_dimensions", "ctc_infeasible", "unknown_tier_names",
)
#: Examples that an issue report keeps per issue.
EXAMPLES = 10


def issue_examples(rows: DataFrame, by: Sequence[str], example: str, k: int = EXAMPLES) -> DataFrame:
    """(by, rows, examples): how many rows a group has, and its `k` smallest examples.

    Examples are cut to `k` in 64 parts of a group before the parts meet, so
    that an issue that every row has is no single task's work.
    """
    counted = rows.groupBy(*by, F.pmod(F.xxhash64(example), F.lit(64)).alias("_part"), example).agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(*by, "_part").orderBy(example)
    placed = counted.withColumn("_place", F.row_number().over(first))
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("_place") <= k, F.col(example)))).alias("_e"))
    return parts.groupBy(*by).agg(F.sum("_n").alias("rows"), F.slice(F.sort_array(F.flatten(F.collect_list("_e"))), 1, k).alias("examples"))


def tier_issues(tiers: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, issue, tier_id): critical issues of single manifest rows against the files that are there.

    `images` has image_path, found_width and found_height of every image,
    `labels` label_path and found_label of every label file, null where it can't be read.
    """
    c = F.col
    seen = tiers.join(images.withColumn("_image", F.lit(True)), "image_path", "left").join(labels.withColumn("_label", F.lit(True)), "label_path", "left")
    image, label = c("_image").isNotNull(), c("_label").isNotNull()
    checks = [
        ("missing_images", ~image), ("missing_labels", ~label), ("unreadable_labels", label & c("found_label").isNull()),
        ("metadata_label_mismatch", label & c("found_label").isNotNull() & (c("found_label") != c("training_label"))),
        ("empty_ocr_targets", F.coalesce(c("training_label"), F.lit("")) == ""),
        ("invalid_dimensions", image & ~F.coalesce((c("found_width") == c("image_width")) & (c("found_height") == c("image_height")) & (c("image_width") > 0) & (c("image_height") > 0), F.lit(False))),
        ("ctc_infeasible", ~F.coalesce(c("ctc_feasible"), F.lit(False))), ("unknown_tier_names", ~F.coalesce(c("tier_name").isin(*ROLES), F.lit(False))),
    ]
    return seen.select("split", F.explode(L.named_issues(checks)).alias("issue"), F.col("tier_id").alias("example"))


def readiness_gate(
    tiers: DataFrame, images: DataFrame, labels: DataFrame, expected: DataFrame, splits: Sequence[str] = ("train", "validation", "test"), split: str = "split"
) -> DataFrame:
    """(scope, issue, rows, examples, ready): all critical issues of every split and of every pair of splits, none of them left out.

    `expected` has the pages (split, parent_image_id) that should be complete.
    """
    found = tier_issues(tiers, images, labels)
    twice = duplicate_keys(tiers.select(split, "tier_id"), "tier_id").select("tier_id")
    found = found.unionByName(tiers.join(twice, "tier_id", "left_semi").select(split, F.lit("duplicate_tier_ids").alias("issue"), F.col("tier_id").alias("example")))
    page = [split, "parent_image_id"]
    done, asked = tiers.select(*page).distinct(), expected.select(*page).distinct()
    gaps = asked.join(done, page, "left_anti").unionByName(done.join(asked, page, "left_anti"))
    found = found.unionByName(gaps.select(split, F.lit("completed_page_mismatch").alias("issue"), F.col("parent_image_id").alias("example"))).withColumnRenamed(split, "scope")
    both = done.groupBy("parent_image_id").agg(F.collect_set(split).alias("_s"))
    pairs = [(a, b) for k, a in enumerate(splits) for b in splits[k + 1 :]]
    shared = F.array_compact(F.array(*[F.when(F.array_contains("_s", a) & F.array_contains("_s", b), f"{a} <-> {b}") for a, b in pairs]))
    found = found.unionByName(both.select(F.explode(shared).alias("scope"), F.lit("parent_leakage").alias("issue"), F.col("parent_image_id").alias("example")))
    wanted = [(s, i) for s in splits for i in CRITICAL] + [(f"{a} <-> {b}", "parent_leakage") for a, b in pairs]
    grid = tiers.sparkSession.createDataFrame(wanted, "scope string, issue string")
    return grid.join(issue_examples(found, ["scope", "issue"], "example"), ["scope", "issue"], "left").select(
        "scope", "issue", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), F.coalesce("rows", F.lit(0)).alias("_n")
    ).withColumn("ready", F.col("_n") == 0).drop("_n")


def family_quartets(records: DataFrame, parent: str, validity: str, variant: str, category: str) -> DataFrame:
    """Parents that lack exactly one record of each validity and variant, or mix categories."""
    cell = {f"{v.lower()}_{k}": (F.col(validity) == v) & (F.col(variant) == k) for v in ("VALID", "INVALID") for k in ("clean", "illuminated")}
    counts = records.groupBy(parent).agg(
        *[F.count_if(cond).alias(name) for name, cond in cell.items()],
        F.countDistinct(F.when(F.col(validity) == "INVALID", F.col(category))).alias("categories"),
    )
    complete = F.col("categories") == 1
    for name in cell:
        complete = complete & (F.col(name) == 1)
    return counts.withColumn("complete", complete)


def mutation_issues(records: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Contract faults of mutated and valid records, exploded as (image_id, issue).

    `rules` maps every allowed invalidity category to its rule.  Invalid records
    need a known category with its rule and carry no target; valid ones have a
    target and the category none.
    """
    c = F.col
    invalid, valid = c("validity") == "INVALID", c("validity") == "VALID"
    known = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    rule = F.try_element_at(known, c("category"))
    checks = [
        ("unsupported_validity", ~(invalid | valid)),
        ("expected_outcome_disagrees", c("expected_outcome") != F.when(valid, "ACCEPT").otherwise("REJECT_INVALID")),
        ("unsupported_category", invalid & rule.isNull()),
        ("rule_disagrees", invalid & rule.isNotNull() & ~F.equal_null(rule, c("rule"))),
        ("fabricated_target", invalid & c("target").isNotNull()),
        ("valid_without_target", valid & c("target").isNull()),
        ("valid_with_category", valid & (c("category") != "none")),
        ("unsafe_identifier", ~c("image_id").cast("string").rlike("^[a-z0-9_]+$")),
    ]
    return records.select("image_id", F.explode(L.named_issues(checks)).alias("issue"))


def contract_issues(records: DataFrame, rules: dict[str, str], history: DataFrame) -> DataFrame:
    """(image_id, issue): faults of single records (mutation_issues) and of their verification, lineage, control and history.

    Beside those columns: image_sha256, original_image_hash, parent_id,
    mutation_family_id, matched_control_id, augmented, verification_status,
    evidence_status, semantic_key and parent_semantic_key, novelty_verified.
    `history` has the semantic_key of every source used before.  A record's
    control is a valid, unaugmented record of the same parent, and its image
    is the original that the record's hash names.
    """
    c = F.col
    verified = F.lit("AUTO_VERIFIED")       # fixed value
    own = [
        ("not_verified", ~F.equal_null(c("verification_status"), verified) | ~F.equal_null(c("evidence_status"), verified)),
        ("family_is_not_parent", ~F.equal_null(c("mutation_family_id"), c("parent_id"))),
        ("semantic_key_mismatch", ~F.equal_null(c("semantic_key"), c("parent_semantic_key"))),
        ("novelty_not_established", ~F.coalesce(c("novelty_verified"), F.lit(False))),
    ]
    controls = records.select(
        c("image_id").alias("matched_control_id"), c("parent_id").alias("_parent"), c("validity").alias("_validity"), c("augmented").alias("_augmented"), c("image_sha256").alias("_hash"), F.lit(True).alias("_there")
    )
    copies = records.groupBy("image_sha256").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    used = history.select("semantic_key").where("semantic_key is not null").distinct().withColumn("_used", F.lit(True))
    joined = records.join(controls, "matched_control_id", "left").join(copies, "image_sha256", "left").join(used, "semantic_key", "left")
    good = c("_there") & (c("_validity") == "VALID") & ~c("_augmented") & F.equal_null(c("_parent"), c("parent_id"))
    linked = [
        ("control_missing_or_wrong", ~F.coalesce(good, F.lit(False))),
        ("original_hash_mismatch", F.coalesce(c("_there"), F.lit(False)) & ~F.equal_null(c("_hash"), c("original_image_hash"))),
        ("duplicate_image_bytes", c("_copies").isNotNull()),
        ("historical_overlap", c("_used").isNotNull()),
    ]
    found = joined.select("image_id", F.explode(L.named_issues([*own, *linked])).alias("issue"))
    return mutation_issues(records, rules).unionByName(found)
