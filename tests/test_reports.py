"""Readiness, paired scores, target batches, feasibility and error sizes against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.operators import audit as A, compare as P, metrics as M, profile as R, sequence as Q


def test_readiness_names_every_kind_per_split(spark):
    tiers = [
        # split, tier_id, parent, tier, label, width, height, feasible
        ("train", "t1", "a", "upper", "A", 10, 5, True), ("train", "t2", "a", "upper", "A", 10, 5, True), ("train", "t2", "a", "count", "B", 10, 5, True),
        ("train", "t3", "b", "margin", "A", 10, 5, True), ("validation", "v1", "a", "lower", "", 10, 5, False), ("validation", "v2", "c", "lower", "R", 0, 5, True),
        ("validation", "v3", "c", "lower", "R", 10, 5, True), ("validation", "v4", "c", "lower", "R", 10, 5, True),
    ]
    table = spark.createDataFrame(tiers, "split string, tier_id string, parent_image_id string, tier_name string, training_label string, image_width int, image_height int, ctc_feasible boolean")
    table = table.selectExpr("*", "concat(tier_id, '.png') as image_path", "concat(tier_id, '.txt') as label_path")
    images = spark.createDataFrame([(f"{t}.png", 10, 5) for t in ("t1", "t2", "t3", "v2", "v3")] + [("v1.png", 10, 9)], "image_path string, found_width int, found_height int")
    labels = spark.createDataFrame([("t1.txt", "A"), ("t2.txt", "A"), ("v1.txt", ""), ("v2.txt", None), ("v3.txt", "other"), ("v4.txt", "R")], "label_path string, found_label string")
    expected = spark.createDataFrame([("train", "a"), ("train", "b"), ("train", "z"), ("validation", "a")], "split string, parent_image_id string")
    got = {(r["scope"], r["issue"]): (r["rows"], r["examples"], r["ready"]) for r in A.readiness_gate(table, images, labels, expected).collect()}
    assert len(got) == 3 * len(A.CRITICAL) + 3
    want = {
        ("train", "completed_page_mismatch"): (1, ["z"]), ("train", "missing_labels"): (1, ["t3"]), ("train", "metadata_label_mismatch"): (1, ["t2"]),
        ("train", "duplicate_tier_ids"): (2, ["t2"]), ("train", "unknown_tier_names"): (1, ["t3"]), ("validation", "completed_page_mismatch"): (1, ["c"]),
        ("validation", "missing_images"): (1, ["v4"]), ("validation", "unreadable_labels"): (1, ["v2"]), ("validation", "metadata_label_mismatch"): (1, ["v3"]),
        ("validation", "empty_ocr_targets"): (1, ["v1"]), ("validation", "invalid_dimensions"): (2, ["v1", "v2"]), ("validation", "ctc_infeasible"): (1, ["v1"]),
        ("train <-> validation", "parent_leakage"): (1, ["a"]),
    }
    for key, (rows, examples, ready) in got.items():
        assert (rows, examples) == want.get(key, (0, [])) and ready == (key not in want), key


def test_issue_examples_are_the_smallest(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), f"e{rng.randrange(500):03d}") for _ in range(2_000)]
    got = {r["issue"]: (r["rows"], r["examples"]) for r in A.issue_examples(spark.createDataFrame(rows, "issue string, example string").repartition(5), ["issue"], "example", 7).collect()}
    assert got == {k: (sum(i == k for i, _ in rows), sorted({e for i, e in rows if i == k})[:7]) for k in "xy"}


def test_paired_scores(spark):
    degraded = spark.createDataFrame([("k", "abcd", "abxd"), ("k", "abcd", "abcd"), ("m", "ab", ""), ("none", "zz", "zy"), (None, "q", "r")], "key string, truth string, prediction string")
    clean = spark.createDataFrame([("k", "abcd", "xbcd"), ("k", "abcd", "ybcd"), ("m", "ab", "ab"), (None, "q", "q")], "key string, truth string, prediction string")
    r = P.paired_scores(degraded, clean, ["key"]).first()
    assert [r[c] for c in ("readings", "paired", "characters", "edits", "clean_edits", "exact", "clean_exact", "worsened")] == [5, 4, 11, 4, 2, 1, 2, 2]
    assert r["cer"] == pytest.approx(4 / 11) and r["clean_exact_accuracy"] == 0.5


def test_targets_of_a_batch(spark):
    df = spark.createDataFrame([(1, 2, [3, 4]), (1, 1, [5]), (1, 3, []), (2, 1, [7, 8, 9]), (2, 2, None)], "batch int, place int, ids array<int>")
    got = {r["batch"]: (r["targets"], r["target_lengths"]) for r in Q.flat_targets(df, "batch", "ids", ["place"]).collect()}
    assert got == {1: ([5, 3, 4], [1, 2, 0]), 2: ([7, 8, 9], [3, 0])}
    padded = {(r["batch"], r["place"]): r["padded"] for r in Q.pad_targets(df.where("ids is not null"), "batch", "ids").collect()}
    assert padded[1, 1] == [5, 0] and padded[1, 3] == [0, 0] and padded[2, 1] == [7, 8, 9]


def test_feasibility_per_stride(spark):
    df = spark.createDataFrame([("a", 40, 10), ("a", 8, 3), ("b", 100, 30)], "split string, width int, need int")
    got = {(r["split"], r["stride"]): (r["tiers"], r["feasible"], r["min_margin"], r["failure_percent"]) for r in R.ctc_feasibility(df, "width", "need", (2, 4), ["split"]).collect()}
    assert got == {("a", 2): (2, 2, 1, 0.0), ("a", 4): (2, 1, -1, 50.0), ("b", 2): (1, 1, 20, 0.0), ("b", 4): (1, 0, -5, 100.0)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_error_sizes_in_parts_of_a_scale(spark, by):
    rng = random.Random(3)
    rows = [("xy"[k % 2], rng.gauss(0, 2), rng.uniform(1, 5), k % 3, 3) for k in range(200)]
    got = M.error_sizes(spark.createDataFrame(rows, "g string, e double, s double, part int, whole int"), "e", by, scale="s", covered=("part", "whole")).collect()
    for r in got:
        own = [x for x in rows if not by or x[0] == r["g"]]
        e, s = np.array([x[1] for x in own]), np.array([x[2] for x in own])
        assert r["signed_mean"] == pytest.approx(e.mean()) and r["p95_absolute"] == pytest.approx(np.percentile(abs(e), 95))
        assert r["median_normalized"] == pytest.approx(np.median(abs(e) / s)) and r["p95_normalized"] == pytest.approx(np.percentile(abs(e) / s, 95))
        assert r["coverage"] == pytest.approx(sum(x[3] for x in own) / sum(x[4] for x in own))
    assert len(got) == (2 if by else 1)


def test_error_sizes_order_both_measures_in_one_pass(spark, monkeypatch):
    """the table was read, merged and ordered once per measure."""
    from tierlens.operators import metrics

    passes, own = [], metrics.exact_quantiles
    monkeypatch.setattr(metrics, "exact_quantiles", lambda *a: passes.append(a) or own(*a))
    rows = [("x", -3.0, 2.0), ("x", 1.0, 2.0), ("x", None, 2.0), ("y", 4.0, 0.0), (None, 5.0, 10.0)]
    out = M.error_sizes(spark.createDataFrame(rows, "g string, e double, s double"), "e", ["g"], scale="s")
    assert out.columns == ["g", "rows", "median_absolute", "p95_absolute", "signed_mean", "median_normalized", "p95_normalized"]
    got = {r["g"]: (r["rows"], r["median_absolute"], r["signed_mean"], r["median_normalized"]) for r in out.collect()}
    assert got == {"x": (2, 2.0, -1.0, 1.0), None: (1, 5.0, 5.0, 0.5)}      # y has no scale, so no normalized value
    assert len(passes) == 1


def test_contract_links_records_to_controls_hashes_and_history(spark):
    columns = (
        "image_id string, validity string, category string, rule string, expected_outcome string, target string, image_sha256 string, original_image_hash string, parent_id string, mutation_family_id string, "
        "matched_control_id string, augmented boolean, verification_status string, evidence_status string, semantic_key string, parent_semantic_key string, novelty_verified boolean"
    )
    good = ("v", "VALID", "none", None, "ACCEPT", "t", "h1", "h1", "p", "p", "v", False, "AUTO_VERIFIED", "AUTO_VERIFIED", "k", "k", True)
    def like(image, **other):
        names = [c.split()[0] for c in columns.split(", ")]
        return tuple({**dict(zip(names, good)), "image_id": image, "image_sha256": f"hash of {image}", **other}[n] for n in names)
    rows = [
        good, like("a"), like("b", original_image_hash="x"), like("c", matched_control_id="gone"), like("d", parent_id="q", mutation_family_id="q"), like("e", image_sha256="same"), like("f", image_sha256="same"),
        like("g", verification_status="OPEN"), like("h", mutation_family_id="z"), like("i", semantic_key="old", parent_semantic_key="old"), like("j", semantic_key="other"), like("k", novelty_verified=None),
        like("l", validity="INVALID", category="cat", rule="r", expected_outcome="REJECT_INVALID", target=None), like("m", matched_control_id="l", original_image_hash="hash of l"),
    ]
    history = spark.createDataFrame([("old",), ("old",), (None,)], "semantic_key string")
    got = {}
    for r in A.contract_issues(spark.createDataFrame(rows, columns), {"cat": "r"}, history).collect():
        got.setdefault(r["image_id"], set()).add(r["issue"])
    assert got == {
        "b": {"original_hash_mismatch"}, "c": {"control_missing_or_wrong"}, "d": {"control_missing_or_wrong"}, "e": {"duplicate_image_bytes"}, "f": {"duplicate_image_bytes"}, "g": {"not_verified"},
        "h": {"family_is_not_parent"}, "i": {"historical_overlap"}, "j": {"semantic_key_mismatch"}, "k": {"novelty_not_established"}, "m": {"control_missing_or_wrong"},
    }
