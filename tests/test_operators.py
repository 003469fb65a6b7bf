"""Ranking, sampling, sequences, metrics and policies on small tables."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierlens.functions.hashing import hash_rank, tagged_hash
from tierlens.operators import compare as P, metrics as M, policy as Y, profile as R, ranking as K, sampling as W, sequence as Q
from tierlens.operators.alignment import analyse_rows, candidates


def test_rank_is_independent_of_partitioning(spark):
    df = spark.range(3000).select("id", tagged_hash("42:", F.col("id")).alias("h"))
    want = [r["id"] for r in df.orderBy("h").collect()]
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ranked = K.rank_within(df.repartition(int(n)), [], K.hash_bucket(F.col("h")), [F.col("h")])
        assert [r["id"] for r in ranked.orderBy("rank").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_quantiles_with_a_hot_value(spark):
    rng = random.Random(1)
    data = [("a", 7.5)] * 400 + [("a", rng.gauss(0, 50)) for _ in range(700)] + [("b", float(k)) for k in range(11)]
    got = {r["g"]: r for r in K.exact_quantiles(spark.createDataFrame(data, "g string, v double"), "v", {"p25": 0.25, "p99": 0.99}, ["g"]).collect()}
    for g in "ab":
        v = sorted(x for k, x in data if k == g)
        for name, q in (("p25", 0.25), ("p99", 0.99)):
            pos = (len(v) - 1) * q
            lo = int(pos)
            want = v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (pos - lo)
            assert got[g][name] == pytest.approx(want)
        assert (got[g]["rows"], got[g]["min"], got[g]["max"]) == (len(v), v[0], v[-1])


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(k),) for k in range(40)], "v double")
    assert K.order_statistic(df, "v", 0.05).first().asDict() == {"rows": 40, "threshold": 2.0}


def test_quantile_buckets_merge_empty_ones(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(2,)] * 5 + [(9,)] * 5, "v int")
    assert W.quantile_cuts(df, "v", 5).first()["cuts"] == [1.0]
    names = {r["v"]: r["v_bucket"] for r in W.quantile_buckets(df, "v", 5, "v").distinct().collect()}
    assert names == {1: "v_q1", 2: "v_q2", 9: "v_q2"}
    assert W.quantile_cuts(spark.createDataFrame([(4,)] * 9, "v int"), "v", 5).first()["cuts"] == []


def test_allocation_bounds(spark):
    rng = random.Random(5)
    rows, targets = [], {}
    for case in range(60):
        sizes = [rng.randrange(1, 400) for _ in range(rng.randrange(1, 15))]
        rows += [(case, f"s{k:02d}", n) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "c int, s string, n long")
    for target in (20, 150, 5000):
        got = {}
        for r in W.allocate(df, "s", "n", target, 5, ["c"]).collect():
            got.setdefault(r["c"], []).append(r)
        for part in got.values():
            total = sum(r["population"] for r in part)
            assert sum(r["allocation"] for r in part) == min(target, total)
            assert all(r["floor"] <= r["allocation"] <= r["population"] for r in part)
    with pytest.raises(PySparkException):
        W.allocate(spark.createDataFrame([("a", 5), ("b", 5)], "s string, n long"), "s", "n", 1).collect()


def test_sample_maximises_parents(spark):
    rng = random.Random(2)
    rows = [("train", f"x{rng.randrange(3)}", f"p{min(rng.randrange(60), 30)}", f"t{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "split string, st string, parent string, id string")
    sizes = df.groupBy("split", "st").agg(F.count(F.lit(1)).alias("n"))
    quota = W.allocate(sizes, "st", "n", 120, 5, ["split"])
    got = W.stratified_sample(df, quota, "split", "st", "parent", "id", 42).collect()
    want = {r["st"]: r["allocation"] for r in quota.collect()}
    assert len({r["id"] for r in got}) == len(got) == 120
    for st, n in want.items():
        mine = [r for r in got if r["st"] == st]
        parents = {r[2] for r in rows if r[1] == st}
        assert len(mine) == n and len({r["parent"] for r in mine}) == min(n, len(parents))


def test_repair_adds_only_what_is_missing(spark):
    rows = [("s", "x", "p0", "r0", "A"), ("s", "x", "p1", "r1", "XXX"), ("s", "x", "p0", "r2", "XXX"), ("s", "x", "p2", "r3", "X")]
    df = spark.createDataFrame(rows, "split string, st string, parent string, id string, label string")
    fixed = W.repair_coverage(df, df.where("id = 'r0'"), "AX", 3, "split", "parent", "id", "label", 1)
    assert sorted(r["id"] for r in fixed.collect()) == ["r0", "r1"]        # a new parent with the whole gain
    assert W.repair_coverage(df, fixed, "AX", 3, "split", "parent", "id", "label", 1).count() == 2


def test_repair_reaches_every_character_as_a_plain_run_does(spark):
    rng = random.Random(8)
    weights = [30, 20, 10, 5, 2, 1]
    rows = [("ab"[k % 2] if k % 11 else None, f"p{rng.randrange(40)}", f"r{k}", "".join(rng.choices("uvwxyz", weights, k=rng.randrange(1, 6)))) for k in range(300)]
    df = spark.createDataFrame(rows, "split string, parent string, id string, label string")
    start = [r for r in rows if rng.random() < 0.05]
    done = W.repair_coverage(df, spark.createDataFrame(start, df.schema), "uvwxyz", 9, "split", "parent", "id", "label", 5).collect()
    picked = {r["id"]: r for r in map(lambda x: dict(zip(("split", "parent", "id", "label"), x)), start)}
    total = collections.Counter(c for r in rows for c in r[3])
    hashes = {r["id"]: r["h"] for r in df.select("id", hash_rank(5, F.col("split"), "repair", F.col("id")).alias("h")).collect()}
    for char in sorted("uvwxyz", key=lambda c: (total[c], c)):
        for split in ("a", "b", None):
            mine = [r for r in rows if r[0] == split]
            chosen = [r for r in picked.values() if r["split"] == split]
            need = min(9, sum(r[3].count(char) for r in mine)) - sum(r["label"].count(char) for r in chosen)
            parents = {r["parent"] for r in chosen}
            ranked = sorted((r for r in mine if char in r[3] and r[2] not in picked), key=lambda r: (r[1] in parents, -r[3].count(char), hashes[r[2]] or "", r[2]))
            for r in ranked:
                if need <= 0:
                    break
                picked[r[2]] = dict(zip(("split", "parent", "id", "label"), r))
                need -= r[3].count(char)
    assert sorted(r["id"] for r in done) == sorted(picked)
    for split in ("a", "b", None):
        for char in "uvwxyz":
            have = sum(r["label"].count(char) for r in done if r["split"] == split)
            assert have >= min(9, sum(r[3].count(char) for r in rows if r[0] == split))


def test_character_totals_and_reads_of_a_repair(spark, monkeypatch):
    rows = [("a", "p0", "r0", "xx😀é"), ("a", "p1", "r1", None), (None, "p2", "r2", "😀 y"), ("b", "p3", "r3", ""), ("a", "p4", "r4", "y")]
    df = spark.createDataFrame(rows, "split string, parent string, id string, label string")
    assert W._character_totals(df, "split", "label", "xy😀é ") == {"a": {"x": 2, "y": 1, "😀": 1, "é": 1, " ": 0}, None: {"x": 0, "y": 1, "😀": 1, "é": 0, " ": 1}}
    read = []
    real = W._character_totals
    monkeypatch.setattr(W, "_character_totals", lambda some, *a: read.append(some) or real(some, *a))
    start = df.where("id = 'r1'")
    assert sorted(r["id"] for r in W.repair_coverage(df, start, "xy😀é ", 1, "split", "parent", "id", "label", 1).collect()) == ["r0", "r1", "r2", "r4"]
    assert sum(some is df for some in read) == 1 and sum(some is start for some in read) == 1


def test_group_split_sizes(spark):
    got = W.group_split(spark.range(100).union(spark.range(40)), "id", 42)
    assert dict(got.groupBy("assigned_split").count().collect()) == {"protected_test": 15, "validation_calibration": 15, "development_design": 70}


def test_width_batches(spark):
    df = spark.createDataFrame([(f"t{i}", 10 + i % 83) for i in range(500)], "id string, w int")
    rows = W.width_batches(df, "id", "w", 400, 8, pool=128).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"t{i}" for i in range(500))
    batches = {}
    for r in rows:
        batches.setdefault((r["pool"], r["batch"]), []).append(r["w"])
    assert all(max(b) * len(b) <= 400 and len(b) <= 8 for b in batches.values())
    other = W.width_batches(df, "id", "w", 400, 8, pool=128, epoch=1).collect()
    assert {(r["id"], r["pool"]) for r in other} != {(r["id"], r["pool"]) for r in rows}
    with pytest.raises(PySparkException):
        W.width_batches(df.union(spark.createDataFrame([("wide", 401)], "id string, w int")), "id", "w", 400, 8).collect()


def test_split_limit(spark):
    df = spark.createDataFrame([(s, k) for s in ("a", "b", "c") for k in range(20)], "split string, id int")
    got = dict(W.split_limit(df, "split", ["a", "b", "c"], 11, ["id"]).groupBy("split").count().collect())
    assert got == {"a": 4, "b": 4, "c": 3}


def merge_smallest(runs, k):
    runs = [list(r) for r in runs]
    while len(runs) > k:
        i = min(range(len(runs) - 1), key=lambda n: runs[n + 1][0] - runs[n][1])
        runs[i : i + 2] = [[runs[i][0], runs[i + 1][1]]]
    return [tuple(r) for r in runs]


def test_reduce_and_merge_runs(spark):
    rng, rows, groups = random.Random(4), [], {}
    for g in range(60):
        place, runs = 0, []
        for _ in range(rng.randrange(1, 9)):
            start = place + rng.randrange(1, 5)
            place = start + rng.randrange(1, 4)
            runs.append((start, place))
        groups[g] = runs
        rows += [(g, s // 7, s, e) for s, e in runs]
    df = spark.createDataFrame(rows, "g int, b int, s int, e int")
    got = {}
    for r in Q.reduce_runs(df, ["g"], "b", "s", "e", 3).orderBy("g", "s").collect():
        got.setdefault(r["g"], []).append((r["s"], r["e"]))
    assert got == {g: merge_smallest(r, 3) for g, r in groups.items() if len(r) >= 3}
    got = {}
    for r in Q.merge_runs(df, ["g"], "b", "s", "e", 2).orderBy("g", "s").collect():
        got.setdefault(r["g"], []).append((r["s"], r["e"]))
    for g, runs in groups.items():
        want = [list(runs[0])]
        for s, e in runs[1:]:
            if s - want[-1][1] <= 2:
                want[-1][1] = e
            else:
                want.append([s, e])
        assert got[g] == [tuple(w) for w in want]


def test_run_length_across_buckets(spark):
    path = [0, 5, 5, 0, 5, 7, 7, 0]
    df = spark.createDataFrame([("u", i // 3, i, str(c)) for i, c in enumerate(path)], "u string, b int, i int, c string")
    got = [(r["c"], r["start_frame"], r["end_frame"], r["character_index"]) for r in Q.run_length(df, ["u"], "b", ["i"], "c", "0").orderBy("run").collect()]
    assert got == [("0", 0, 1, None), ("5", 1, 3, 0), ("0", 3, 4, None), ("5", 4, 5, 1), ("7", 5, 7, 2), ("0", 7, 8, None)]


def test_recognition_metrics(spark):
    df = spark.createDataFrame([("ABC", "ADC"), ("A", "A")], "truth string, prediction string")
    m = M.recognition_metrics(M.score_pairs(df)).first()
    assert (m["samples"], m["cer"], m["exact_accuracy"]) == (2, 0.25, 0.5)
    empty = M.recognition_metrics(M.score_pairs(df.limit(0))).first()
    assert empty["samples"] == 0 and empty["cer"] is None


def outcome_rows(spark, rows):
    base = "0 as edits, 0 as raw_edits, 3 as characters, true as exact, true as raw_exact, array() as reason_codes, 0 as corrections, 'ACCEPT' as expected_outcome"
    return spark.createDataFrame(rows, "parent string, validity string, outcome string").selectExpr("*", *base.split(", "))


def test_policy_metrics_and_macro(spark):
    df = outcome_rows(spark, [("a", "INVALID", "ACCEPT"), ("a", "INVALID", "REVIEW_UNCERTAIN"), ("b", "INVALID", "REJECT_INVALID"), ("a", "VALID", "ACCEPT"), ("b", "VALID", "REJECT_INVALID")])
    m = M.policy_metrics(df).first()
    assert m["invalid_accepted_rate"] == m["invalid_review_rate"] == m["true_invalid_rejection_rate"] == pytest.approx(1 / 3)
    assert m["false_definitive_rejection_rate"] == 0.5
    df = outcome_rows(spark, [("a", "INVALID", "ACCEPT"), ("a", "INVALID", "ACCEPT"), ("b", "INVALID", "REVIEW_UNCERTAIN")])
    assert M.policy_metrics(df).first()["invalid_accepted_rate"] == pytest.approx(2 / 3)
    assert M.macro_average(df, "parent", ["invalid_accepted_rate"]).first()["macro_invalid_accepted_rate"] == 0.5
    assert dict(M.worst_case(df, "parent").collect()) == {"a": "critical_failure", "b": "unresolved_review"}
    three = {r["validity"]: r for r in M.three_way(df).collect()}
    assert three["INVALID"]["REJECT_INVALID"] == 0


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(8)
    change = spark.createDataFrame([(k, rng.gauss(0.3, 1)) for k in range(200)], "p long, v double")
    b = P.parent_bootstrap(change, "p", "v", 400).first()
    assert b["lower95"] < b["mean_change"] < b["upper95"] and 0.15 < b["upper95"] - b["lower95"] < 0.45
    assert b == P.parent_bootstrap(change.repartition(7), "p", "v", 400).first()


def test_bootstrap_draws_as_many_parents_as_there_are(spark):
    def mean(r, by_rank):
        picks = [int(hashlib.md5(f"42:{r}:{k}".encode()).hexdigest()[:12], 16) % len(by_rank) for k in range(len(by_rank))]
        return sum(by_rank[p] for p in picks) / len(picks)

    rng = random.Random(9)
    rows = [(k, rng.gauss(0.3, 1)) for k in range(5_000)]
    by_rank = [v for _, v in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())]
    low, high = sorted(mean(r, by_rank) for r in range(2))
    b = P.parent_bootstrap(spark.createDataFrame(rows, "p long, v double"), "p", "v", 2).first()
    assert b["parent_count"] == 5_000 and b["resamples"] == 2
    assert b["lower95"] == pytest.approx(low + 0.025 * (high - low)) and b["upper95"] == pytest.approx(low + 0.975 * (high - low))


@pytest.mark.parametrize("most, join", [(1_000_000, "BroadcastHashJoin"), (100, "SortMergeJoin")])
def test_bootstrap_draws_are_never_broadcast(spark, monkeypatch, most, join):
    plans = {}
    monkeypatch.setattr(P, "materialize", lambda df, name, write=P.materialize: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    change = spark.range(5_000).select(F.col("id").alias("p"), (F.col("id") % 7).cast("double").alias("v"))
    want = P.parent_bootstrap(change, "p", "v", 20).first()
    monkeypatch.setattr(P, "_BROADCAST_PARENTS", most)
    assert P.parent_bootstrap(change, "p", "v", 20).first() == want
    assert join in plans["resample-means"] and "BuildLeft" not in plans["resample-means"]


def test_rows_of_one_split_do_not_meet_in_one_task(spark):
    rows = spark.range(0, 40_000, 1, 8).selectExpr(
        "'train' as split", "concat('s', id % 2) as stratum", "id % 5000 as parent", "id as tier_id", "cast(id % 90 as int) as length"
    )
    quota = spark.createDataFrame([("train", "s0", 30_000), ("train", "s1", 30_000)], "split string, stratum string, allocation long")
    largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if every table were large
    try:
        assert largest(W.quantile_buckets(rows, "length", 5, "label", ["split"])) < 20_000
        taken = W.stratified_sample(rows, quota, "split", "stratum", "parent", "tier_id", 42)
        assert largest(taken) < 20_000 and taken.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unpaired_records_stop_the_job(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, outcome string")
    with pytest.raises(PySparkException):
        P.require_paired(P.paired(a, a.where("id = 1"), "id", [], ["outcome"]), "id").collect()


def test_monotonicity(spark):
    pairs = spark.createDataFrame([("ACCEPT", "REVIEW_UNCERTAIN"), ("REVIEW_UNCERTAIN", "ACCEPT"), ("ACCEPT", "REJECT_INVALID"), ("REJECT_INVALID", "REJECT_INVALID")], "a string, b string")
    assert P.monotonicity_violations(pairs, "a", "b").count() == 2


def test_prototype_of_two_classes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [1.0, 0.1], 1)], "id int, e array<float>, label int")
    got = {r["id"]: r for r in R.nearest_prototype(v, "label", "e", 2).collect()}
    assert got[1]["nearest_correct"] and got[3]["nearest_correct"] and not got[4]["nearest_correct"]


def aligned(spark, rows):
    df = spark.createDataFrame(rows, "upper string, count string, lower string")
    return [(r["aligned_code"], r["row_total"]) for r in Y.validate_aligned(df).collect()]


def test_aligned_rows(spark):
    got = aligned(spark, [("A", "jcb", "  R"), ("A", "a", "R"), ("O", "a", ""), ("R", "a", ""), ("A", "ab", ""), ("AA", "ab", ""), (" A", " a", ""), ("A", "a", None), ("A ", "a", "")])
    assert got == [
        ("ALIGNED_CANONICAL_OK", 15), ("SYMBOL_POSITION_CONTRADICTION", None), ("AMBIGUOUS_NOTATION", None), ("WRONG_SYMBOL_DIRECTION", None),
        ("NONCANONICAL_COUNT_TOKEN", None), ("ADJACENT_IDENTICAL_RUNS", None), ("MISSING_ALIGNED_SYMBOL", None), ("MALFORMED_ALIGNED_TEXT", None), ("NONCANONICAL_ALIGNMENT", None),
    ]


def test_alignment_search(spark):
    df = spark.createDataFrame([(1, 0, "D", "a", None), (2, 0, "D", "aa", "R"), (3, 0, "D", None, None), (4, 0, "DDD", "a", None)], "page int, row int, upper string, count string, lower string")
    found = candidates(df, "page", "row")
    ok = {(r["page"], r["upper_offset"], r["lower_offset"]) for r in found.where("outcome = 'ACCEPT'").collect()}
    assert ok == {(1, 0, None), (2, 0, 1), (2, 1, 0)}
    status = {r["page"]: (r["status"], r["contradiction"]) for r in analyse_rows(found, "page", "row").collect()}
    assert status == {1: ("one_in_search", False), 2: ("multiple_in_search", False), 3: ("unsupported", False), 4: ("none_in_search", True)}
    capped = analyse_rows(candidates(df, "page", "row", max_offset=0), "page", "row").where("page = 2").first()
    assert not capped["exhaustive"] and not capped["contradiction"]


def test_box_overlap(spark):
    rng = random.Random(6)
    box = lambda p: (p, *(lambda x, y: (x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 40)))(rng.randrange(300), rng.randrange(200)))
    regions, boxes = [box(k % 3) for k in range(15)], [box(k % 4) for k in range(80)]
    names = "p int, x0 int, y0 int, x1 int, y1 int"
    got = {tuple(r)[:5]: r["hit"] for r in P.box_overlaps(spark.createDataFrame(regions, names), spark.createDataFrame(boxes, names), ["p"], cell=32).collect()}
    for b in boxes:
        want = any(r[0] == b[0] and max(r[1], b[1]) < min(r[3], b[3]) and max(r[2], b[2]) < min(r[4], b[4]) for r in regions)
        assert got[b] == want
    assert not any(hit for b, hit in got.items() if b[0] == 3)      # a page without regions


def test_exact_sample_prefers_unused_parents(spark):
    import hashlib
    import json

    def rank(*parts):
        return hashlib.sha256(json.dumps([42, *parts], separators=(",", ":")).encode()).hexdigest()

    rng = random.Random(12)
    rows = [("train", f"s{rng.randrange(4)}", f"p{rng.randrange(9)}", f"t{k:03d}") for k in range(70)]
    want_n = {"s0": 6, "s1": 11, "s2": 3, "s3": 9}
    queues = {}
    for _, st, p, t in sorted(rows, key=lambda r: rank("train", "tier", r[3])):
        queues.setdefault(st, {}).setdefault(p, []).append(t)
    left, uses, chosen = dict(want_n), {}, set()
    for turn in range(70):
        for st in sorted(queues, key=lambda s: (len(queues[s]), s)):
            ready = sorted((p for p, q in queues[st].items() if len(q) > turn), key=lambda p: (uses.get(p, 0), rank("train", "parent", p), p))
            for p in ready[: left[st]]:
                chosen.add(queues[st][p][turn])
                uses[p] = uses.get(p, 0) + 1
                left[st] -= 1
    df = spark.createDataFrame(rows, "split string, st string, parent string, id string")
    quota = spark.createDataFrame([("train", s, n) for s, n in want_n.items()], "split string, st string, allocation long")
    got = W.stratified_sample(df, quota, "split", "st", "parent", "id", 42, exact=True)
    assert {r["id"] for r in got.collect()} == chosen


# -- rows that must not get lost ----------------------------------------------

def test_null_readings_stay_samples(spark):
    from tierlens.operators.metrics import recognition_metrics, score_pairs

    pairs = spark.createDataFrame([("ab", "ab"), ("ab", None), (None, "x"), (None, None)], "truth string, prediction string")
    scored = score_pairs(pairs)
    assert scored.count() == 4
    row = recognition_metrics(scored).first()
    assert (row["samples"], row["exact_matches"], row["edits"], row["characters"]) == (4, 1, 0, 4)


def test_null_groups_keep_their_rows(spark):
    from tierlens.operators.audit import with_group_size
    from tierlens.operators.profile import drift
    from tierlens.operators.ranking import cumulative_counts, previous_row, rank_within, running_sum

    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", 2, None)], "g string, at int, v int").withColumn("b", F.lit("x"))
    assert {(r["g"], r["at"]): r["rank"] for r in rank_within(df, ["g"], F.col("b"), [F.col("at")]).collect()} == {(None, 1): 1, (None, 2): 2, ("a", 1): 1, ("a", 2): 2}
    assert previous_row(df, ["g"], "b", ["at"], ["v"]).count() == 4
    assert {(r["g"], r["at"]): r["s"] for r in running_sum(df, ["g"], "b", ["at"], "v", "s").collect()}[(None, 2)] == 11
    assert cumulative_counts(df, "v", ["g"], 32).count() == 3
    assert sorted(r["group_size"] for r in with_group_size(df, "g").collect()) == [2, 2, 2, 2]
    same = drift(df, df, ["g"]).collect()
    assert {r["value"]: (r["full_count"], r["subset_count"]) for r in same} == {None: (2, 2), "a": (2, 2)}


def test_runs_across_buckets_equal_a_plain_loop(spark):
    import random

    from tierlens.operators.sequence import run_length

    rng = random.Random(3)
    rows = [(None if k % 3 == 0 else f"g{k % 3}", k, k // 7, rng.choice("ab-")) for k in range(200)]
    got = run_length(spark.createDataFrame(rows, "g string, at int, b int, v string"), ["g"], "b", ["at"], "v", "-").collect()
    want = []
    for g in {r[0] for r in rows}:
        run, inked, last = 0, 0, None
        for place, (_, _, _, v) in enumerate(r for r in rows if r[0] == g):
            if v != last:
                run, last = run + 1, v
                want.append([g, run, v, place, place + 1, inked if v != "-" else None])
                inked += v != "-"
            want[-1][4] = place + 1
    key = lambda r: (str(r[0]), r[1])
    assert sorted(([r["g"], r["run"], r["v"], r["start_frame"], r["end_frame"], r["character_index"]] for r in got), key=key) == sorted(want, key=key)


def test_alike_boxes_stay_apart(spark):
    from tierlens.operators.compare import box_overlaps

    boxes = spark.createDataFrame([("p", 0, 0, 5, 5), ("p", 0, 0, 5, 5), (None, 0, 0, 5, 5)], "page string, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["hit"] for r in box_overlaps(boxes.limit(1), boxes, ["page"]).collect()) == [False, True, True]


def test_readings_of_a_long_page(spark):
    from tierlens.operators.alignment import page_totals, summed_readings

    for rows, exact in ((33, True), (40, False), (200, False)):
        found = spark.createDataFrame([("p", r, "ACCEPT", 1, f"t{k}") for r in range(rows) for k in range(3)], "page string, row int, outcome string, row_total int, reading string")
        counts = spark.createDataFrame([("p", rows)], "page string, rows long")
        got = page_totals(found, counts, "page", "row").groupBy("page").agg(*summed_readings()).first()
        assert got["readings"] == (3**rows if exact else 2**63 - 1) and got["readings_exact"] == exact and not got["single"]


def test_blank_tiers_are_reviewed_and_other_tiers_too(spark):
    from tierlens.operators.policy import row_violation

    rows = spark.createDataFrame([(1, "\t", "1", None, False), (2, None, "1", None, True)], "row int, upper string, count string, lower string, more boolean")
    got = {r["row"]: (r["v"]["outcome"], r["v"]["code"]) for r in rows.select("row", row_violation(F.col("row"), F.col("more")).alias("v")).collect()}
    assert got[1] == ("REVIEW_UNCERTAIN", "EMPTY_DECODED_TIER") and got[2] == ("REVIEW_UNCERTAIN", "UNSUPPORTED_TIER_LAYOUT")


def test_thresholds_need_enough_finite_values(spark):
    few = spark.createDataFrame([(float(k),) for k in range(19)], "v double")
    assert K.order_statistic(few, "v", 0.05).first()["rows"] == 19
    for bad, why in ((few, "too few"), (few.union(spark.createDataFrame([(float("nan"),), (1.0,)], "v double")), "not finite")):
        with pytest.raises(Exception, match=why):
            K.order_statistic(bad, "v", 0.05, minimum=20).collect()
    assert K.order_statistic(few.union(few), "v", 0.05, minimum=20).first()["threshold"] == 0.0  # place 1 of 0, 0, 1, 1, ...


def test_policy_metrics_count_edits_failures_and_triggers(spark):
    rows = [
        ("p", "INVALID", "REVIEW_UNCERTAIN", ["DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH", "LOW", "LOW"], "ACCEPT", 2, 1, 0, True, None),
        ("p", "INVALID", "ACCEPT", [], "REJECT_INVALID", 0, 0, 3, False, "timeout"), ("q", "VALID", "REVIEW_UNCERTAIN", ["LOW"], "ACCEPT", None, None, None, False, None),
    ]
    df = spark.createDataFrame(rows, "parent string, validity string, outcome string, reason_codes array<string>, interpreted_syntax string, correct_edits long, incorrect_edits long, unknown_edits long, ocr_failure boolean, pipeline_exception string")
    df = df.selectExpr("*", "0 as edits", "0 as raw_edits", "3 as characters", "true as exact", "true as raw_exact", "0 as corrections", "'ACCEPT' as expected_outcome", "reason_codes as raw_reason_codes")
    got = {(r["dimension"], r["value"]): r for r in M.policy_slices(df, ["parent", "validity"]).collect()}
    assert set(got) == {("overall", "all"), ("parent", "p"), ("parent", "q"), ("validity", "VALID"), ("validity", "INVALID")}
    whole = got["overall", "all"]
    assert [whole[c] for c in ("correct_edits", "incorrect_edits", "unknown_edits", "ocr_failures", "pipeline_exceptions", "preprocessing_failures")] == [2, 1, 3, 1, 1, 0]
    assert (whole["wrong_tier_reviews"], whole["raw_wrong_tier_images"], whole["invalid_syntax_passes"]) == (1, 1, 1)
    assert whole["invalid_interpreted_syntax_pass_rate"] == 0.5 and got["validity", "INVALID"]["images"] == 2 and got["validity", "VALID"]["invalid_interpreted_syntax_pass_rate"] is None
    alone = M.policy_metrics(df, ["parent"]).where("parent = 'q'").first()
    assert alone["correct_edits"] == 0 and alone["images"] == 1
    assert {(r["code"], r["images"]) for r in M.rule_triggers(df).collect()} == {("DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH", 1), ("LOW", 2)}


def test_verdict_counts_per_record(spark):
    edits = spark.createDataFrame([(1, "AX", "AB", 1, "B"), (1, "AX", "AC", 1, "B"), (2, "AX", "AB", 1, "B"), (2, "X", None, 0, "B")], "id int, raw string, truth string, index int, replacement string")
    got = {r["id"]: tuple(r)[1:] for r in M.edit_verdict_counts(edits, "id").collect()}
    assert got == {1: (1, 1, 0), 2: (1, 0, 1)}


def test_search_verdicts_are_those_of_aligned_rows(spark):
    """The batched verdicts of the search against the column rules, for any characters."""
    from tierlens.functions import aligned as V

    rng, rows = random.Random(11), []
    tier = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n))).lstrip(" ")
    for k in range(3000):
        c = tier("abcjké " if k % 3 else "ajb", 9)
        u, l = tier("AB   O\x00€R" if k % 2 else "ABC  ", 7), tier("RST   " if k % 5 else "RST A\U0001f600", 7)
        room = [max(0, len(c) - len(t)) for t in (u, l)]
        moved = rng.random() < 0.5
        if u.strip(" ") or l.strip(" "):
            rows.append((k, "" if not u.strip(" ") else u, c, "" if not l.strip(" ") else l, rng.randint(0, room[0]) if moved else 0, 0 if moved else rng.randint(0, room[1])))
    rows.append((-1, "A", None, "R", None, None))
    df = spark.createDataFrame(rows, "k int, u string, c string, l string, ou int, ol int").repartition(3)
    shift = lambda t, n: F.when(F.col(t) != "", F.concat(F.repeat(F.lit(" "), F.col(n)), F.col(t))).otherwise("")
    drawn = df.withColumns({"_u": shift("u", "ou"), "_l": shift("l", "ol")})
    told = drawn.withColumn("runs", Y.aligned_runs(F.col("_u"), F.col("c"), F.col("_l")))
    told = told.withColumn("code", F.when(F.col("ou").isNotNull(), Y.aligned_verdict(F.col("runs"), F.col("_u"), F.col("c"), F.col("_l"))))
    told = told.select("k", "code", F.when(F.col("code") == "ALIGNED_CANONICAL_OK", F.aggregate("runs", F.lit(0), lambda a, r: a + r["count"])).alias("total"),
                       F.when(F.col("code") == "ALIGNED_CANONICAL_OK", F.array_join(F.transform("runs", lambda r: F.concat(r["symbol"], r["token"])), "")).alias("reading"))
    got = df.withColumn("v", V.aligned_verdicts(*[F.col(x) for x in ("u", "c", "l", "ou", "ol")])).select("k", "v.code", "v.row_total", "v.reading")
    expected = sorted(map(tuple, told.collect()))
    assert sorted(map(tuple, got.collect())) == expected and len({e[1] for e in expected}) == 9
    texts = [pa.array([r[j] for r in rows], pa.string() if j < 4 else pa.int32()) for j in range(1, 6)]
    whole, V.BATCH_CHARACTERS = V._verdicts.func(iter([tuple(texts)])), 50
    try:
        assert next(whole).to_pylist() == [dict(zip(("code", "row_total", "reading"), e[1:])) for e in sorted(expected, key=lambda e: [r[0] for r in rows].index(e[0]))]
    finally:
        V.BATCH_CHARACTERS = 4_000_000


def test_measured_pages_are_the_single_analyses(spark):
    """All page facts from one grouping of the candidates against those of the functions that group anew."""
    from tierlens.operators import alignment as X

    rng, rows, told = random.Random(12), [], []
    for page in range(60):
        for row in range(rng.randrange(1, 4)):
            n = rng.randrange(1, 5)
            rows.append((page, row, "".join(rng.choice("AB ") for _ in range(n)).strip() or None, "".join(rng.choice("abj") for _ in range(n)) if rng.random() < 0.95 else None, rng.choice(["R", "S", None, "O"])))
            for tier in ("upper", "lower", "count"):
                if rng.random() < 0.9:
                    at = float(rng.randrange(3)) if tier != "count" else 0.0
                    told.append((page, row, tier, at, max(at - rng.choice([0.1, 0.6]), 0.0), at + 0.125))
    found = candidates(spark.createDataFrame(rows, "page int, row int, upper string, count string, lower string"), "page", "row").localCheckpoint()
    measured = spark.createDataFrame(told, "page int, row int, tier string, offset double, low double, high double")
    got = {r["page"]: r for r in X.measured_pages(found, measured, "page", "row").collect()}
    for r in X.combine_pages(found, "page", "row").collect():
        assert r.asDict().items() <= got[r["page"]].asDict().items()
    counts = X.combine_pages(found, "page", "row").select("page", "rows")
    marked = X.match_offsets(found, measured, "page", "row").localCheckpoint()
    for kind, some in (("before", found), ("after", marked.where("retained"))):
        single = {r["page"]: (r["readings"], r["selected_total"]) for r in X.distinct_readings(some, counts, "page", "row").collect()}
        assert {p: (r[f"{kind}_readings"], r[f"{kind}_total"]) for p, r in got.items() if r[f"{kind}_readings"] is not None} == single and single
    common = X.page_totals(found, counts, "page", "row", True).select("page", "row_total")
    doubt = {r["page"]: r["d"] for r in marked.join(common, ["page", "row_total"], "left_semi").groupBy("page").agg(F.bool_or("boundary_uncertain").alias("d")).collect()}
    assert {p: r["doubt"] for p, r in got.items() if r["doubt"] is not None} == doubt and len(set(doubt.values())) == 2
    assert {p: r["measured"] for p, r in got.items() if r["measured"] is not None} == {r["page"]: r["m"] for r in marked.groupBy("page").agg(F.bool_and("measured").alias("m")).collect()}
