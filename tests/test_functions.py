"""Scalar functions, frame paths, notation and edit distances on small literals."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tierlens.functions import ctc as C, hashing as H, labels as L, notation as N
from tierlens.functions.distance import _script, assess_correction, edit_counts, edit_events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, items, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(items, schema).select(*columns).collect()]


def test_widths_and_steps(spark):
    got = values(spark, [(1, 128), (5, 128), (100, 64)], "w int, h int", L.resized_width(F.col("w"), F.col("h")))
    assert [g[0] for g in got] == [1, 2, 100]
    w = F.col("w")
    assert values(spark, [(100,), (103,), (3,)], "w int", L.ctc_steps(w)) == [(25,), (25,), (1,)]
    assert values(spark, [(103,), (100,)], "w int", L.ctc_steps(w, 4, "ceil"), L.ctc_steps(w, 4, offset=1)) == [(26, 26), (25, 26)]
    with pytest.raises(ValueError):
        L.ctc_steps(w, rounding="up")


def test_required_frames(spark):
    texts = [("AA BB",), ("",), ("aaa",), ("baab",)]
    assert [r[0] for r in values(spark, texts, "s string", L.ctc_required(F.col("s")))] == [7, 0, 5, 5]
    ids = [([1, 1, 1],), ([2, 1, 1, 2],), ([],)]
    assert [r[0] for r in values(spark, ids, "a array<int>", L.ctc_required_ids(F.col("a")))] == [5, 5, 0]


def test_clean_label_keeps_inner_spaces(spark):
    assert values(spark, [("   a b ",)], "s string", L.clean_label(F.col("s")), L.leading_offset(F.col("s"))) == [("a b ", 3)]


@pytest.mark.parametrize("path,ok", [
    ("train/images/a.png", True), ("C:/images/a.png", False), ("/train/images/a.png", False), ("train/images/../a.png", False),
    ("train\\images\\a.png", False), ("test/images/a.png", False), ("train/images//a.png", False), ("train/images/", False), ("", False),
])
def test_valid_path(spark, path, ok):
    assert one(spark, L.valid_path(F.lit(path), "train", "images")) is ok


def test_problems_of_a_text_are_those_of_its_ids(spark):
    """the text's check evaluates nothing per character."""
    words = ["", "a", "aa", "ab", "?!", "??", "?!a", "\U0001F600\U0001F600", "\u0001", "\u0001?", "a$\\]^-[b", "  ", "]]", "||{", "o\u0301o", "zz\n\n", None]
    rows = [(w, t) for w in words for t in range(8)] + [("a", None)]
    text, steps = F.col("s"), F.col("t")
    problems = C.ctc_text_problems(text, steps)
    got = values(spark, rows, "s string, t int", text, problems, C.ctc_problems(C.encode(text), steps, len(N.VOCABULARY) + 1))
    assert all(a == b or s is None and not a and not b for s, a, b in got)
    plan = spark.createDataFrame(rows, "s string, t int").select(problems)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_ctc_problems(spark):
    rows = [([1, 2, 3], 10), ([4, 4, 4, 4], 5), ([], 10), ([0, 5], 10), ([70], 10)]
    got = [r[0] for r in values(spark, rows, "ids array<int>, t int", C.ctc_problems(F.col("ids"), F.col("t"), 67))]
    assert got == [[], ["too_few_steps"], ["empty_target"], ["contains_blank"], ["id_out_of_range"]]


def test_ctc_collapse_and_stats(spark):
    rows = [([0, 5, 5, 0, 5, 7, 7, 0],), ([0, 0, 0],), ([],)]
    got = values(spark, rows, "p array<int>", C.ctc_collapse(F.col("p")), C.path_stats(F.col("p")))
    assert [g[0] for g in got] == [[5, 5, 7], [], []]
    assert got[0][1].asDict() == dict(frames=8, blank_frames=3, blank_fraction=0.375, repeated_nonblank_frames=2, nonblank_runs=3, longest_run=2)
    assert got[2][1]["longest_run"] == 0 and got[2][1]["blank_fraction"] is None
    assert values(spark, [([1, 2, 2, 0, 3],)], "p array<int>", C.ctc_collapse(F.col("p"), 2)) == [([1, 0, 3],)]


def test_greedy_decode_first_class_wins(spark):
    frames = [([[0.1, 0.5, 0.5], [0.9, 0.0, 0.1], [0.2, 0.3, 0.5]],)]
    got = values(spark, frames, "f array<array<double>>", C.greedy_decode(F.col("f")), C.greedy_decode(F.col("f"), F.array(F.lit(0), F.lit(2))))
    assert got == [([1, 2], [2, 2])]


def test_vocabulary_round_trip(spark):
    got = values(spark, [("A b|",), ("éO",), ("",)], "s string", C.decode(C.encode(F.col("s"))), L.unknown_characters(F.col("s"), N.VOCABULARY))
    assert got == [("A b|", ""), ("", "Oé"), ("", "")]


def test_count_code(spark):
    rows = spark.range(0, 262).select("id", N.encode_count(F.col("id")).alias("e")).withColumn("d", N.decode_count(F.col("e"))).collect()
    assert all((r["d"] == r["id"]) if 1 <= r["id"] <= 259 else r["e"] is None for r in rows)
    codes = {r["id"]: r["e"] for r in rows}
    assert codes[241] == "+a" and codes[13] == "jc" and len({c for c in codes.values() if c}) == 259
    assert {9, 10, 19, 20, 250, 259} <= set(N.count_boundaries())


def test_symbol_direction(spark):
    got = values(spark, [("A",), ("W",), ("O",), ("a",), ("AB",)], "s string", N.symbol_direction(F.col("s")))
    assert [g[0] for g in got] == ["UP", "DOWN", None, None, None]


def test_canonical_row_and_key(spark):
    runs = spark.createDataFrame([(1, 0, 0, "A", 13), (1, 0, 1, "R", 2), (1, 1, 0, "B", 1)], "p int, r int, k int, symbol string, count int")
    rows = N.canonical_rows(runs, ["p", "r"], ["k"]).orderBy("r").collect()
    assert [(r["upper"], r["count"], r["lower"]) for r in rows] == [("A", "jcb", "  R"), ("B", "a", "")]
    import hashlib

    key = N.semantic_key(N.canonical_rows(runs, ["p", "r"], ["k"]), ["p"], "r").first()["semantic_key"]
    assert key == hashlib.sha256(b'[[["A",13,"UP"],["R",2,"DOWN"]],[["B",1,"UP"]]]').hexdigest()


def test_check_tiers(spark):
    texts = [("  N\njhjic\nY]R",), ("aj\nN\nR",), ("A\nb\nR\nR",), ("A",)]
    got = [r[0] for r in values(spark, texts, "s string", N.check_tiers(F.col("s")))]
    assert [g["valid"] for g in got] == [True, False, False, False]
    assert got[2]["lower"] == "RR" and got[2]["issues"] == ["line_count:4"]
    assert got[3]["issues"] == ["line_count:1", "count_empty"]


def test_parse_runs(spark):
    got = [r[0] for r in values(spark, [("TsFfJkb",), ("sT",), ("TT",), ("Tabc",), ("",)], "s string", N.parse_runs(F.col("s")))]
    assert [(r["symbol"], r["encoded_count"], r["direction"]) for r in got[0]["runs"]] == [("T", "s", "DOWN"), ("F", "f", "UP"), ("J", "kb", "UP")]
    assert [g["valid"] for g in got] == [True, False, False, False, False]


def test_hash_rank_is_compact_json(spark):
    import hashlib

    want = hashlib.sha256('[42,"train","tier","é\\"x"]'.encode()).hexdigest()
    assert one(spark, H.hash_rank(42, "train", "tier", F.lit('é"x'))) == want


def test_length_groups(spark):
    got = values(spark, [(4,), (5,), (64,), (65,)], "n int", L.length_group(F.col("n")))
    assert [g[0] for g in got] == ["short_le4", "medium_5_to64", "medium_5_to64", "long_ge65"]


def naive_script(a, b):
    """Plain table with the tie order match, substitution, deletion, insertion."""
    cost = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        cost[i, j] = cost[i - 1, j - 1] if a[i - 1] == b[j - 1] else 1 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            ops.append(("S", a[i], b[j], i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            ops.append(("D", a[i], "", i, j))
        else:
            j -= 1
            ops.append(("I", "", b[j], i, j))
    return ops[::-1]


def test_edit_scripts_match_plain_table(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abAé ") for _ in range(rng.randrange(9)))
    pairs = [("AB", "ABC"), ("ABC", "AB"), ("kitten", "sitting"), ("", ""), ("x" * 300, "y" * 290)] + [(word(), word()) for _ in range(300)]
    got = values(spark, pairs, "a string, b string", "a", "b", edit_counts(F.col("a"), F.col("b")), F.levenshtein("a", "b"))
    for a, b, c, d in got:
        ops = naive_script(a, b)
        assert tuple(c) == tuple(sum(o[0] == k for o in ops) for k in "SDI")
        assert sum(c) == d
        assert [tuple(e.values()) for e in _script(a, b)] == ops
    events = values(spark, [("AB", "ABC")], "a string, b string", edit_events(F.col("a"), F.col("b")))
    assert [tuple(e) for e in events[0][0]] == [("I", "", "C", 2, 2)]


def naive_options(raw, truth, index):
    """Characters met over all minimum scripts, by trying every split of the truth."""
    def dist(x, y):
        row = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            new = [i]
            for j, cy in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (cx != cy)))
            row = new
        return row[-1]

    total, found = dist(raw, truth), set()
    for j in range(len(truth) + 1):
        if dist(raw[:index], truth[:j]) + 1 + dist(raw[index + 1:], truth[j:]) == total:
            found.add(None)
        if j < len(truth) and dist(raw[:index], truth[:j]) + (raw[index] != truth[j]) + dist(raw[index + 1:], truth[j + 1:]) == total:
            found.add(truth[j])
    return found


def test_correction_assessment(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ABX") for _ in range(n))
    cases = [("XX", "B", 0, "B")] + [(r, word(rng.randrange(5)), rng.randrange(len(r)), "B") for r in (word(rng.randrange(1, 6)) for _ in range(120))]
    got = values(spark, cases, "r string, t string, i int, n string", "r", "t", "i", assess_correction(F.col("r"), F.col("t"), F.col("i"), F.col("n")))
    for r, t, i, a in got:
        options = naive_options(r, t, i)
        want = "uncertain_alignment"
        if len(options) == 1 and None not in options:
            want = "correct" if "B" in options else "incorrect"
        assert (a["assessment"], a["deletion_possible"]) == (want, None in options), (r, t, i, options)
        assert a["possible"] == "".join(sorted(c for c in options if c))
