"""Role evidence, scoped equivalents, edits and their verdicts."""

import random

import pytest
from pyspark.sql import functions as F

from tierlens.functions import codes, distance, notation as N
from tierlens.operators import interpretation as I

PAIRS = "source string, target string, target_role string, status string, font_sha256 string, verified_sizes array<int>, source_mode string, anchor string"
OK = codes.VERIFIED_IN_SCOPE
MAPPING = [
    ("X", "B", "upper", OK, "f", [24, 48], "L", "a"), ("Y", "P", "upper", OK, "f", [48], "L", "a"), ("Y", "F", "upper", OK, "f", [48], "L", "a"),
    ("Y", "P", "upper", OK, "f", [24], "L", "a"), ("Z", "D", "upper", "proposed", "f", [48], "L", "a"), ("Z", "b", "upper", OK, "f", [48], "L", "a"),
    ("Z", "DD", "upper", OK, "f", [48], "L", "a"), ("X", "C", "upper", OK, "g", [48], "L", "a"), ("B", "R", "lower", OK, "f", [48], "L", "a"),
]
PAGES = (
    "page long, preprocessing_status string, segmentation_accepted boolean, ocr_status string, legal_alternatives int, role_margin double, rejection string, "
    "font_sha256 string, font_size_px int, source_mode string, anchor string, provenance string, conflicting_evidence string"
)


def page(n, font="f", size=48, provenance=codes.CANONICAL_RENDERING, conflict=None, status="ok", margin=0.5, alternatives=2, rejection=""):
    return (n, status, True, "ok", alternatives, margin, rejection, font, size, "L", "a", provenance, conflict)


def records(rows):
    out = []
    for p, r, *texts in rows:
        for role, text in zip(N.ROLES, texts):
            if text is not None:
                out += [(p, r, role, "segmentation", "0,0", None), (p, r, role, "observed", "0,0", text), (p, r, role, "path", None, None)]
    return out


def run(spark, pages, rows, told=None):
    table = spark.createDataFrame(rows, "page long, row int, upper string, count string, lower string")
    told = spark.createDataFrame(records(rows) if told is None else told, "page long, row int, role string, kind string, box string, prediction string")
    evidenced = I.role_evidence(table, spark.createDataFrame(pages, PAGES), told, "page", "row", 0.1)
    return evidenced, I.interpret_rows(evidenced, spark.createDataFrame(MAPPING, PAIRS), "page", "row")


def brute(text, role, scope, canonical):
    allowed, edits, doubts = " " + N.tier_alphabet(role), [], []
    for i, c in enumerate(text):
        if c in allowed:
            continue
        targets = {m[1] for m in MAPPING if m[0] == c and m[2] == role and m[3] == OK and len(m[1]) == 1 and m[1] in allowed and m[4] == scope[0] and scope[1] in m[5] and canonical}
        if len(targets) == 1:
            edits.append((i, c, min(targets)))
        else:
            code = codes.T1_MULTIPLE_ROLE_EQUIVALENTS if targets else codes.T1_NO_VERIFIED_ROLE_EQUIVALENT
            doubts += [code] if code not in doubts else []
    if doubts:
        return text, [], doubts
    out = list(text)
    for i, _, new in edits:
        out[i] = new
    return "".join(out), edits, [codes.T1_VERIFIED_GLYPH_ROLE_DISAMBIGUATION if edits else codes.T1_NO_CHANGE_NEEDED]


def test_interpretation_follows_the_rule_character_by_character(spark):
    rng = random.Random(4)
    pages = [page(1), page(2, size=24), page(3, font="g"), page(4, provenance="upload"), page(5, size=30)]
    scope = {1: ("f", 48), 2: ("f", 24), 3: ("g", 48), 4: ("f", 48), 5: ("f", 30)}
    text = lambda letters: None if rng.random() < 0.2 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))
    rows = [(p, r, text("AB XYZ" if r % 2 else "ABX"), text("ab z"), text("RB S")) for p in scope for r in range(30)]
    _, done = run(spark, pages, rows)
    got = {(r["page"], r["row"]): r for r in done.collect()}
    assert len(got) == len(rows)
    for p, r, *texts in rows:
        edits, reasons = [], []
        for role, said in zip(N.ROLES, texts):
            if said is None:
                assert got[p, r][role] is None
                continue
            want, made, why = brute(said, role, scope[p], p != 4)
            assert got[p, r][role] == want
            edits += [(role, *e, said) for e in made]
            reasons += [(role, code) for code in why]
        assert [tuple(e) for e in got[p, r]["edits"]] == edits and [tuple(x) for x in got[p, r]["reasons"]] == reasons
        assert got[p, r]["corrections"] == len(edits)


def test_evidence_for_roles(spark):
    rows = [(1, k, "A", "a", None) for k in range(7)]
    told = records(rows)
    def change(row, keep, *more):
        told[:] = [t for t in told if not (t[1] == row and t[2] == "upper" and not keep(t))] + list(more)
    change(1, lambda t: t[3] != "observed", (1, 1, "upper", "observed", "0,0", "B"))             # another text
    change(2, lambda t: t[3] != "segmentation")                                                  # never cut
    change(3, lambda t: True, (1, 3, "upper", "observed", "0,0", "A"))                           # seen twice
    change(4, lambda t: t[3] != "segmentation", (1, 4, "upper", "segmentation", "9,9", None))    # another box
    change(5, lambda t: t[3] != "path")                                                          # not in the path
    told[:] = [t for t in told if t[1] != 6]                                                     # nothing known at all
    evidenced, done = run(spark, [page(1)], rows, told)
    why = {r["row"]: r["evidence_upper"] for r in evidenced.collect()}
    conflict = [codes.D1_ROW_TIER_METADATA_CONFLICT]
    assert why == {0: [], 1: conflict, 2: conflict, 3: conflict, 4: [codes.D1_CROP_METADATA_CONFLICT], 5: [codes.D1_PATH_ROLE_CONFLICT], 6: [*conflict, codes.D1_PATH_ROLE_CONFLICT]}
    assert all(r["evidence_lower"] is None for r in evidenced.collect())
    assert {r["row"]: r["uncertain"] for r in done.collect()} == {k: k > 0 for k in range(7)}


def test_page_evidence_and_conflicts(spark):
    pages = [
        page(1, status="skewed"), page(2, margin=0.05), page(3, margin=None, alternatives=1), page(4, margin=float("inf")), page(5, rejection="thin"), page(6, conflict="two scans"),
    ]
    rows = [(k, 0, "X", "a", None) for k in range(1, 7)]
    evidenced, done = run(spark, pages, rows)
    assert {r["page"]: r["evidence_count"] for r in evidenced.collect()} == {
        1: [codes.D1_OR_OCR_NOT_READY], 2: [codes.D1_ROLE_CONFIDENCE_NOT_SUPPORTED], 3: [], 4: [codes.D1_ROLE_CONFIDENCE_NOT_SUPPORTED], 5: [codes.D1_REJECTION_PRESENT], 6: [],
    }
    got = {r["page"]: r for r in done.collect()}
    assert got[3]["upper"] == "B" and got[2]["upper"] == "X"
    assert {x["code"] for x in got[6]["reasons"]} == {codes.T1_CONFLICTING_EVIDENCE} and {x["code"] for x in got[1]["reasons"]} == {codes.T1_ROLE_NOT_RELIABLY_ESTABLISHED}


def test_a_tier_of_an_unknown_role_is_left_alone(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(I.interpreted_tier(F.lit("A"), "margin", F.lit(None), F.array().cast("array<string>"), none).alias("t")).first()["t"]
    assert (row["text"], row["uncertain"], row["reasons"]) == ("A", True, [codes.T1_MISSING_OR_UNKNOWN_ROLE])


def test_verdicts_of_edits(spark):
    rows = [(1, 0, "AXB", "a", None), (1, 1, "X", "a", None), (1, 2, "X", "a", None), (1, 3, "XX", "a", None)]
    _, done = run(spark, [page(1)], rows)
    truth = spark.createDataFrame([(1, 0, "ABB"), (1, 1, "C"), (1, 3, "B")], "page long, row int, upper string").selectExpr("*", "'a' as count", "cast(null as string) as lower")
    got = {(r["row"], r["index"]): (r["assessment"], r["possible"], r["deletion_possible"]) for r in I.correction_verdicts(done, truth, "page", "row").collect()}
    assert got == {
        (0, 1): ("correct", "B", False), (1, 0): ("incorrect", "C", False), (2, 0): ("uncertain_alignment", "", True),
        (3, 0): ("uncertain_alignment", "B", True), (3, 1): ("uncertain_alignment", "B", True),
    }


def test_rows_are_interpreted_once_for_their_verdicts(spark):
    """F16: edits and verdicts each interpreted every row again, and a filter on the edits did so once more."""
    _, done = run(spark, [page(1)], [(1, 0, "AXB", "a", None)])
    truth = spark.createDataFrame([(1, 0, "ABB")], "page long, row int, upper string").selectExpr("*", "'a' as count", "cast(null as string) as lower")
    verdicts = I.correction_verdicts(done, truth, "page", "row")
    assert [r["assessment"] for r in verdicts.collect()] == ["correct"]
    assert "_targets_upper" not in verdicts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_long_pairs_give_the_scripts_of_short_ones(monkeypatch, seed):
    rng = random.Random(seed)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(2))
        monkeypatch.setattr(distance, "WHOLE_TABLE_CELLS", 1_000_000)
        want = distance._script(a, b)
        monkeypatch.setattr(distance, "WHOLE_TABLE_CELLS", -1)
        assert distance._script(a, b) == want


def test_a_long_pair_needs_little_memory():
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(6_000))
    b = "".join(c for c in a if rng.random() > 0.05) + "x" * 200
    tracemalloc.start()
    events = distance._script(a, b)
    options = distance._truth_options(a, b, 3_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000        # the whole table has 36 million cells
    assert options[1] or options[0]
    text = list(a)
    for e in reversed(events):
        at = e["reference_pos"]
        if e["op"] == "I":
            text.insert(at, e["predicted"])
        else:
            text[at : at + 1] = [e["predicted"]] if e["op"] == "S" else []
    assert "".join(text) == b


def test_contextual_decision_interprets_rows_once(spark):
    rows = spark.createDataFrame([(1, 0, "X", "a", None)], "page long, row int, upper string, count string, lower string")
    told = spark.createDataFrame(records([(1, 0, "X", "a", None)]), "page long, row int, role string, kind string, box string, prediction string")
    out = I.contextual_decision(spark.createDataFrame([page(1)], PAGES), rows, told, spark.createDataFrame(MAPPING, PAIRS), "page", "row", 0.1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_targets_upper#") and plan.count("Generate explode(verified_sizes") == 1
    assert out.select("corrections", "uncertain", "syntax_resolved").first() == (1, False, True)
