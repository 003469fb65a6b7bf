"""Grammar checks, decisions, repair, alignment search and review policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tierlens.functions import codes, notation as N
from tierlens.operators import alignment as X, audit as A, compare as P, interpretation as I, policy as Y
from tierlens.plans import bindings as B
from tierlens.plans.registry import query, with_ctes
from tierlens.session import materialize

STATUS = ["preprocessing_status", "segmentation_accepted", "ocr_status", "legal_alternatives", "role_margin", "rejection", "nonblank_geomean"]
MARGIN = 0.1
#: Verified look-alikes: source, target, role, status, font, sizes, mode, anchor.
MAPPING = [
    ("X", "B", "upper", "verified_exact_in_scope", "f1", [24, 48], "L", "lt_integer"), ("X", "B", "upper", "verified_exact_in_scope", "f2", [48], "L", "lt_integer"),
    ("X", "P", "upper", "verified_exact_in_scope", "f2", [48], "L", "lt_integer"), ("X", "C", "upper", "proposed", "f1", [48], "L", "lt_integer"),
    ("O", "S", "lower", "verified_exact_in_scope", "f1", [48], "L", "lt_integer"), ("O", "T", "lower", "verified_exact_in_scope", "f1", [24], "L", "lt_integer"),
    ("X", "b", "upper", "verified_exact_in_scope", "f1", [48], "L", "lt_integer"), ("O", "T", "lower", "verified_exact_in_scope", "f1", [48], "1", "lt_integer"),
]
_MAPPING_COLUMNS = "source string, target string, target_role string, status string, font_sha256 string, verified_sizes array<int>, source_mode string, anchor string"


def pages(spark, sf) -> DataFrame:
    """Status columns of every page that has a decision to make."""
    return B.images(spark, sf).select(F.col("image_id").alias("page"), *STATUS)


def rendered_pages(spark, sf) -> DataFrame:
    """Status and rendering scope of every page; some are uploads without canonical metadata, some have conflicting evidence."""
    cents = F.floor("price").cast("long")
    return B.images(spark, sf).select(
        F.col("image_id").alias("page"), *STATUS, F.when(cents % 13 == 0, "f2").otherwise("f1").alias("font_sha256"),
        F.when(cents % 3 == 1, 24).when(cents % 17 == 0, 30).otherwise(48).alias("font_size_px"), F.lit("L").alias("source_mode"), F.lit("lt_integer").alias("anchor"),
        F.when(cents % 19 == 0, "upload").otherwise(codes.CANONICAL_RENDERING).alias("provenance"), F.when(cents % 23 == 0, "two scans").otherwise("").alias("conflicting_evidence"),
    )


def equivalents(spark) -> DataFrame:
    return spark.createDataFrame(MAPPING, _MAPPING_COLUMNS)


def tier_metadata(rows: DataFrame) -> DataFrame:
    """Segmentation, observation and path records of the tiers; some are lacking, double or at odds, by a rule on page and row."""
    k, said = (F.col("page") * 7 + F.col("row")) % 97, F.col("t.said")
    tiers = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(at * 10).alias("at"), F.col(r).alias("said")) for at, r in enumerate(N.ROLES)])
    # two short steps instead of one array of twelve records a row
    each = rows.select("page", "row", F.explode(tiers).alias("t")).where("t.said is not null").select(
        "page", "row", "t.role", k.alias("k"), said.alias("said"), F.concat_ws(",", F.col("row") * 30, F.col("t.at"), F.length(said) * 8).alias("box"),
    )
    k, text, box, none = F.col("k"), F.col("said"), F.col("box"), F.lit(None).cast("string")
    record = lambda kind, box, said: F.struct(F.lit(kind).alias("kind"), box.alias("box"), said.alias("prediction"))
    seen = record("observed", box, F.when(k == 0, F.concat(text, F.lit("A"))).otherwise(text))
    records = [
        seen, F.when(k == 1, seen), F.when(k != 2, record("segmentation", F.when(k == 3, F.concat(box, F.lit("0"))).otherwise(box), none)),
        F.when((k != 4) | (F.col("role") != "lower"), record("path", none, none)),
    ]
    return each.select("page", "row", "role", F.explode(F.array(*records)).alias("r")).where("r is not null").select("page", "row", "role", "r.*")


_UP, _DOWN, _CNT = "'ABCDEFGHIJKLMNPQ'", r"'RSTUVWXYZ[\]^_'", "'abcdefghijklmnopqrstuvwxyz{|''()*+,'"


def _bad(text: str, alphabet: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({text}, ''), lambda c: c NOT IN ('', ' ', 'O') AND strpos({alphabet}, c) = 0))), '')"


def _role_sql(role: str, alphabet: str) -> str:
    return (
        f"WHEN {role} IS NOT NULL AND trim({role}) = '' THEN ['REVIEW_UNCERTAIN', 'EMPTY_DECODED_TIER', '{role}', NULL] "
        f"WHEN strpos({role}, 'O') > 0 THEN ['REVIEW_UNCERTAIN', 'AMBIGUOUS_NOTATION', '{role}', NULL] "
        f"WHEN {role} IS NOT NULL AND {_bad(role, alphabet)} <> '' THEN ['REJECT_INVALID', 'DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH', '{role}', {_bad(role, alphabet)}] "
    )


def _syntax_sql(src: str, out: str, base: str = "images") -> str:
    """Page outcome of the observable grammar over the tier table `src`."""
    return f"""
{out}_rows AS (SELECT page, row, CASE WHEN count IS NULL THEN ['REVIEW_UNCERTAIN', 'MISSING_COUNT_TIER', NULL, NULL] {_role_sql('upper', _UP)} {_role_sql('count', _CNT)} {_role_sql('lower', _DOWN)}
   WHEN upper IS NULL AND lower IS NULL THEN ['REVIEW_UNCERTAIN', 'COUNT_WITHOUT_SYMBOL_TIER', NULL, NULL] END AS v FROM {src}),
{out}_first AS (SELECT page, arg_min(v, row) FILTER (WHERE v IS NOT NULL) AS v, min(row) FILTER (WHERE v IS NOT NULL) AS r, count(*) AS decoded_rows FROM {out}_rows GROUP BY page),
{out} AS (SELECT i.*, i.image_id AS page, CASE WHEN f.page IS NULL THEN 'REVIEW_UNCERTAIN' ELSE coalesce(v[1], 'ACCEPT') END AS syntax_outcome,
   CASE WHEN f.page IS NULL THEN 'NO_DECODED_ROWS' ELSE coalesce(v[2], 'OBSERVABLE_SYNTAX_OK') END AS syntax_code, f.r::BIGINT AS syntax_row, v[3] AS syntax_role, v[4] AS syntax_glyphs, coalesce(decoded_rows, 0) AS decoded_rows
   FROM {base} i LEFT JOIN {out}_first f ON f.page = i.image_id)"""


def _evidence_sql(src: str, out: str, low: str = "[]::VARCHAR[]") -> str:
    return f"""
{out}_f AS (SELECT *, list_concat(list_filter([
    CASE WHEN preprocessing_status IN ('unreadable', 'no_ink') THEN 'INPUT_' || upper(preprocessing_status) END,
    CASE WHEN preprocessing_status NOT IN ('unreadable', 'no_ink') AND (preprocessing_status <> 'ok' OR NOT segmentation_accepted) THEN 'D1_NO_SAFE_PROPOSAL' END,
    CASE WHEN coalesce(ocr_status <> 'ok', true) AND preprocessing_status = 'ok' AND segmentation_accepted THEN 'OCR_UNAVAILABLE' END,
    CASE WHEN (coalesce(ocr_status = 'ok', false) OR decoded_rows > 0) AND syntax_outcome <> 'ACCEPT' THEN syntax_code END], lambda x: x IS NOT NULL),
    CASE WHEN preprocessing_status = 'ok' AND segmentation_accepted AND coalesce(ocr_status = 'ok', false) THEN {low} ELSE [] END) AS f FROM {src}),
{out} AS (SELECT * EXCLUDE (f), CASE WHEN preprocessing_status IN ('unreadable', 'no_ink') THEN 'REJECT_INVALID' WHEN len(f) > 0 THEN 'REVIEW_UNCERTAIN' ELSE 'ACCEPT' END AS outcome,
    CASE WHEN len(f) > 0 THEN f ELSE ['OBSERVABLE_CHECKS_PASSED'] END AS reasons FROM {out}_f)"""


_BASE = (B.IMAGES_SQL, B.NOTATION_SQL, B.DECODED_SQL)


@query("r01_tier_grammar", with_ctes("SELECT page, syntax_outcome, syntax_code, syntax_row, syntax_role, syntax_glyphs, decoded_rows FROM syn", *_BASE, _syntax_sql("decoded", "syn")))
def r01(spark, sf):
    v = Y.validate_pages(pages(spark, sf), B.decoded(spark, sf), "page", "row")
    return v.select("page", "syntax_outcome", "syntax_code", "syntax_row", "syntax_role", "syntax_glyphs", "decoded_rows")


# -- aligned rows ------------------------------------------------------------

def _decode_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) = 1 AND strpos('abcdefghi', {t}) > 0 THEN strpos('abcdefghi', {t}) WHEN length({t}) = 1 AND strpos('jklmnopqrstuvwxyz{{|''()*+,', {t}) > 0 THEN 10 * strpos('jklmnopqrstuvwxyz{{|''()*+,', {t}) "
        f"WHEN length({t}) = 2 AND strpos('jklmnopqrstuvwxyz{{|''()*+,', {t}[1]) > 0 AND strpos('abcdefghi', {t}[2]) > 0 THEN 10 * strpos('jklmnopqrstuvwxyz{{|''()*+,', {t}[1]) + strpos('abcdefghi', {t}[2]) END"
    )


def _aligned_sql(src: str, out: str) -> str:
    """Verdict of aligned rows with the columns u, c, l."""
    return rf"""
{out}_p AS (SELECT *, list_filter(range(1, greatest(length(u), length(l)) + 1), lambda i: trim(u[i]) <> '' OR trim(l[i]) <> '') AS pos FROM {src}),
{out}_r AS (SELECT *, list_transform(range(1, len(pos) + 1), lambda k: {{'s': pos[k] - 1, 'up': trim(u[pos[k]]), 'dn': trim(l[pos[k]]), 'tok': ltrim(substr(c, pos[k], greatest(coalesce(pos[k + 1] - 1, length(c)) - (pos[k] - 1), 0)))}}) AS rs FROM {out}_p),
{out}_t AS (SELECT *, list_transform(rs, lambda r: {{'s': r.s, 'up': r.up, 'dn': r.dn, 'sym': CASE WHEN r.up <> '' THEN r.up ELSE r.dn END, 'tok': r.tok, 'n': {_decode_sql('r.tok')}}}) AS runs FROM {out}_r),
{out}_f AS (SELECT *, list_filter(list_transform(range(1, len(runs) + 1), lambda k: CASE WHEN (runs[k].up <> '') = (runs[k].dn <> '') THEN 'SYMBOL_POSITION_CONTRADICTION' WHEN runs[k].sym = 'O' THEN 'AMBIGUOUS_NOTATION'
     WHEN (runs[k].up <> '' AND strpos({_UP}, runs[k].sym) = 0) OR (runs[k].up = '' AND strpos({_DOWN}, runs[k].sym) = 0) THEN 'WRONG_SYMBOL_DIRECTION'
     WHEN runs[k].n IS NULL THEN 'NONCANONICAL_COUNT_TOKEN' WHEN k > 1 AND runs[k - 1].sym = runs[k].sym THEN 'ADJACENT_IDENTICAL_RUNS' END), lambda x: x IS NOT NULL) AS faults FROM {out}_t),
{out}_v AS (SELECT *, CASE WHEN c IS NULL THEN 'MALFORMED_ALIGNED_TEXT' WHEN len(runs) = 0 OR runs[1].s <> 0 THEN 'MISSING_ALIGNED_SYMBOL' WHEN len(faults) > 0 THEN faults[1]
     WHEN array_to_string(list_transform(runs, lambda r: r.tok), '') <> c
       OR rtrim(array_to_string(list_transform(runs, lambda r: CASE WHEN r.up <> '' THEN rpad(r.sym, length(r.tok)::INT, ' ') ELSE repeat(' ', length(r.tok)) END), '')) <> u
       OR rtrim(array_to_string(list_transform(runs, lambda r: CASE WHEN r.up <> '' THEN repeat(' ', length(r.tok)) ELSE rpad(r.sym, length(r.tok)::INT, ' ') END), '')) <> l THEN 'NONCANONICAL_ALIGNMENT'
     ELSE 'ALIGNED_CANONICAL_OK' END AS code FROM {out}_f),
{out} AS (SELECT *, CASE WHEN code = 'ALIGNED_CANONICAL_OK' THEN 'ACCEPT' WHEN code IN ('MALFORMED_ALIGNED_TEXT', 'AMBIGUOUS_NOTATION') THEN 'REVIEW_UNCERTAIN' ELSE 'REJECT_INVALID' END AS verdict,
     CASE WHEN code = 'ALIGNED_CANONICAL_OK' THEN list_sum(list_transform(runs, lambda r: r.n))::INT END AS total, array_to_string(list_transform(runs, lambda r: r.sym || r.tok), '') AS reading FROM {out}_v)"""


_MARKED_SQL = """
aligned_rows AS (SELECT page, row, CASE WHEN discount >= 9 THEN translate(upper, 'B', 'X') ELSE upper END AS u, CASE WHEN tax = 8 THEN substr(count, 1, 1) || ' ' || substr(count, 2) WHEN tax = 5 THEN count || 'a' ELSE count END AS c,
   CASE WHEN tax = 6 THEN translate(lower, 'T', 'O') ELSE lower END AS l FROM notation)"""


@query("r02_aligned_rows", with_ctes("SELECT page, row, code AS aligned_code, verdict AS aligned_outcome, total AS row_total FROM al", B.NOTATION_SQL, _MARKED_SQL, _aligned_sql("aligned_rows", "al")))
def r02(spark, sf):
    """Aligned rows, some with a misread symbol, a count gap or a surplus count."""
    count = F.when(F.col("tax") == 8, F.concat(F.substr("count", F.lit(1), F.lit(1)), F.lit(" "), F.substr("count", F.lit(2)))).when(F.col("tax") == 5, F.concat("count", F.lit("a"))).otherwise(F.col("count"))
    rows = B.notation(spark, sf).select(
        "page", "row", F.when(F.col("discount") >= 9, F.translate("upper", "B", "X")).otherwise(F.col("upper")).alias("upper"), count.alias("count"),
        F.when(F.col("tax") == 6, F.translate("lower", "T", "O")).otherwise(F.col("lower")).alias("lower"),
    )
    return Y.validate_aligned(rows).select("page", "row", "aligned_code", "aligned_outcome", "row_total")


# -- decisions ---------------------------------------------------------------

@query("r03_evidence_decision", with_ctes("SELECT page, outcome, array_to_string(reasons, ';') AS reason_codes FROM dec", *_BASE, _syntax_sql("decoded", "syn"), _evidence_sql("syn", "dec")))
def r03(spark, sf):
    v = Y.validate_pages(pages(spark, sf), B.decoded(spark, sf), "page", "row")
    return Y.evidence_decision(v).select("page", "outcome", F.array_join("reason_codes", ";").alias("reason_codes"))


@query("r03_baseline_decision", with_ctes("""
SELECT image_id AS page, CASE WHEN preprocessing_status IN ('unreadable', 'no_ink') THEN 'REJECT_INVALID' WHEN preprocessing_status <> 'ok' OR NOT segmentation_accepted OR coalesce(ocr_status <> 'ok', true) THEN 'REVIEW_UNCERTAIN' ELSE 'ACCEPT' END AS outcome,
  CASE WHEN preprocessing_status IN ('unreadable', 'no_ink') THEN 'INPUT_' || upper(preprocessing_status) WHEN preprocessing_status <> 'ok' OR NOT segmentation_accepted THEN 'D1_NO_SAFE_PROPOSAL' WHEN coalesce(ocr_status <> 'ok', true) THEN 'OCR_UNAVAILABLE' ELSE 'D1_PROPOSAL_E1_OUTPUT' END AS reason_codes
FROM images""", B.IMAGES_SQL))
def r03b(spark, sf):
    return Y.baseline_decision(pages(spark, sf)).select("page", "outcome", F.array_join("reason_codes", ";").alias("reason_codes"))


THRESHOLDS = {"nonblank_geomean": 0.2, "role_margin": 0.15}
_LOW_SQL = """list_filter([CASE WHEN nonblank_geomean IS NULL THEN 'CONFIDENCE_MISSING_NONBLANK_GEOMEAN' END, CASE WHEN nonblank_geomean < 0.2 THEN 'CONFIDENCE_LOW_NONBLANK_GEOMEAN' END,
  CASE WHEN role_margin IS NULL THEN 'CONFIDENCE_MISSING_ROLE_MARGIN' END, CASE WHEN role_margin < 0.15 THEN 'CONFIDENCE_LOW_ROLE_MARGIN' END], lambda x: x IS NOT NULL)"""


@query("r04_confidence", with_ctes("SELECT page, outcome, array_to_string(reasons, ';') AS reason_codes FROM dec", *_BASE, _syntax_sql("decoded", "syn"), _evidence_sql("syn", "dec", _LOW_SQL)))
def r04(spark, sf):
    """Decision with minimum confidence values on top."""
    v = Y.validate_pages(pages(spark, sf), B.decoded(spark, sf), "page", "row")
    return Y.evidence_decision(v, THRESHOLDS).select("page", "outcome", F.array_join("reason_codes", ";").alias("reason_codes"))


_GAP_SQL = """
gapped AS (SELECT d.*, coalesce(g.n, 0) AS gap_rows FROM dec d LEFT JOIN (SELECT page, count(*) AS n FROM decoded WHERE strpos(trim(count), ' ') > 0 GROUP BY page) g ON g.page = d.page)"""


@query("r05_gap_guard", with_ctes("""
SELECT page, gap_rows, outcome AS outcome_before, CASE WHEN gap_rows > 0 AND outcome = 'ACCEPT' THEN 'REVIEW_UNCERTAIN' ELSE outcome END AS outcome,
  array_to_string(CASE WHEN gap_rows > 0 THEN list_append(reasons, 'R2_INTERNAL_DECODED_COUNT_GAP') ELSE reasons END, ';') AS reason_codes FROM gapped""", *_BASE, _syntax_sql("decoded", "syn"), _evidence_sql("syn", "dec"), _GAP_SQL))
def r05(spark, sf):
    rows = B.decoded(spark, sf)
    d = Y.gap_guard(Y.evidence_decision(Y.validate_pages(pages(spark, sf), rows, "page", "row")), rows, "page")
    return d.select("page", "gap_rows", "outcome_before", "outcome", F.array_join("reason_codes", ";").alias("reason_codes"))


_MAPPING_SQL = "mapping AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{source}', '{target}', '{role}', '{status}', '{font}', {sizes}, '{mode}', '{anchor}')" for source, target, role, status, font, sizes, mode, anchor in MAPPING
) + f""") m(source, target, role, status, font, sizes, mode, anchor)),
equivalent AS (SELECT DISTINCT source, target, role, font, unnest(sizes) AS size, mode, anchor FROM mapping WHERE status = 'verified_exact_in_scope'
  AND (role = 'upper' AND strpos({_UP}, target) > 0 OR role = 'lower' AND strpos({_DOWN}, target) > 0 OR role = 'count' AND strpos({_CNT}, target) > 0))"""
_EVIDENCE_SQL = f"""
page_why AS (SELECT image_id AS page, floor(price)::BIGINT AS cents, list_filter([CASE WHEN NOT (preprocessing_status = 'ok' AND segmentation_accepted AND coalesce(ocr_status = 'ok', false)) THEN 'D1_OR_OCR_NOT_READY' END,
  CASE WHEN NOT (legal_alternatives = 1 OR coalesce(legal_alternatives >= 2 AND role_margin >= {MARGIN}, false)) THEN 'D1_ROLE_CONFIDENCE_NOT_SUPPORTED' END, CASE WHEN rejection <> '' THEN 'D1_REJECTION_PRESENT' END], lambda x: x IS NOT NULL) AS why FROM images),
tier AS (SELECT page, row, role, text, (page * 7 + row) % 97 AS k FROM (
  SELECT page, row, unnest(['upper', 'count', 'lower']) AS role, unnest([upper, count, lower]) AS text FROM decoded) WHERE text IS NOT NULL),
evidence AS (SELECT t.*, p.cents, list_concat(p.why, list_filter([CASE WHEN k < 3 THEN 'D1_ROW_TIER_METADATA_CONFLICT' END, CASE WHEN k = 3 THEN 'D1_CROP_METADATA_CONFLICT' END,
  CASE WHEN k = 4 AND role = 'lower' THEN 'D1_PATH_ROLE_CONFLICT' END], lambda x: x IS NOT NULL)) AS why FROM tier t JOIN page_why p ON p.page = t.page)"""
_REPAIRED_SQL = f"""
{_MAPPING_SQL},
wrong AS (SELECT page, row, role, cents, i - 1 AS index, text[i] AS ch FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM evidence WHERE cents % 23 <> 0 AND len(why) = 0)
  WHERE strpos(CASE role WHEN 'upper' THEN {_UP} WHEN 'lower' THEN {_DOWN} ELSE {_CNT} END || ' ', text[i]) = 0),
options AS (SELECT w.page, w.row, w.role, w.index, w.ch, count(e.target) AS n, min(e.target) AS target FROM wrong w
  LEFT JOIN equivalent e ON e.role = w.role AND e.source = w.ch AND cents % 19 <> 0 AND e.font = CASE WHEN cents % 13 = 0 THEN 'f2' ELSE 'f1' END
   AND e.size = CASE WHEN cents % 3 = 1 THEN 24 WHEN cents % 17 = 0 THEN 30 ELSE 48 END AND e.mode = 'L' AND e.anchor = 'lt_integer' GROUP BY ALL),
asked AS (SELECT page, row, role, min(index) FILTER (WHERE n = 0) AS none_at, min(index) FILTER (WHERE n > 1) AS many_at FROM options GROUP BY ALL),
judged AS (SELECT e.page, e.row, e.role, e.text AS raw, CASE WHEN e.cents % 23 = 0 THEN ['T1_CONFLICTING_EVIDENCE'] WHEN len(e.why) > 0 THEN ['T1_ROLE_NOT_RELIABLY_ESTABLISHED'] WHEN a.page IS NULL THEN []
   WHEN none_at IS NULL AND many_at IS NULL THEN [] WHEN many_at IS NULL THEN ['T1_NO_VERIFIED_ROLE_EQUIVALENT'] WHEN none_at IS NULL THEN ['T1_MULTIPLE_ROLE_EQUIVALENTS']
   WHEN none_at < many_at THEN ['T1_NO_VERIFIED_ROLE_EQUIVALENT', 'T1_MULTIPLE_ROLE_EQUIVALENTS'] ELSE ['T1_MULTIPLE_ROLE_EQUIVALENTS', 'T1_NO_VERIFIED_ROLE_EQUIVALENT'] END AS doubts, a.page IS NOT NULL AS asked
  FROM evidence e LEFT JOIN asked a ON a.page = e.page AND a.row = e.row AND a.role = e.role),
edit AS (SELECT o.*, j.raw FROM options o JOIN judged j ON j.page = o.page AND j.row = o.row AND j.role = o.role WHERE len(doubts) = 0),
fixed AS (SELECT j.page, j.row, j.role, doubts, asked, coalesce((SELECT string_agg(coalesce(e.target, x.ch), '' ORDER BY x.i) FROM (SELECT i - 1 AS i, j.raw[i] AS ch FROM range(1, length(j.raw) + 1) r(i)) x
   LEFT JOIN edit e ON e.page = j.page AND e.row = j.row AND e.role = j.role AND e.index = x.i), j.raw) AS text,
   coalesce(n, 0) AS n, edits FROM judged j LEFT JOIN (SELECT page, row, role, count(*) AS n, string_agg(role || ':' || index || ':' || ch || '>' || target, ';' ORDER BY index) AS edits FROM edit GROUP BY ALL) c
   ON c.page = j.page AND c.row = j.row AND c.role = j.role),
repaired AS (SELECT page, row, max(text) FILTER (role = 'upper') AS upper, max(text) FILTER (role = 'count') AS count, max(text) FILTER (role = 'lower') AS lower, sum(n)::INT AS corrections, bool_or(len(doubts) > 0) AS uncertain,
   coalesce(string_agg(edits, ';' ORDER BY strpos('upper count lower', role)), '') AS edits,
   string_agg(role || ':' || CASE WHEN len(doubts) > 0 THEN array_to_string(doubts, '+') WHEN asked THEN 'T1_VERIFIED_GLYPH_ROLE_DISAMBIGUATION' ELSE 'T1_NO_CHANGE_NEEDED' END, ';' ORDER BY strpos('upper count lower', role)) AS reasons
  FROM fixed GROUP BY page, row)"""


def interpreted(spark, sf, rows: DataFrame) -> DataFrame:
    evidenced = I.role_evidence(rows, rendered_pages(spark, sf), tier_metadata(rows), "page", "row", MARGIN)
    return I.interpret_rows(evidenced, equivalents(spark), "page", "row")


@query("r06_tier_repair", with_ctes("SELECT page, row, upper, count, lower, corrections, uncertain, edits, reasons FROM repaired", *_BASE, _EVIDENCE_SQL, _REPAIRED_SQL))
def r06(spark, sf):
    """Interpreted tiers with every edit (role:index:original>replacement) and the reasons per tier."""
    done = interpreted(spark, sf, B.decoded_from(notation_once(spark, sf)))
    edit = F.transform("edits", lambda e: F.concat(e["role"], F.lit(":"), e["index"], F.lit(":"), e["original_character"], F.lit(">"), e["replacement_character"]))
    of = lambda r: F.array_join(F.transform(F.filter("reasons", lambda x: x["role"] == r), lambda x: x["code"]), "+")
    reasons = F.array_compact(F.array(*[F.when(F.col(r).isNotNull(), F.concat(F.lit(f"{r}:"), of(r))) for r in N.ROLES]))
    return done.select("page", "row", *N.ROLES, "corrections", "uncertain", F.array_join(edit, ";").alias("edits"), F.array_join(reasons, ";").alias("reasons"))


@query("r07_role_reliability", with_ctes("SELECT page, row, role, array_to_string(why, ';') AS reasons, len(why) = 0 AS reliable FROM evidence", *_BASE, _EVIDENCE_SQL))
def r07(spark, sf):
    """Why a tier's role isn't reliably known: page, segmentation, observation and path at odds."""
    rows = B.decoded_from(notation_once(spark, sf))
    told = I.role_evidence(rows, rendered_pages(spark, sf), tier_metadata(rows), "page", "row", MARGIN)
    each = told.select("page", "row", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"evidence_{r}").alias("why")) for r in N.ROLES])).alias("t")).where("t.why is not null")
    return each.select("page", "row", "t.role", F.array_join("t.why", ";").alias("reasons"), (F.size("t.why") == 0).alias("reliable"))


_CONTEXT_SQL = """
context AS (SELECT n.page, r.outcome AS raw_outcome, CASE WHEN coalesce(c.uncertain, false) AND n.outcome = 'ACCEPT' THEN 'REVIEW_UNCERTAIN' ELSE n.outcome END AS outcome,
  CASE WHEN coalesce(c.uncertain, false) AND n.outcome = 'ACCEPT' THEN list_append(n.reasons, 'T1_CONTEXT_UNCERTAIN') ELSE n.reasons END AS reasons, coalesce(c.corrections, 0)::BIGINT AS corrections,
  coalesce(c.uncertain, false) AS uncertain, r.syntax_outcome <> 'ACCEPT' AND n.syntax_outcome = 'ACCEPT' AS syntax_resolved, n.preprocessing_status, n.segmentation_accepted, n.ocr_status
FROM dec2 n JOIN dec r ON r.page = n.page LEFT JOIN (SELECT page, sum(corrections) AS corrections, bool_or(uncertain) AS uncertain FROM repaired GROUP BY page) c ON c.page = n.page)"""
_CONTEXT = (*_BASE, _EVIDENCE_SQL, _REPAIRED_SQL, _syntax_sql("decoded", "syn"), _evidence_sql("syn", "dec"), _syntax_sql("repaired", "syn2"), _evidence_sql("syn2", "dec2"), _CONTEXT_SQL)


def contextual(spark, sf, enabled: bool = True) -> DataFrame:
    rows = B.decoded_from(notation_once(spark, sf))
    return I.contextual_decision(rendered_pages(spark, sf), rows, tier_metadata(rows), equivalents(spark), "page", "row", MARGIN, enabled)


@query("r08_contextual_decision", with_ctes("SELECT page, raw_outcome, outcome, array_to_string(reasons, ';') AS reason_codes, corrections, uncertain, syntax_resolved FROM context", *_CONTEXT))
def r08(spark, sf):
    return contextual(spark, sf).select("page", "raw_outcome", "outcome", F.array_join("reason_codes", ";").alias("reason_codes"), "corrections", "uncertain", "syntax_resolved")


_JUDGED_SQL = """
judged_edit AS (SELECT e.page, e.row, e.role, e.index, e.ch, e.target AS replacement, e.raw, CASE e.role WHEN 'upper' THEN nullif(ltrim(n.upper), '') WHEN 'count' THEN n.count ELSE nullif(ltrim(n.lower), '') END AS truth
  FROM edit e LEFT JOIN notation n ON n.page = e.page AND n.row = e.row)"""


@query("r09_correction_assessment", with_ctes("""
SELECT e.page, e.row, e.role, e.index::INT AS index, e.ch AS original_character, e.replacement AS replacement_character, coalesce(v.assessment, 'uncertain_alignment') AS assessment, coalesce(v.possible, '') AS possible, coalesce(v.deletion_possible, true) AS deletion_possible
FROM judged_edit e LEFT JOIN verdict v ON v.raw = e.raw AND v.truth = e.truth AND v.index = e.index AND v.replacement = e.replacement""", *_BASE, _EVIDENCE_SQL, _REPAIRED_SQL, _JUDGED_SQL, B.verdict_sql("judged_edit", "verdict")))
def r09(spark, sf):
    """Are the edits of the interpretation right under every minimum-edit alignment with the truth?"""
    notation = notation_once(spark, sf)
    cut = lambda c: F.nullif(F.ltrim(F.col(c)), F.lit(""))
    truth = notation.select("page", "row", cut("upper").alias("upper"), "count", cut("lower").alias("lower"))
    return I.correction_verdicts(interpreted(spark, sf, B.decoded_from(notation)), truth, "page", "row")


# -- alignment search --------------------------------------------------------

_SEARCH_SQL = r"""
search_rows AS (SELECT page, row, coalesce(upper, '') AS u0, count AS c, coalesce(lower, '') AS l0 FROM decoded),
search_ok AS (SELECT *, CASE WHEN c IS NULL THEN 'COUNT_TIER_UNAVAILABLE' WHEN c = '' THEN 'EMPTY_COUNT_OCR_NOT_IMAGE_ABSENCE' WHEN regexp_matches(u0, '[\t\r\n]') OR regexp_matches(c, '[\t\r\n]') OR regexp_matches(l0, '[\t\r\n]') THEN 'NON_ASCII_OR_CONTROL_WHITESPACE'
   WHEN (u0 <> '' AND trim(u0) = '') OR (l0 <> '' AND trim(l0) = '') THEN 'OPTIONAL_TIER_WHITESPACE_ONLY_IS_NOT_KNOWN_EMPTY' WHEN trim(c) = '' THEN 'COUNT_WHITESPACE_ONLY' WHEN u0 LIKE ' %' OR c LIKE ' %' OR l0 LIKE ' %' THEN 'OBSERVED_LEADING_BLANKS_REQUIRE_UNPROVEN_COMMON_CROP_NORMALIZATION' END AS unsupported FROM search_rows),
search_size AS (SELECT *, coalesce(unsupported IS NULL AND length(u0) <= length(c) AND length(l0) <= length(c), false) AS fits FROM search_ok),
search_offsets AS (SELECT *, list_concat(
   CASE WHEN fits AND u0 <> '' THEN list_transform(range(0, CASE WHEN l0 <> '' THEN length(c) - length(l0) ELSE 0 END + 1), lambda o: {'ou': 0::BIGINT, 'ol': o}) ELSE [] END,
   CASE WHEN fits AND l0 <> '' THEN list_transform(range(CASE WHEN u0 <> '' THEN 1 ELSE 0 END, CASE WHEN u0 <> '' THEN length(c) - length(u0) ELSE 0 END + 1), lambda o: {'ou': o, 'ol': 0::BIGINT}) ELSE [] END) AS os FROM search_size),
search_each AS (SELECT page, row, u0, c, l0, unsupported, o.ou AS ou, o.ol AS ol, o IS NOT NULL AS tested, CASE WHEN u0 <> '' THEN repeat(' ', o.ou) || u0 ELSE '' END AS u, CASE WHEN l0 <> '' THEN repeat(' ', o.ol) || l0 ELSE '' END AS l
   FROM (SELECT *, unnest(CASE WHEN len(os) = 0 THEN [NULL] ELSE os END) AS o FROM search_offsets))"""
_FOUND_SQL = """
found AS (SELECT page, row, unsupported, tested, CASE WHEN u0 <> '' THEN ou END AS upper_offset, CASE WHEN l0 <> '' THEN ol END AS lower_offset, CASE WHEN tested THEN code END AS code,
   CASE WHEN tested THEN verdict END AS outcome, CASE WHEN tested THEN total END AS row_total, CASE WHEN tested AND verdict = 'ACCEPT' THEN reading END AS reading FROM sx)"""
_SEARCH = (B.NOTATION_SQL, B.DECODED_SQL, _SEARCH_SQL, _aligned_sql("search_each", "sx"), _FOUND_SQL)
_ANALYSIS_SQL = """
row_analysis AS (SELECT page, row, any_value(unsupported) AS unsupported, count(*) FILTER (WHERE tested) AS tested, count(*) FILTER (WHERE outcome = 'ACCEPT') AS passing, count(*) FILTER (WHERE outcome = 'REVIEW_UNCERTAIN') AS uncertain, count(DISTINCT row_total) AS totals FROM found GROUP BY page, row),
row_status AS (SELECT *, CASE WHEN unsupported IS NOT NULL THEN 'unsupported' WHEN passing > 1 THEN 'multiple_in_search' WHEN passing = 1 THEN 'one_in_search' ELSE 'none_in_search' END AS status,
   unsupported IS NULL AND uncertain = 0 AS complete FROM row_analysis),
page_rows AS (SELECT page, count(*) AS rows, bool_and(complete) AS exhaustive, bool_or(complete AND passing = 0) AS row_contradiction, bool_or(uncertain > 0) AS uncertain, bool_or(passing > 1) AS multiple_candidates, bool_or(status = 'unsupported') AS unsupported FROM row_status GROUP BY page)"""


def _totals_sql(out: str, ways: str, src: str = "found") -> str:
    return f"""
{out} AS (SELECT w.page, w.row_total, product(n) AS readings FROM (SELECT page, row_total, row, {ways} AS n FROM {src} WHERE outcome = 'ACCEPT' GROUP BY ALL) w JOIN page_rows p ON p.page = w.page GROUP BY w.page, w.row_total HAVING count(*) = any_value(p.rows))"""


def _combined_sql(out: str, totals: str) -> str:
    return f"""
{out} AS (SELECT p.*, coalesce(t.n, 0) AS common_totals, coalesce(t.readings, 0)::BIGINT AS readings, row_contradiction OR (exhaustive AND coalesce(t.n, 0) = 0) AS contradiction,
   CASE WHEN coalesce(t.n, 0) > 0 THEN 'consistent_candidate_found' WHEN row_contradiction OR exhaustive THEN 'text_contradiction_complete_model' ELSE 'unknown_incomplete_or_unsupported' END AS status,
   coalesce(t.readings, 0) = 1 AND exhaustive AS unique_page FROM page_rows p LEFT JOIN (SELECT page, count(*) AS n, sum(readings) AS readings FROM {totals} GROUP BY page) t ON t.page = p.page)"""


def notation_once(spark, sf) -> DataFrame:
    """Notation rows, written once: truth, decoded text and measurements derive from them."""
    return materialize(B.notation(spark, sf).drop("runs"), "notation")


def search(rows: DataFrame) -> DataFrame:
    """All candidate offsets with their verdicts, written once: the policies read them several times, but not the texts."""
    return materialize(X.candidates(rows, "page", "row").drop("upper", "count", "lower", "natural_candidates", "code"), "candidates")


@query("r10_alignment_search", with_ctes("SELECT page, row, unsupported, tested, passing, uncertain, totals, status, complete, complete AND passing = 0 AS contradiction, complete AND passing = 1 AS unique_reading FROM row_status", *_SEARCH, _ANALYSIS_SQL))
def r10(spark, sf):
    found = X.candidates(B.decoded(spark, sf), "page", "row")
    return X.analyse_rows(found, "page", "row").drop("exhaustive")


@query("r10_candidates", with_ctes("SELECT page, row, upper_offset, lower_offset, code, outcome, row_total, reading FROM found WHERE tested", *_SEARCH))
def r10b(spark, sf):
    c = X.candidates(B.decoded(spark, sf), "page", "row").where("tested")
    return c.select("page", "row", F.col("upper_offset").cast("long").alias("upper_offset"), F.col("lower_offset").cast("long").alias("lower_offset"), "code", "outcome", "row_total", "reading")


@query("r11_page_combination", with_ctes("SELECT page, rows, exhaustive, uncertain, multiple_candidates, unsupported, common_totals, readings, contradiction, status, unique_page FROM combined", *_SEARCH, _ANALYSIS_SQL, _totals_sql("totals", "count(*)"), _combined_sql("combined", "totals")))
def r11(spark, sf):
    return X.combine_pages(search(B.decoded_from(notation_once(spark, sf))), "page", "row").drop("row_contradiction", "readings_exact")


_REVIEW_SQL = """
reviewed AS (SELECT d.page, d.outcome AS outcome_before, d.outcome = 'ACCEPT' AND NOT coalesce(d.preprocessing_status = 'ok' AND d.segmentation_accepted AND d.ocr_status = 'ok' AND a.status = 'consistent_candidate_found' AND a.exhaustive AND a.readings >= 1 AND NOT a.uncertain, false) AS new_review,
   CASE WHEN a.contradiction THEN 'R3_COMPLETE_TEXT_CONTRADICTION' WHEN a.unsupported THEN 'R3_UNSUPPORTED_REPRESENTATION' WHEN a.uncertain THEN 'R3_CANONICAL_INTERPRETATION_UNCERTAIN' ELSE 'R3_INSUFFICIENT_ALIGNMENT_EVIDENCE' END AS finding, d.reasons
   FROM dec d LEFT JOIN combined a ON a.page = d.page)"""
_REVIEW = (*_SEARCH, B.IMAGES_SQL, _syntax_sql("decoded", "syn"), _evidence_sql("syn", "dec"), _ANALYSIS_SQL, _totals_sql("totals", "count(*)"), _combined_sql("combined", "totals"), _REVIEW_SQL)


def reviewed(spark, sf, rows: DataFrame, analysis: DataFrame) -> DataFrame:
    d = Y.evidence_decision(Y.validate_pages(pages(spark, sf), rows, "page", "row"))
    return X.review_policy(d, analysis, "page")


@query("r12_review_policy", with_ctes("""
SELECT page, outcome_before, CASE WHEN new_review THEN 'REVIEW_UNCERTAIN' ELSE outcome_before END AS outcome, new_review, array_to_string(CASE WHEN new_review THEN list_append(reasons, finding) ELSE reasons END, ';') AS reason_codes FROM reviewed""", *_REVIEW))
def r12(spark, sf):
    rows = B.decoded_from(notation_once(spark, sf))
    r = reviewed(spark, sf, rows, X.combine_pages(search(rows), "page", "row"))
    return r.select("page", "outcome_before", "outcome", "new_review", F.array_join("reason_codes", ";").alias("reason_codes"))


@query("r13_distinct_readings", with_ctes("""
SELECT page, sum(readings)::BIGINT AS readings, count(*) AS common_totals, CASE WHEN sum(readings) = 1 THEN max(row_total) END AS selected_total FROM dtotals GROUP BY page""", *_SEARCH, _ANALYSIS_SQL, _totals_sql("dtotals", "count(DISTINCT reading)")))
def r13(spark, sf):
    found = search(B.decoded_from(notation_once(spark, sf)))
    counts = X.analyse_rows(found, "page", "row").groupBy("page").agg(F.count(F.lit(1)).alias("rows"))
    return X.distinct_readings(found, counts, "page", "row").drop("readings_exact")


# measured offsets: the true leading blanks of a tier, disturbed by a rule on the row
_MEASURED_SQL = """
measured AS (SELECT page, row, tier, o + shift AS off, greatest(o + shift - width, 0) AS lo, o + shift + width AS hi FROM (
  SELECT page, row, tier, o::DOUBLE AS o, CASE WHEN tax = 2 THEN 1.0 WHEN tax = 4 THEN 0.25 ELSE 0 END::DOUBLE AS shift, CASE WHEN discount = 5 THEN 0.4 ELSE 0.125 END::DOUBLE AS width FROM (
    SELECT page, row, tax, discount, 'upper' AS tier, length(upper) - length(ltrim(upper)) AS o FROM notation WHERE trim(upper) <> '' AND discount <> 3
    UNION ALL SELECT page, row, tax, discount, 'lower', length(lower) - length(ltrim(lower)) FROM notation WHERE trim(lower) <> ''
    UNION ALL SELECT page, row, 0, discount, 'count', 0 FROM notation)))"""


def measured(n: DataFrame) -> DataFrame:
    lead = lambda c: F.length(c) - F.length(F.ltrim(c))
    tiers = F.array_compact(F.array(
        F.when((F.trim("upper") != "") & (F.col("discount") != 3), F.struct(F.lit("upper").alias("tier"), lead(F.col("upper")).alias("o"), F.col("tax").alias("t"))),
        F.when(F.trim("lower") != "", F.struct(F.lit("lower").alias("tier"), lead(F.col("lower")).alias("o"), F.col("tax").alias("t"))),
        F.struct(F.lit("count").alias("tier"), F.lit(0).alias("o"), F.lit(0).alias("t")),
    ))
    long = n.select("page", "row", "discount", F.explode(tiers).alias("m"))
    at = F.col("m.o") + F.when(F.col("m.t") == 2, 1.0).when(F.col("m.t") == 4, 0.25).otherwise(0.0)
    width = F.when(F.col("discount") == 5, 0.4).otherwise(0.125)
    return long.select("page", "row", "m.tier", at.alias("offset"), F.greatest(at - width, F.lit(0.0)).alias("low"), (at + width).alias("high"))


_MATCH_SQL = """
wide AS (SELECT page, row, max(off) FILTER (WHERE tier = 'upper') AS uo, max(lo) FILTER (WHERE tier = 'upper') AS ul, max(hi) FILTER (WHERE tier = 'upper') AS uh,
   max(off) FILTER (WHERE tier = 'lower') AS lo_, max(lo) FILTER (WHERE tier = 'lower') AS ll, max(hi) FILTER (WHERE tier = 'lower') AS lh,
   max(off) FILTER (WHERE tier = 'count') AS co, max(lo) FILTER (WHERE tier = 'count') AS cl, max(hi) FILTER (WHERE tier = 'count') AS ch FROM measured GROUP BY page, row),
checks AS (SELECT f.*, w.*EXCLUDE (page, row), [{'x': upper_offset, 'o': uo, 'l': ul, 'h': uh}, {'x': lower_offset, 'o': lo_, 'l': ll, 'h': lh}, {'x': 0, 'o': co, 'l': cl, 'h': ch}] AS cs FROM found f LEFT JOIN wide w ON w.page = f.page AND w.row = f.row WHERE outcome = 'ACCEPT'),
matched AS (SELECT *, len(list_filter(cs, lambda k: k.x IS NOT NULL AND NOT coalesce(abs(k.x - k.o) <= 0.5, false))) = 0 AS retained,
   len(list_filter(cs, lambda k: k.x IS NOT NULL AND k.o IS NULL)) = 0 AS measured,
   len(list_filter(cs, lambda k: k.x IS NOT NULL AND coalesce(NOT (k.x - 0.5 <= k.l AND k.h <= k.x + 0.5) AND NOT (k.h < k.x - 0.5 OR k.l > k.x + 0.5), false))) > 0
     AND len(list_filter(cs, lambda k: k.x IS NOT NULL AND coalesce(k.h < k.x - 0.5 OR k.l > k.x + 0.5, false))) = 0 AS boundary_uncertain FROM checks)"""


@query("j16_measured_offsets", with_ctes("SELECT page, row, upper_offset, lower_offset, reading, retained, boundary_uncertain, measured FROM matched", *_SEARCH, _MEASURED_SQL, _MATCH_SQL))
def j16(spark, sf):
    n = notation_once(spark, sf)
    m = X.match_offsets(search(B.decoded_from(n)), measured(n), "page", "row")
    return m.select("page", "row", F.col("upper_offset").cast("long").alias("upper_offset"), F.col("lower_offset").cast("long").alias("lower_offset"), "reading", "retained", "boundary_uncertain", "measured")


_MEASURED_POLICY_SQL = """
retained_found AS (SELECT * FROM matched WHERE retained),
doubt AS (SELECT m.page, bool_or(boundary_uncertain) AS d FROM matched m SEMI JOIN dtotals t ON t.page = m.page AND t.row_total = m.row_total GROUP BY m.page),
avail AS (SELECT page, bool_and(measured) AS ok FROM matched GROUP BY page),
n1 AS (SELECT page, sum(readings) AS n, CASE WHEN sum(readings) = 1 THEN max(row_total) END AS t FROM dtotals GROUP BY page),
n2 AS (SELECT page, sum(readings) AS n, CASE WHEN sum(readings) = 1 THEN max(row_total) END AS t FROM rtotals GROUP BY page),
final AS (SELECT r.page, r.out AS outcome_before, coalesce(p.exhaustive AND NOT p.uncertain, false) AS complete, coalesce(n1.n, 0) AS nb, coalesce(n2.n, 0) AS na, n1.t AS tb, n2.t AS ta, coalesce(avail.ok, false) AND NOT coalesce(doubt.d, false) AS pos, p.page IS NULL AS no_rows
  FROM (SELECT page, CASE WHEN new_review THEN 'REVIEW_UNCERTAIN' ELSE outcome_before END AS out FROM reviewed) r LEFT JOIN page_rows p ON p.page = r.page LEFT JOIN n1 ON n1.page = r.page LEFT JOIN n2 ON n2.page = r.page LEFT JOIN doubt ON doubt.page = r.page LEFT JOIN avail ON avail.page = r.page),
judged AS (SELECT *, CASE WHEN outcome_before = 'ACCEPT' THEN CASE WHEN NOT complete OR nb = 0 THEN 'R3_1_ALIGNMENT_UNAVAILABLE' WHEN pos AND na = 0 THEN 'R3_1_MEASURED_POSITION_MISMATCH' WHEN pos AND na > 1 THEN 'R3_1_AMBIGUOUS_AFTER_MEASUREMENT' WHEN NOT pos AND nb <> 1 THEN 'R3_1_POSITION_UNAVAILABLE' END END AS finding FROM final)"""


@query("r14_measured_policy", with_ctes("""
SELECT page, outcome_before, CASE WHEN finding IS NOT NULL THEN 'REVIEW_UNCERTAIN' ELSE outcome_before END AS outcome, finding, CASE WHEN outcome_before = 'ACCEPT' AND finding IS NULL THEN CASE WHEN pos THEN ta ELSE tb END END AS selected_total,
  outcome_before = 'ACCEPT' AND finding IS NULL AND pos AS position_verified FROM judged""", *_REVIEW, _totals_sql("dtotals", "count(DISTINCT reading)"), _MEASURED_SQL, _MATCH_SQL,
    _MEASURED_POLICY_SQL.replace("doubt AS (", _totals_sql("rtotals", "count(DISTINCT reading)", "retained_found").strip() + ",\ndoubt AS (")))
def r14(spark, sf):
    n = notation_once(spark, sf)
    rows = B.decoded_from(n)
    analysis = materialize(X.measured_pages(search(rows), measured(n), "page", "row"), "measured-pages")
    d = reviewed(spark, sf, rows, analysis).drop("outcome_before")
    out = X.measured_policy(d, analysis, "page")
    return out.select("page", "outcome_before", "outcome", "finding", "selected_total", "position_verified")


@query("r15_monotonicity", with_ctes("""
SELECT outcome_a, outcome_b, count(*) AS violations FROM (SELECT a.outcome AS outcome_a, b.outcome AS outcome_b FROM r0 a JOIN r1 b ON a.image_id = b.image_id)
WHERE NOT (outcome_a = outcome_b OR (outcome_a = 'ACCEPT' AND outcome_b = 'REVIEW_UNCERTAIN')) GROUP BY ALL""", B.IMAGES_SQL, B.outcomes_sql("r0", "R0"), B.outcomes_sql("r1", "R1")))
def r15(spark, sf):
    """Changes a review-only policy may not make, on a pair of candidates that is not review-only."""
    pairs = P.paired(B.outcomes(spark, sf, "R0"), B.outcomes(spark, sf, "R1"), "image_id", ["validity"], ["outcome"])
    return P.monotonicity_violations(pairs, "outcome_a", "outcome_b").groupBy("outcome_a", "outcome_b").agg(F.count(F.lit(1)).alias("violations"))


RULES = {"1-URGENT": "rule-urgent", "2-HIGH": "rule-high", "3-MEDIUM": "rule-medium", "5-LOW": "rule-low"}


@query("r17_mutation_records", """
WITH r AS (SELECT 'img_' || o_orderkey AS image_id, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'INVALID' WHEN o_totalprice > 495000 THEN 'MAYBE' ELSE 'VALID' END AS validity, CASE WHEN o_orderstatus = 'F' OR o_totalprice < 3000 THEN o_orderpriority ELSE 'none' END AS category,
   CASE WHEN o_totalprice < 250000 THEN 'ACCEPT' ELSE 'REJECT_INVALID' END AS expected, CASE WHEN o_totalprice BETWEEN 2000 AND 300000 THEN o_orderpriority END AS target,
   md5((CASE WHEN o_orderkey % 89 = 0 THEN o_orderkey - o_orderkey % 8 ELSE o_orderkey END)::VARCHAR) AS hash, o_custkey AS parent, o_orderkey % 4 >= 2 AS augmented, o_orderkey - o_orderkey % 4 AS control FROM orders),
j AS (SELECT r.*, c.k AS ck, c.hash AS ch, c.validity AS cv, c.parent AS cp, n.n AS copies FROM r LEFT JOIN r c ON c.k = r.control LEFT JOIN (SELECT hash, count(*) AS n FROM r GROUP BY hash) n ON n.hash = r.hash)
SELECT issue, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN validity = 'MAYBE' THEN 'unsupported_validity' END, CASE WHEN expected <> CASE WHEN validity = 'VALID' THEN 'ACCEPT' ELSE 'REJECT_INVALID' END THEN 'expected_outcome_disagrees' END,
  CASE WHEN validity = 'INVALID' AND category = '4-NOT SPECIFIED' THEN 'unsupported_category' END, CASE WHEN validity = 'INVALID' AND target IS NOT NULL THEN 'fabricated_target' END,
  CASE WHEN validity = 'VALID' AND target IS NULL THEN 'valid_without_target' END, CASE WHEN validity = 'VALID' AND category <> 'none' THEN 'valid_with_category' END,
  CASE WHEN k % 71 = 0 OR k % 73 = 0 THEN 'not_verified' END, CASE WHEN k % 79 = 0 THEN 'family_is_not_parent' END, CASE WHEN k % 83 = 0 THEN 'semantic_key_mismatch' END, CASE WHEN k % 97 = 0 THEN 'novelty_not_established' END,
  CASE WHEN NOT coalesce(cv = 'VALID' AND ck % 4 < 2 AND cp = parent, false) THEN 'control_missing_or_wrong' END, CASE WHEN ck IS NOT NULL AND ch <> md5((CASE WHEN k % 67 = 0 THEN k ELSE control END)::VARCHAR) THEN 'original_hash_mismatch' END,
  CASE WHEN copies > 1 THEN 'duplicate_image_bytes' END, CASE WHEN parent % 59 = 0 THEN 'historical_overlap' END], lambda x: x IS NOT NULL)) AS issue FROM j) GROUP BY issue""")
def r17(spark, sf):
    """Mutation contract over orders played as mutated and valid records; every fourth order is the control of the next ones."""
    c, k = F.col, F.col("o_orderkey")
    text = lambda x: x.cast("string")
    control = k - k % 4
    r = B.table(spark, sf, "orders").select(
        F.concat(F.lit("img_"), text(k)).alias("image_id"),
        F.when(c("o_orderstatus") == "F", "INVALID").when(c("o_totalprice") > 495000, "MAYBE").otherwise("VALID").alias("validity"),
        F.when((c("o_orderstatus") == "F") | (c("o_totalprice") < 3000), c("o_orderpriority")).otherwise("none").alias("category"),
        F.concat(F.lit("rule-"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))).alias("rule"),
        F.when(c("o_totalprice") < 250000, "ACCEPT").otherwise("REJECT_INVALID").alias("expected_outcome"),
        F.when(c("o_totalprice").between(2000, 300000), c("o_orderpriority")).alias("target"),
        F.md5(text(F.when(k % 89 == 0, k - k % 8).otherwise(k))).alias("image_sha256"), F.md5(text(F.when(k % 67 == 0, k).otherwise(control))).alias("original_image_hash"),
        c("o_custkey").alias("parent_id"), F.when(k % 79 == 0, -1).otherwise(c("o_custkey")).alias("mutation_family_id"), F.concat(F.lit("img_"), text(control)).alias("matched_control_id"),
        (k % 4 >= 2).alias("augmented"), F.when(k % 71 == 0, "QUARANTINED").otherwise("AUTO_VERIFIED").alias("verification_status"), F.when(k % 73 == 0, None).otherwise("AUTO_VERIFIED").alias("evidence_status"),
        text(c("o_custkey")).alias("semantic_key"), F.when(k % 83 == 0, "other").otherwise(text(c("o_custkey"))).alias("parent_semantic_key"), (k % 97 != 0).alias("novelty_verified"),
    )
    history = B.table(spark, sf, "customer").where("c_custkey % 59 = 0").select(text(c("c_custkey")).alias("semantic_key"))
    return A.contract_issues(r, RULES, history).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("r18_offline_cohorts", with_ctes("""
SELECT cohort, count(*) AS images, count(DISTINCT parent_id) AS parents FROM (SELECT parent_id, unnest(list_filter([
  CASE WHEN translate(trim(prediction), 'X', 'B') = translate(trim(truth), 'X', 'B') THEN 'pattern_faithful' END, CASE WHEN translate(replace(prediction, ' ', ''), 'X', 'B') = translate(replace(truth, ' ', ''), 'X', 'B') THEN 'glyph_faithful' END,
  CASE WHEN acc THEN 'invalid_accept' END, CASE WHEN acc AND translate(trim(prediction), 'X', 'B') = translate(trim(truth), 'X', 'B') THEN 'faithful_invalid_accept' END,
  CASE WHEN strpos(truth, ' ') > 0 AND prediction <> truth AND prediction = replace(truth, ' ', '') THEN 'lost_gap' END, CASE WHEN acc AND wrong_tier THEN 'wrong_tier_invalid_accept' END], lambda x: x IS NOT NULL)) AS cohort
FROM (SELECT *, validity = 'INVALID' AND outcome = 'ACCEPT' AS acc FROM r1)) GROUP BY cohort""", B.IMAGES_SQL, B.outcomes_sql("r1", "R1")))
def r18(spark, sf):
    from tierlens.operators.metrics import flag_table

    names = ["pattern_faithful", "glyph_faithful", "invalid_accept", "faithful_invalid_accept", "lost_gap", "wrong_tier_invalid_accept"]
    marked = Y.offline_cohorts(B.outcomes(spark, sf))
    return flag_table(marked, {n: F.col(n) for n in names}, "parent_id").withColumnRenamed("flag", "cohort")
