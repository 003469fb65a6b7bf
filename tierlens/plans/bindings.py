"""How the test tables play the roles of the data model, in Spark and in SQL.

documents   every line of a text is a tier; three lines make a row, the
            document is the parent page
lineitem    a line with its part is a reading (truth, prediction); the lines of
            an order are runs of notation rows
orders      an order is an image with a validity, a parent (its customer) and
            policy outcomes; also a page under three candidates
events      ordered class paths per user, and the journal stream
embeddings  feature vectors and per-frame scores
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierlens.functions import hashing as H, labels as L, notation as N
from tierlens.operators.metrics import edit_verdict_counts

SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- tiers from documents ----------------------------------------------------

def raw_tiers(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split(L.normalize_newlines(F.col("text")), "\n")).alias("line", "x"))
    indent = F.repeat(F.lit(" "), ((F.col("doc_id") + F.col("line")) % 4).cast("int"))
    lines = lines.withColumn("raw_label", F.concat(indent, F.col("x")))
    first = F.substr(H.tagged_hash("split:42:", F.col("doc_id")), F.lit(1), F.lit(1))
    split = F.when(first < "3", "test").when(first < "6", "validation").otherwise("train")
    parent = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    row_index = F.floor(F.col("line") / 3).cast("int")
    return lines.select(
        "doc_id", "lang", "source", "line", "raw_label", split.alias("split"),
        F.concat_ws("_", F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("tier_id"),
        parent.alias("parent_image_id"), row_index.alias("row_index"), (F.col("line") % 3).alias("tier_index"),
        F.concat_ws("_", parent, F.concat(F.lit("r"), row_index.cast("string"))).alias("row_id"),
        F.element_at(F.array(*[F.lit(r) for r in N.ROLES]), F.col("line") % 3 + 1).alias("tier_name"),
        F.greatest(F.lit(1).cast("long"), (3 + (F.col("doc_id") + F.col("line")) % 5) * F.length("raw_label")).cast("int").alias("image_width"),
        (40 + (F.col("doc_id") * 7 + F.col("line") * 3) % 60).cast("int").alias("image_height"),
    )


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The 23-column tier manifest plus the document columns."""
    return tiers_from(raw_tiers(spark, sf))


def tiers_from(raw: DataFrame) -> DataFrame:
    """The manifest of raw tiers."""
    path = lambda folder, end: F.concat(F.col("split"), F.lit(f"/{folder}/"), F.col("tier_id"), F.lit(end))
    label = L.clean_label(F.col("raw_label"))
    width = L.resized_width(F.col("image_width"), F.col("image_height"))
    full = raw.withColumns(
        {
            "image_path": path("images", ".png"), "label_path": path("labels", ".txt"), "training_label": label,
            "resized_width": width, "label_length": F.length(label), "raw_label_length": F.length("raw_label"),
            "leading_offset": F.length("raw_label") - F.length(label), "ctc_required_timesteps": L.ctc_required(label),
            "crnn_output_length": L.ctc_steps(width), "unknown_characters": L.unknown_characters(label, N.VOCABULARY),
            "image_status": F.lit("ok"), "label_status": F.when(label == "", "empty").otherwise("ok"),
        }
    )
    return full.withColumn("ctc_feasible", F.col("crnn_output_length") >= F.col("ctc_required_timesteps"))


TIERS_SQL = r"""
raw_lines AS (
  SELECT doc_id, lang, source,
         unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS x,
         generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line,
         substr(sha256('split:42:' || doc_id), 1, 1) AS h
  FROM documents),
indented AS (SELECT *, repeat(' ', (doc_id + line) % 4) || x AS raw_label FROM raw_lines),
tier_base AS (
  SELECT doc_id, lang, source, line, raw_label,
         CASE WHEN h < '3' THEN 'test' WHEN h < '6' THEN 'validation' ELSE 'train' END AS split,
         lpad(doc_id::VARCHAR, 10, '0') || '_' || lpad(line::VARCHAR, 6, '0') AS tier_id,
         'd' || doc_id AS parent_image_id, (line // 3)::INT AS row_index, (line % 3)::INT AS tier_index,
         'd' || doc_id || '_r' || (line // 3) AS row_id,
         ['upper', 'count', 'lower'][line % 3 + 1] AS tier_name,
         greatest(1, (3 + (doc_id + line) % 5) * length(raw_label))::INT AS image_width,
         (40 + (doc_id * 7 + line * 3) % 60)::INT AS image_height,
         regexp_replace(raw_label, '^ +', '') AS training_label
  FROM indented),
tier_sizes AS (
  SELECT *, split || '/images/' || tier_id || '.png' AS image_path, split || '/labels/' || tier_id || '.txt' AS label_path,
         greatest(1, round_even(image_width::DOUBLE * (64::DOUBLE / image_height::DOUBLE), 0))::INT AS resized_width,
         length(training_label)::INT AS label_length, length(raw_label)::INT AS raw_label_length,
         (length(raw_label) - length(training_label))::INT AS leading_offset,
         string_split(training_label, '') AS cs
  FROM tier_base),
tiers AS (
  SELECT * EXCLUDE (cs),
         (label_length + len(list_filter(range(2, label_length + 1), lambda i: cs[i] = cs[i - 1])))::INT AS ctc_required_timesteps,
         greatest(1, resized_width // 2 // 2)::INT AS crnn_output_length,
         greatest(1, resized_width // 2 // 2) >= label_length + len(list_filter(range(2, label_length + 1), lambda i: cs[i] = cs[i - 1])) AS ctc_feasible,
         array_to_string(list_sort(list_distinct(list_filter(cs, lambda c: c <> '' AND strpos(' ''()*+,ABCDEFGHIJKLMNPQRSTUVWXYZ[\]^_abcdefghijklmnopqrstuvwxyz{|', c) = 0))), '') AS unknown_characters,
         'ok' AS image_status, CASE WHEN training_label = '' THEN 'empty' ELSE 'ok' END AS label_status
  FROM tier_sizes)"""

TIER_BASE_SQL = TIERS_SQL[: TIERS_SQL.index("tier_sizes AS")].rstrip().rstrip(",")


# -- readings from lineitem --------------------------------------------------

def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Truth is the part name; the prediction misreads it by a rule on the quantity."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_suppkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    name, rule = F.col("p_name"), F.col("l_quantity").cast("int") % 8
    misread = (
        F.when(rule == 3, F.replace(name, F.lit("e"), F.lit("c")))
        .when(rule == 4, F.replace(name, F.lit(" "), F.lit("")))
        .when(rule == 5, F.concat(F.substr(name, F.lit(2)), F.substr(name, F.lit(1), F.lit(1))))
        .when(rule == 6, F.concat(name, F.lit(" "), F.lower("p_type")))
        .when(rule == 7, F.reverse(name))
        .otherwise(name)
    )
    role = F.element_at(F.array(*[F.lit(r) for r in N.ROLES]), F.col("l_linenumber") % 3 + 1)
    return lines.join(part, "l_partkey").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), role.alias("role"), F.col("l_suppkey").alias("parent"),
        F.col("l_returnflag").alias("candidate"), F.col("l_linestatus").alias("cohort"), name.alias("truth"), misread.alias("prediction"),
    )


READINGS_SQL = """
readings AS (
  SELECT l_orderkey AS page, l_linenumber AS row, ['upper', 'count', 'lower'][l_linenumber % 3 + 1] AS role, l_suppkey AS parent,
         l_returnflag AS candidate, l_linestatus AS cohort, p_name AS truth,
         CASE l_quantity::INT % 8 WHEN 3 THEN replace(p_name, 'e', 'c') WHEN 4 THEN replace(p_name, ' ', '')
              WHEN 5 THEN substr(p_name, 2) || substr(p_name, 1, 1) WHEN 6 THEN p_name || ' ' || lower(p_type)
              WHEN 7 THEN reverse(p_name) ELSE p_name END AS prediction
  FROM lineitem JOIN part ON p_partkey = l_partkey),
scored AS (
  SELECT *, levenshtein(truth, prediction) AS edits, length(truth) AS characters, truth = prediction AS exact FROM readings)"""

# The alignment of every distinct pair by anti-diagonals: each cell carries its
# cost and the log of its edits; ties go match, substitution, deletion, insertion.
ALIGN_SQL = """
pair_ids AS (SELECT DISTINCT truth, prediction FROM pairs WHERE truth <> prediction),
dp(truth, prediction, n, m, d, cur, prev) AS (
  SELECT truth, prediction, length(truth)::INT, length(prediction)::INT, 0,
         list_transform(range(0, length(truth) + 1), lambda i: CASE WHEN i = 0 THEN {'c': 0, 'log': ''} END),
         list_transform(range(0, length(truth) + 1), lambda i: CASE WHEN i < 0 THEN {'c': 0, 'log': ''} END)
  FROM pair_ids
  UNION ALL
  SELECT truth, prediction, n, m, d + 1,
         list_transform(range(0, n + 1), lambda i:
           CASE WHEN d + 1 - i < 0 OR d + 1 - i > m THEN NULL
                WHEN i = 0 THEN {'c': (d + 1)::INT, 'log': cur[1].log || 'I~~' || prediction[d + 1] || '~' || 0 || '~' || d || ';'}
                WHEN d + 1 - i = 0 THEN {'c': i::INT, 'log': cur[i].log || 'D~' || truth[i] || '~~' || (i - 1) || '~' || 0 || ';'}
                WHEN truth[i] = prediction[d + 1 - i] THEN prev[i]
                WHEN prev[i].c <= cur[i].c AND prev[i].c <= cur[i + 1].c
                  THEN {'c': (prev[i].c + 1)::INT, 'log': prev[i].log || 'S~' || truth[i] || '~' || prediction[d + 1 - i] || '~' || (i - 1) || '~' || (d - i) || ';'}
                WHEN cur[i].c <= cur[i + 1].c
                  THEN {'c': (cur[i].c + 1)::INT, 'log': cur[i].log || 'D~' || truth[i] || '~~' || (i - 1) || '~' || (d + 1 - i) || ';'}
                ELSE {'c': (cur[i + 1].c + 1)::INT, 'log': cur[i + 1].log || 'I~~' || prediction[d + 1 - i] || '~' || i || '~' || (d - i) || ';'} END),
         cur
  FROM dp WHERE d < n + m),
aligned AS (SELECT truth, prediction, cur[n + 1].c AS edits, cur[n + 1].log AS log FROM dp WHERE d = n + m)"""


# -- images and outcomes from orders -----------------------------------------

def images(spark: SparkSession, sf: str) -> DataFrame:
    """One image per order with status columns, truth and two transcriptions; no outcome yet."""
    o = table(spark, sf, "orders")
    price, truth = F.col("o_totalprice"), F.col("o_orderpriority")
    cents = F.floor(price).cast("long")
    invalid = F.col("o_orderstatus") == "F"
    raw = (
        F.when(cents % 5 == 0, F.replace(truth, F.lit("-"), F.lit("")))
        .when(cents % 5 == 1, F.translate(truth, "IO", "10")).otherwise(truth)
    )
    fixed = F.when((cents % 5 == 1) & (cents % 2 == 0), truth).when(cents % 35 == 2, F.reverse(truth)).otherwise(raw)
    return o.select(
        F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("parent_id"),
        F.when(invalid, "INVALID").otherwise("VALID").alias("validity"),
        F.when(invalid, truth).otherwise("none").alias("category"), truth.alias("paired_category"),
        F.when(F.dayofmonth("o_orderdate") <= 15, "clean").otherwise("illuminated").alias("variant"),
        F.when(F.year("o_orderdate") % 2 == 0, "tuning").otherwise("validation").alias("partition"),
        price.alias("price"), truth.alias("truth"), raw.alias("raw_prediction"), fixed.alias("prediction"),
        F.when(price < 4000, "no_ink").when(price < 8000, "unreadable").when(price < 12000, "skewed").otherwise("ok").alias("preprocessing_status"),
        (price >= 20000).alias("segmentation_accepted"),
        F.when(price > 490000, "failed").when(price >= 20000, "ok").alias("ocr_status"),
        F.when(cents % 3 == 0, 1).otherwise(2).alias("legal_alternatives"),
        F.when(cents % 7 > 0, price / 500000).alias("role_margin"),
        F.when(price < 30000, "thin").otherwise("").alias("rejection"),
        F.when(cents % 11 > 0, price / 500000).alias("nonblank_geomean"),
    )


IMAGES_SQL = """
images AS (
  SELECT o_orderkey AS image_id, o_custkey AS parent_id, CASE WHEN o_orderstatus = 'F' THEN 'INVALID' ELSE 'VALID' END AS validity,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'none' END AS category, o_orderpriority AS paired_category,
         CASE WHEN day(o_orderdate) <= 15 THEN 'clean' ELSE 'illuminated' END AS variant,
         CASE WHEN year(o_orderdate) % 2 = 0 THEN 'tuning' ELSE 'validation' END AS partition,
         o_totalprice AS price, o_orderpriority AS truth,
         CASE WHEN cents % 5 = 0 THEN replace(o_orderpriority, '-', '') WHEN cents % 5 = 1 THEN translate(o_orderpriority, 'IO', '10')
              ELSE o_orderpriority END AS raw_prediction,
         CASE WHEN cents % 5 = 1 AND cents % 2 = 0 THEN o_orderpriority WHEN cents % 35 = 2 THEN reverse(o_orderpriority)
              WHEN cents % 5 = 0 THEN replace(o_orderpriority, '-', '') WHEN cents % 5 = 1 THEN translate(o_orderpriority, 'IO', '10')
              ELSE o_orderpriority END AS prediction,
         CASE WHEN o_totalprice < 4000 THEN 'no_ink' WHEN o_totalprice < 8000 THEN 'unreadable' WHEN o_totalprice < 12000 THEN 'skewed' ELSE 'ok' END AS preprocessing_status,
         o_totalprice >= 20000 AS segmentation_accepted,
         CASE WHEN o_totalprice > 490000 THEN 'failed' WHEN o_totalprice >= 20000 THEN 'ok' END AS ocr_status,
         CASE WHEN cents % 3 = 0 THEN 1 ELSE 2 END AS legal_alternatives,
         CASE WHEN cents % 7 > 0 THEN o_totalprice / 500000 END AS role_margin,
         CASE WHEN o_totalprice < 30000 THEN 'thin' ELSE '' END AS rejection,
         CASE WHEN cents % 11 > 0 THEN o_totalprice / 500000 END AS nonblank_geomean
  FROM (SELECT *, floor(o_totalprice)::BIGINT AS cents FROM orders))"""

POLICIES = {"R0": (40000, 420000), "R1": (50000, 440000)}


def outcomes(spark: SparkSession, sf: str, candidate: str = "R1") -> DataFrame:
    """Evaluated records of one candidate policy."""
    review, reject = POLICIES[candidate]
    invalid = F.col("validity") == "INVALID"
    prediction = F.col("raw_prediction") if candidate == "R0" else F.col("prediction")
    wrong_tier = F.col("raw_prediction").rlike("[01]") & ~F.col("truth").rlike("[01]")
    img = images(spark, sf)
    outcome = (
        F.when(F.col("price") < review, "REVIEW_UNCERTAIN").when(invalid & (F.col("price") > reject), "REJECT_INVALID").otherwise("ACCEPT")
    )
    reasons = L.named_issues(
        [("DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH", wrong_tier), ("LOW_CONFIDENCE", F.col("price") < review), ("D1_NO_SAFE_PROPOSAL", ~F.col("segmentation_accepted"))]
    )
    return img.select(
        *[c for c in img.columns if c != "prediction"], prediction.alias("prediction"), F.lit(candidate).alias("candidate"),
        outcome.alias("outcome"), F.when(invalid, "REJECT_INVALID").otherwise("ACCEPT").alias("expected_outcome"),
        F.when(~invalid, F.levenshtein("truth", "raw_prediction")).alias("raw_edits"), F.when(~invalid, F.levenshtein("truth", prediction)).alias("edits"),
        F.length("truth").alias("characters"), (F.col("truth") == F.col("raw_prediction")).alias("raw_exact"),
        (F.col("truth") == prediction).alias("exact"), reasons.alias("reason_codes"),
        F.when(prediction != F.col("raw_prediction"), 1).otherwise(0).alias("corrections"),
        (F.col("legal_alternatives") == 2).alias("uncertain"),
        ((F.col("preprocessing_status") == "ok") & ~F.col("segmentation_accepted")).alias("segmentation_failure"),
        F.col("preprocessing_status").isin("no_ink", "unreadable").alias("preprocessing_failure"),
        (F.col("segmentation_accepted") & (F.col("ocr_status") != "ok")).alias("ocr_failure"),
        F.when(F.col("price") > 498000, "timeout").alias("pipeline_exception"),
        L.length_group(F.length("truth")).alias("length_group"), L.row_group(F.col("legal_alternatives")).alias("row_group"),
        F.when(prediction.rlike("[01]"), "REJECT_INVALID").otherwise("ACCEPT").alias("interpreted_syntax"),
        L.named_issues([("DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH", F.col("raw_prediction").rlike("[01]"))]).alias("raw_reason_codes"),
    )


def outcomes_sql(name: str, candidate: str) -> str:
    """SQL of `outcomes` as a common table expression called `name` (needs images)."""
    review, reject = POLICIES[candidate]
    p = "raw_prediction" if candidate == "R0" else "prediction"
    return f"""
{name} AS (
  SELECT * EXCLUDE (prediction), {p} AS prediction, '{candidate}' AS candidate,
         CASE WHEN price < {review} THEN 'REVIEW_UNCERTAIN' WHEN validity = 'INVALID' AND price > {reject} THEN 'REJECT_INVALID' ELSE 'ACCEPT' END AS outcome,
         CASE WHEN validity = 'INVALID' THEN 'REJECT_INVALID' ELSE 'ACCEPT' END AS expected_outcome,
         CASE WHEN validity = 'VALID' THEN levenshtein(truth, raw_prediction) END AS raw_edits,
         CASE WHEN validity = 'VALID' THEN levenshtein(truth, {p}) END AS edits,
         length(truth) AS characters, truth = raw_prediction AS raw_exact, truth = {p} AS exact,
         regexp_matches(raw_prediction, '[01]') AND NOT regexp_matches(truth, '[01]') AS wrong_tier,
         price < {review} AS low, NOT segmentation_accepted AS unsafe,
         CASE WHEN {p} <> raw_prediction THEN 1 ELSE 0 END AS corrections, legal_alternatives = 2 AS uncertain,
         preprocessing_status = 'ok' AND NOT segmentation_accepted AS segmentation_failure,
         preprocessing_status IN ('no_ink', 'unreadable') AS preprocessing_failure,
         segmentation_accepted AND ocr_status <> 'ok' AS ocr_failure,
         CASE WHEN price > 498000 THEN 'timeout' END AS pipeline_exception,
         CASE WHEN length(truth) <= 4 THEN 'short_le4' WHEN length(truth) < 65 THEN 'medium_5_to64' ELSE 'long_ge65' END AS length_group,
         CASE WHEN legal_alternatives = 1 THEN 'single_row' ELSE 'multi_row' END AS row_group,
         NOT regexp_matches({p}, '[01]') AS syntax_passes, regexp_matches(raw_prediction, '[01]') AS raw_wrong_tier
  FROM images)"""


def judged_outcomes(spark: SparkSession, sf: str, candidate: str = "R1") -> DataFrame:
    """Outcomes with the number of correct, incorrect and unknown character edits of each record."""
    out = outcomes(spark, sf, candidate)
    same = (F.length("prediction") == F.length("raw_prediction")) & (F.col("prediction") != F.col("raw_prediction"))
    at = F.sequence(F.lit(0), F.length("prediction") - 1)
    edits = out.where(same).select("image_id", F.col("raw_prediction").alias("raw"), "truth", "prediction", F.explode(at).alias("index"))
    place = F.col("index") + 1
    edits = edits.withColumn("replacement", F.substr("prediction", place, F.lit(1))).where(F.col("replacement") != F.substr("raw", place, F.lit(1)))
    counts = edit_verdict_counts(edits.drop("prediction"), "image_id")
    return out.join(counts, "image_id", "left")


def verdict_sql(edits: str, out: str) -> str:
    """Verdict of each edit (raw, truth, index, replacement): truth characters that the place meets over all minimum-edit alignments."""
    return f"""
{out}_cut AS (SELECT DISTINCT raw, truth, index, replacement, raw[:index] AS head, raw[index + 2:] AS tail, raw[index + 1] AS ch, levenshtein(raw, truth) AS best FROM {edits} WHERE truth IS NOT NULL),
{out}_at AS (SELECT *, unnest(range(0, length(truth) + 1)) AS j FROM {out}_cut),
{out}_way AS (SELECT raw, truth, index, replacement, levenshtein(head, truth[:j]) + 1 + levenshtein(tail, truth[j + 1:]) = best AS gone,
   CASE WHEN j < length(truth) AND levenshtein(head, truth[:j]) + (ch <> truth[j + 1])::INT + levenshtein(tail, truth[j + 2:]) = best THEN truth[j + 1] END AS met FROM {out}_at),
{out} AS (SELECT raw, truth, index, replacement, bool_or(gone) AS deletion_possible, array_to_string(list_sort(list(DISTINCT met) FILTER (met IS NOT NULL)), '') AS possible,
   CASE WHEN count(DISTINCT met) = 1 AND NOT bool_or(gone) THEN CASE WHEN max(met) = any_value(replacement) THEN 'correct' ELSE 'incorrect' END ELSE 'uncertain_alignment' END AS assessment FROM {out}_way GROUP BY raw, truth, index, replacement)"""


def judged_sql(source: str, out: str) -> str:
    """SQL of `judged_outcomes` over outcomes called `source`."""
    return f"""
{out}_edit AS (SELECT image_id, raw_prediction AS raw, truth, i AS index, prediction[i + 1] AS replacement FROM (SELECT *, unnest(range(0, length(prediction))) AS i FROM {source} WHERE length(prediction) = length(raw_prediction) AND prediction <> raw_prediction)
  WHERE prediction[i + 1] <> raw_prediction[i + 1]),{verdict_sql(f"{out}_edit", f"{out}_verdict")},
{out} AS (SELECT s.*, v.* EXCLUDE (id) FROM {source} s LEFT JOIN (SELECT image_id AS id, count(*) FILTER (assessment = 'correct') AS correct_edits, count(*) FILTER (assessment = 'incorrect') AS incorrect_edits,
  count(*) FILTER (assessment NOT IN ('correct', 'incorrect')) AS unknown_edits FROM {out}_edit e JOIN {out}_verdict USING (raw, truth, index, replacement) GROUP BY image_id) v ON v.id = s.image_id)"""


CANDIDATES = ("C4", "C5", "D1")
_FLOORS = {"C4": 60000, "C5": 30000, "D1": 45000}


def candidate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every image under three segmentation candidates, expanded in place."""
    img = images(spark, sf).select("image_id", "parent_id", "validity", "paired_category", "variant", "partition", "price", "truth", "prediction", "raw_prediction")
    price, ok = F.col("price"), F.col("validity") == "VALID"
    kind = F.substr("paired_category", F.lit(1), F.lit(1))

    def one(name: str, extra: Column, text: Column) -> Column:
        proposal = price >= _FLOORS[name]
        return F.struct(F.lit(name).alias("candidate"), proposal.alias("proposal"), (proposal & extra).alias("correct"), text.alias("prediction"))

    options = F.array(
        one("C4", ok, F.col("raw_prediction")), one("C5", ok | (kind == "1"), F.col("prediction")),
        one("D1", ok | (kind != "5"), F.col("truth")),
    )
    kept = ["image_id", "parent_id", "validity", "paired_category", "variant", "partition", "price", "truth"]
    wide = img.select(*kept, F.explode(options).alias("o")).select(*kept, "o.*")
    reason = F.when(~F.col("proposal"), F.when(kind == "3", "row_count_mismatch").otherwise("no_safe_proposal")).when(~F.col("correct"), "wrong_segmentation").otherwise("ok")
    return wide.withColumn("reason", reason).withColumnRenamed("image_id", "case_id")


CANDIDATE_PAGES_SQL = """
candidate_pages AS (
  SELECT *, CASE WHEN NOT proposal AND substr(paired_category, 1, 1) = '3' THEN 'row_count_mismatch' WHEN NOT proposal THEN 'no_safe_proposal'
                 WHEN NOT correct THEN 'wrong_segmentation' ELSE 'ok' END AS reason
  FROM (
    SELECT image_id AS case_id, parent_id, validity, paired_category, variant, partition, price, truth, 'C4' AS candidate,
           price >= 60000 AS proposal, price >= 60000 AND validity = 'VALID' AS correct, raw_prediction AS prediction FROM images
    UNION ALL
    SELECT image_id, parent_id, validity, paired_category, variant, partition, price, truth, 'C5',
           price >= 30000, price >= 30000 AND (validity = 'VALID' OR substr(paired_category, 1, 1) = '1'), prediction FROM images
    UNION ALL
    SELECT image_id, parent_id, validity, paired_category, variant, partition, price, truth, 'D1',
           price >= 45000, price >= 45000 AND (validity = 'VALID' OR substr(paired_category, 1, 1) <> '5'), truth FROM images))"""


# -- notation rows from lineitem ---------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs (symbol, count) of the notation rows of an order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    return li.select(
        F.col("l_orderkey").alias("page"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("row"),
        "l_linenumber", "l_partkey", N.symbol_at(F.col("l_partkey") % 30).alias("symbol"),
        (F.col("l_quantity").cast("int") + F.when(F.col("l_suppkey") % 10 == 0, 200).otherwise(0)).alias("count"),
        F.rint(F.col("l_tax") * 100).cast("int").alias("tax"), F.rint(F.col("l_discount") * 100).cast("int").alias("discount"),
    )


def notation(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical rows with their runs and the defects their scan will show."""
    marks = [F.max(c).alias(c) for c in ("tax", "discount")]
    together = runs(spark, sf).repartition("page", "row")      # gathered where they are read; the columns are smaller than lists of runs
    return N.canonical_rows(together, ["page", "row"], ["l_linenumber", "l_partkey"], *marks)


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    return decoded_from(notation(spark, sf))


def decoded_from(rows: DataFrame) -> DataFrame:
    """Decoded tiers: leading blanks cut, empty tiers absent, some characters misread."""
    cut = lambda c: F.nullif(F.ltrim(c), F.lit(""))
    count = F.when(F.col("tax") == 8, F.concat(F.substr("count", F.lit(1), F.lit(1)), F.lit(" "), F.substr("count", F.lit(2)))).otherwise(F.col("count"))
    return rows.select(
        "page", "row", F.when(F.col("discount") >= 9, F.translate(cut(F.col("upper")), "B", "X")).otherwise(cut(F.col("upper"))).alias("upper"),
        F.when(F.col("tax") < 7, F.col("count")).when(F.col("discount") > 0, count).alias("count"),
        F.when(F.col("tax") == 6, F.translate(cut(F.col("lower")), "T", "O")).otherwise(cut(F.col("lower"))).alias("lower"),
    )


NOTATION_SQL = r"""
runs AS (
  SELECT l_orderkey AS page, ((l_linenumber - 1) // 3)::INT AS row, l_linenumber, l_partkey,
         substr('ABCDEFGHIJKLMNPQRSTUVWXYZ[\]^_', (l_partkey % 30)::INT + 1, 1) AS symbol,
         (l_quantity::INT + CASE WHEN l_suppkey % 10 = 0 THEN 200 ELSE 0 END)::INT AS count,
         round(l_tax * 100)::INT AS tax, round(l_discount * 100)::INT AS discount
  FROM lineitem),
coded AS (
  SELECT *, strpos('ABCDEFGHIJKLMNPQ', symbol) > 0 AS is_up,
         CASE WHEN count >= 10 THEN substr('jklmnopqrstuvwxyz{|''()*+,', count // 10, 1) ELSE '' END
         || CASE WHEN count % 10 > 0 THEN substr('abcdefghi', count % 10, 1) ELSE '' END AS code
  FROM runs),
notation AS (
  SELECT page, row, max(tax) AS tax, max(discount) AS discount,
         rtrim(string_agg(CASE WHEN is_up THEN rpad(symbol, length(code)::INT, ' ') ELSE repeat(' ', length(code)) END, '' ORDER BY l_linenumber, l_partkey, symbol, count)) AS upper,
         string_agg(code, '' ORDER BY l_linenumber, l_partkey, symbol, count) AS count,
         rtrim(string_agg(CASE WHEN is_up THEN repeat(' ', length(code)) ELSE rpad(symbol, length(code)::INT, ' ') END, '' ORDER BY l_linenumber, l_partkey, symbol, count)) AS lower,
         '[' || string_agg('[' || to_json(symbol) || ',' || count || ',"' || CASE WHEN is_up THEN 'UP' ELSE 'DOWN' END || '"]', ',' ORDER BY l_linenumber, l_partkey, symbol, count) || ']' AS row_json,
         string_agg(symbol || code, '' ORDER BY l_linenumber, l_partkey, symbol, count) AS run_text
  FROM coded GROUP BY page, row)"""

DECODED_SQL = """
decoded AS (
  SELECT page, row,
         CASE WHEN discount >= 9 THEN translate(nullif(ltrim(upper), ''), 'B', 'X') ELSE nullif(ltrim(upper), '') END AS upper,
         CASE WHEN tax < 7 THEN count WHEN discount = 0 THEN NULL WHEN tax = 8 THEN substr(count, 1, 1) || ' ' || substr(count, 2) ELSE count END AS count,
         CASE WHEN tax = 6 THEN translate(nullif(ltrim(lower), ''), 'T', 'O') ELSE nullif(ltrim(lower), '') END AS lower
  FROM notation)"""


# -- event paths -------------------------------------------------------------

def wall_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone is."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Events in order per user with microseconds since the epoch and the day as order bucket."""
    e = table(spark, sf, "events")
    micros = wall_micros(F.col("ts"))
    return e.select("user_id", "event_id", "event_type", "value", micros.alias("at_us"), F.floor(micros / 86_400_000_000).alias("day"))


PATHS_SQL = """
paths AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS at_us, epoch_us(ts) // 86400000000 AS day FROM events)"""
