"""Sources, scalar label functions, vocabulary, frame paths and notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tierlens.functions import ctc as C, hashing as H, labels as L, notation as N
from tierlens.functions.distance import edit_counts, edit_distance, edit_events
from tierlens.operators import audit as A
from tierlens.operators.metrics import page_errors, recognition_metrics, score_pairs
from tierlens.operators import profile as R, sequence as Q
from tierlens.operators.profile import character_counts
from tierlens.operators.sequence import run_length
from tierlens.plans import bindings as B
from tierlens.plans.registry import query, with_ctes
from tierlens.session import materialize, scratch
from tierlens.sources import journal as J, manifest as M, samples as S


_MANIFEST_COLS = ", ".join(M.MANIFEST_COLUMNS)


@query("s01_manifest_scan", with_ctes(f"SELECT {_MANIFEST_COLS} FROM tiers", B.TIERS_SQL))
def s01(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "manifest")
    M.write_subset(B.tiers(spark, sf).select(*M.MANIFEST_COLUMNS), path)
    return M.read_manifest(spark, path)


@query("s02_required_values", with_ctes("""
SELECT issue, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN label_length = 0 THEN 'empty_label' END,
                             CASE WHEN length(training_label) <> raw_label_length THEN 'length_mismatch' END], lambda x: x IS NOT NULL)) AS issue
  FROM tiers) GROUP BY issue""", B.TIERS_SQL))
def s02(spark, sf):
    """Scan checks on the clean label against the recorded raw length."""
    t = A.require_columns(B.tiers(spark, sf), M.MANIFEST_COLUMNS)
    checked = A.value_checks(t, "ctc_feasible", "training_label", "raw_label_length")
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("s03_annotations", with_ctes("""
SELECT page AS sample_id, row AS row_index, (row_number() OVER (PARTITION BY page, row ORDER BY l_linenumber, l_partkey, symbol, count) - 1)::INT AS run_index,
       symbol, count, CASE WHEN is_up THEN 'UP' ELSE 'DOWN' END AS direction, code AS encoded_count
FROM (SELECT page::VARCHAR AS page, dense_rank() OVER (PARTITION BY page ORDER BY row)::INT - 1 AS row, l_linenumber, l_partkey, symbol, count, is_up, code FROM coded)""", B.NOTATION_SQL))
def s03(spark, sf):
    """Nested page annotations written as JSON, scanned back and flattened to runs."""
    rows = B.notation(spark, sf)
    run = lambda r: F.struct(r["symbol"].alias("symbol"), r["count"].alias("count"), N.symbol_direction(r["symbol"]).alias("direction"), N.encode_count(r["count"]).alias("encoded_count"))
    row = F.struct(F.col("row").alias("row_index"), "upper", F.col("count").alias("count_line"), "lower", F.transform("runs", run).alias("runs"))
    pages = rows.groupBy(F.col("page").cast("string").alias("sample_id")).agg(F.sort_array(F.collect_list(row)).alias("logical_rows"))
    path = scratch(spark, "annotations")
    pages.withColumn("rows", F.size("logical_rows")).withColumn("cells_per_row", F.lit(0)).write.json(path)
    return S.annotation_runs(S.read_annotations(spark, path, multiline=False))


@query("s07_journal_integrity", """
SELECT issue, count(*) AS rows FROM (
  SELECT CASE WHEN j IS NULL THEN 'missing' WHEN o IS NULL THEN 'unexpected' END AS issue
  FROM (SELECT event_id AS j FROM events WHERE event_type <> 'error') FULL OUTER JOIN (SELECT event_id AS o FROM events WHERE value >= 1) ON j = o)
WHERE issue IS NOT NULL GROUP BY issue""")
def s07(spark, sf):
    """Journal of the non-error events checked against the expected ids."""
    e = B.table(spark, sf, "events")
    path = scratch(spark, "journal")
    J.seal_records(e.where("event_type <> 'error'"), "event_id", ["user_id", "event_type", "props"], "plan-1").write.json(path)
    read = J.read_journal(spark, path, "event_id", T.LongType())
    issues = J.journal_issues(read, e.where("value >= 1"), "event_id", "plan-1")
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("s08_subset_sink", with_ctes(
    "SELECT split, count(*) AS rows, 0::BIGINT AS differences, 0::BIGINT AS out_of_order FROM tiers GROUP BY split", B.TIERS_SQL))
def s08(spark, sf):
    """Ordered, quoted CSV written and read back; every record must return, in file order."""
    # the raw tiers are written, which hold each text once; paths and clean labels derive from them where they are read
    t = B.tiers_from(materialize(B.raw_tiers(spark, sf).drop("doc_id", "lang", "source", "line"), "tiers")).select(*M.MANIFEST_COLUMNS)
    path = scratch(spark, "subset")
    M.write_subset(t, path)
    back = M.read_manifest(spark, path)
    lost = M.readback_differences(t, back, ["split"]).groupBy("split").agg(F.sum(F.abs("difference")).alias("_d"))
    wrong = M.file_order_violations(back, ["split", "tier_id"])
    counts = back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(lost, "split", "left").select(
        "split", "rows", F.coalesce("_d", F.lit(0)).alias("differences"), wrong.agg(F.count(F.lit(1))).scalar().alias("out_of_order")
    )


def label_folder(spark, sf, parts: int = 2) -> str:
    """The benchmark texts as label files, one each, in `<split>/labels`."""
    root = scratch(spark, "labels")
    items = B.table(spark, sf, "benchmark").where("text is not null")
    for part in range(parts):
        mine = items.where(F.col("item_id") % parts == part).select("text")
        mine.write.option("maxRecordsPerFile", 1).text(f"{root}/split{part}/labels")
    return root


@query("s04_discover_samples", "SELECT 'split' || (item_id % 2) AS split, count(*) AS samples, 0::BIGINT AS annotated FROM benchmark WHERE text IS NOT NULL GROUP BY 1")
def s04(spark, sf):
    """Samples found below the folder, by split."""
    found = S.discover_samples(spark, label_folder(spark, sf))
    return found.groupBy("split").agg(F.count("label_path").alias("samples"), F.count("json_path").alias("annotated"))


@query("s05_read_labels", r"SELECT regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+$', '') AS raw_label FROM benchmark WHERE text IS NOT NULL")
def s05(spark, sf):
    """Every label file's text, line ends unified."""
    return S.read_labels(spark, label_folder(spark, sf)).select("raw_label")


@query("s06_file_inventory", "SELECT count(*) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM benchmark WHERE text IS NOT NULL")
def s06(spark, sf):
    """Number and size of the label files; their contents are not read."""
    return S.file_inventory(spark, label_folder(spark, sf), "*.txt").agg(F.count("path").alias("files"), F.sum("length").alias("bytes"))


@query("s09_report_sink", """
SELECT l_orderkey, l_returnflag, '{"pages":' || count(*) || ',"last":' || max(l_linenumber) || '}' AS detail,
       to_json(list_sort(list(DISTINCT l_linestatus)))::VARCHAR AS statuses
FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def s09(spark, sf):
    """Report with nested columns written as CSV, nested values as JSON text."""
    li = B.table(spark, sf, "lineitem")
    report = li.groupBy("l_orderkey", "l_returnflag").agg(
        F.struct(F.count(F.lit(1)).alias("pages"), F.max("l_linenumber").alias("last")).alias("detail"),
        F.sort_array(F.collect_set("l_linestatus")).alias("statuses"),
    )
    path = scratch(spark, "report")
    M.write_report(report, path, "csv")
    return spark.read.schema("l_orderkey long, l_returnflag string, detail string, statuses string").options(**M.CSV_OPTIONS).csv(path)


@query("s10_head_subset", """
WITH head AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500)
SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM head) GROUP BY l_orderkey""")
def s10(spark, sf):
    """First orders and their companion lines (the limit is the operator)."""
    orders = B.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    parts = M.head_subset(orders, 500, ["o_orderdate", "l_orderkey"], "l_orderkey", {"lines": B.table(spark, sf, "lineitem")})
    return parts["lines"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("s11_fingerprint", """
WITH h AS (SELECT sha256('{"item_id":' || item_id || ',"text":' || to_json(text) || '}') AS h FROM benchmark)
SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS part0, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS part1,
       sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR AS part2, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR AS part3 FROM h""")
def s11(spark, sf):
    return M.table_fingerprint(B.table(spark, sf, "benchmark"))


# -- scalar functions --------------------------------------------------------

@query("p01_newlines", """
SELECT page_id, length(regexp_replace(html, '\\r\\n?', chr(10), 'g')) AS chars,
       len(string_split(regexp_replace(html, '\\r\\n?', chr(10), 'g'), chr(10))) AS lines FROM pages""")
def p01(spark, sf):
    text = L.normalize_newlines(F.col("html"))
    return B.table(spark, sf, "pages").select("page_id", F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"))


@query("p02_clean_label", with_ctes(
    "SELECT tier_id, training_label, length(raw_label) AS raw_length, length(training_label) AS clean_length, length(raw_label) - length(training_label) AS leading_offset FROM tier_base", B.TIER_BASE_SQL))
def p02(spark, sf):
    raw = F.col("raw_label")
    clean = L.clean_label(raw)
    return B.raw_tiers(spark, sf).select(
        "tier_id", clean.alias("training_label"), F.length(raw).alias("raw_length"), F.length(clean).alias("clean_length"), L.leading_offset(raw).alias("leading_offset")
    )


@query("p03_resized_width", with_ctes(
    "SELECT tier_id, greatest(1, round_even(image_width::DOUBLE * (64::DOUBLE / image_height::DOUBLE), 0))::INT AS resized_width FROM tier_base", B.TIER_BASE_SQL))
def p03(spark, sf):
    return B.raw_tiers(spark, sf).select("tier_id", L.resized_width(F.col("image_width"), F.col("image_height")).alias("resized_width"))


@query("p04_ctc_steps", with_ctes("""
SELECT tier_id, greatest(1, image_width // 4) AS floor4, greatest(1, ceil(image_width / 4.0)::INT) AS ceil4, greatest(1, image_width // 8 + 1) AS floor8_plus1,
       greatest(1, image_width // 2 - 2) AS floor2_minus2 FROM tier_base""", B.TIER_BASE_SQL))
def p04(spark, sf):
    w = F.col("image_width")
    return B.raw_tiers(spark, sf).select(
        "tier_id", L.ctc_steps(w).alias("floor4"), L.ctc_steps(w, 4, "ceil").alias("ceil4"), L.ctc_steps(w, 8, offset=1).alias("floor8_plus1"),
        L.ctc_steps(w, 2, offset=-2).alias("floor2_minus2"),
    )


@query("p05_ctc_required", with_ctes("SELECT tier_id, ctc_required_timesteps AS required FROM tiers", B.TIERS_SQL))
def p05(spark, sf):
    return B.raw_tiers(spark, sf).select("tier_id", L.ctc_required(L.clean_label(F.col("raw_label"))).alias("required"))


@query("p06_ctc_feasibility", with_ctes("""
SELECT split, stride, count(*) AS tiers, count(*) FILTER (WHERE greatest(1, resized_width // stride) >= ctc_required_timesteps) AS feasible,
       min(greatest(1, resized_width // stride) - ctc_required_timesteps) AS min_margin,
       round(100.0::DOUBLE * count(*) FILTER (WHERE greatest(1, resized_width // stride) < ctc_required_timesteps) / count(*), 6) AS failure_percent
FROM tiers, (SELECT unnest([2, 4, 8, 16]) AS stride) GROUP BY split, stride""", B.TIERS_SQL))
def p06(spark, sf):
    """Feasibility under several strides; the strides are expanded inside each row."""
    found = R.ctc_feasibility(B.tiers(spark, sf), "resized_width", "ctc_required_timesteps", (2, 4, 8, 16), ["split"])
    return found.withColumn("failure_percent", F.round("failure_percent", 6))


_VOCAB_SQL = "' ''()*+,ABCDEFGHIJKLMNPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz{|'"


@query("p07_ctc_problems", with_ctes(f"""
SELECT problem, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN label_length = 0 THEN 'empty_target' END,
    CASE WHEN unknown_characters <> '' THEN 'id_out_of_range' END,
    CASE WHEN label_length > 0 AND crnn_output_length < label_length + len(list_filter(range(2, label_length + 1), lambda i:
           (CASE WHEN strpos({_VOCAB_SQL}, training_label[i]) = 0 THEN -1 ELSE strpos({_VOCAB_SQL}, training_label[i]) END)
         = (CASE WHEN strpos({_VOCAB_SQL}, training_label[i - 1]) = 0 THEN -1 ELSE strpos({_VOCAB_SQL}, training_label[i - 1]) END))) THEN 'too_few_steps' END], lambda x: x IS NOT NULL)) AS problem
  FROM tiers) GROUP BY problem""", B.TIERS_SQL))
def p07(spark, sf):
    t = B.tiers(spark, sf).select("training_label", "crnn_output_length")
    problems = C.ctc_text_problems(F.col("training_label"), F.col("crnn_output_length"))
    return t.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query("p08_vocabulary", f"""
SELECT c_custkey, array_to_string(ids, ',') AS ids, unknown,
       array_to_string(list_transform(list_filter(ids, lambda i: i > 0), lambda i: substr({_VOCAB_SQL}, i, 1)), '') AS decoded
FROM (SELECT c_custkey, list_transform(string_split(c_name, ''), lambda c: CASE WHEN strpos({_VOCAB_SQL}, c) = 0 THEN -1 ELSE strpos({_VOCAB_SQL}, c) END) AS ids,
             array_to_string(list_sort(list_distinct(list_filter(string_split(c_name, ''), lambda c: strpos({_VOCAB_SQL}, c) = 0))), '') AS unknown
      FROM customer)""")
def p08(spark, sf):
    ids = C.encode(F.col("c_name"))
    return B.table(spark, sf, "customer").select(
        "c_custkey", F.array_join(ids, ",").alias("ids"), L.unknown_characters(F.col("c_name"), N.VOCABULARY).alias("unknown"), C.decode(ids).alias("decoded")
    )


@query("p09_pad_targets", f"""
WITH enc AS (SELECT o_orderkey, o_orderdate AS batch, list_transform(string_split(o_orderpriority, ''), lambda c: CASE WHEN strpos({_VOCAB_SQL}, c) = 0 THEN -1 ELSE strpos({_VOCAB_SQL}, c) END) AS ids FROM orders),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM enc)
SELECT o_orderkey, len(ids)::INT AS target_length, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: 0::BIGINT)), ',') AS padded FROM w""")
def p09(spark, sf):
    """Targets of a batch (orders of one day) padded to the longest of it."""
    enc = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("batch"), C.encode(F.col("o_orderpriority")).alias("ids"))
    out = Q.pad_targets(enc, "batch", "ids")
    return out.select("o_orderkey", "target_length", F.array_join("padded", ",").alias("padded"))


@query("p09_flat_targets", f"""
WITH enc AS (SELECT o_orderkey, o_orderkey // 64 AS batch, list_transform(string_split(o_orderpriority, ''), lambda c: CASE WHEN strpos({_VOCAB_SQL}, c) = 0 THEN -1 ELSE strpos({_VOCAB_SQL}, c) END) AS ids FROM orders)
SELECT batch, array_to_string(flatten(list(ids ORDER BY o_orderkey)), ',') AS targets, array_to_string(list(len(ids) ORDER BY o_orderkey), ',') AS target_lengths FROM enc GROUP BY batch""")
def p09b(spark, sf):
    """Targets of a batch (64 neighbouring orders) one behind the other, with their lengths."""
    enc = B.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 64).alias("batch"), C.encode(F.col("o_orderpriority")).alias("ids"))
    return Q.flat_targets(enc, "batch", "ids", ["o_orderkey"]).select("batch", F.array_join("targets", ",").alias("targets"), F.array_join("target_lengths", ",").alias("target_lengths"))


@query("p10_parse_rows", r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents),
l AS (SELECT doc_id, string_split(regexp_replace(x, '\n$', ''), chr(10)) AS l0 FROM t WHERE regexp_replace(x, '\s+', '', 'g') <> ''),
m AS (SELECT doc_id, CASE WHEN len(l0) % 4 = 3 THEN list_append(l0, '') ELSE l0 END AS l FROM l),
e AS (SELECT doc_id, l, CASE WHEN len(l) % 4 <> 0 THEN 'line_count'
        WHEN len(list_filter(range(4, len(l) + 1, 4), lambda i: regexp_replace(l[i], '\s+', '', 'g') <> '')) > 0 THEN 'separator_not_empty' END AS error FROM m)
SELECT doc_id, error, NULL::INT AS row_index, NULL::VARCHAR AS upper, NULL::VARCHAR AS count, NULL::VARCHAR AS lower FROM e WHERE error IS NOT NULL
UNION ALL
SELECT doc_id, error, r::INT, regexp_replace(l[r * 4 + 1], '[ \t]+$', ''), regexp_replace(l[r * 4 + 2], '[ \t]+$', ''), regexp_replace(l[r * 4 + 3], '[ \t]+$', '')
FROM (SELECT *, unnest(range(0, len(l) // 4)) AS r FROM e WHERE error IS NULL)""")
def p10(spark, sf):
    return S.parse_rows(B.table(spark, sf, "documents"), "doc_id", "text")


@query("p11_row_text", with_ctes("SELECT page, row, upper || chr(10) || count || chr(10) || lower AS tiers_text, run_text AS runs_text FROM notation", B.NOTATION_SQL))
def p11(spark, sf):
    coded = F.transform("runs", lambda r: F.struct(r["symbol"].alias("symbol"), N.encode_count(r["count"]).alias("encoded_count")))
    return B.notation(spark, sf).select(
        "page", "row", L.row_text(F.col("upper"), F.col("count"), F.col("lower")).alias("tiers_text"), L.runs_text(coded).alias("runs_text")
    )


@query("p12_unpivot_tiers", with_ctes("""
SELECT row_id || '_' || tier_name AS tier_id, row_id, page, tier_name, (list_position(['upper', 'count', 'lower'], tier_name) - 1)::INT AS tier_index, raw_label
FROM (UNPIVOT (SELECT 'o' || page || '_r' || row AS row_id, page, upper, count, lower FROM notation) ON upper, count, lower INTO NAME tier_name VALUE raw_label)
WHERE trim(raw_label) <> ''""", B.NOTATION_SQL))
def p12(spark, sf):
    rows = B.notation(spark, sf).withColumn("row_id", F.concat(F.lit("o"), F.col("page").cast("string"), F.lit("_r"), F.col("row").cast("string")))
    return S.unpivot_tiers(rows.select("row_id", "page", "upper", "count", "lower"), "row_id", ["page"])


@query("p13_safe_path", r"""
SELECT page_id, path, path LIKE 'train/images/%' AND length(path) > 13 AND NOT regexp_matches(path, '[\\:]|//|/$|^/|(^|/)\.{1,2}(/|$)') AS ok
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'train/images/' || page_id || '.html'
             WHEN page_id % 4 = 2 THEN 'train/images/../' || page_id ELSE 'train/images/' || regexp_replace(url, '^[a-z]+:', '') END AS path FROM pages)""")
def p13(spark, sf):
    k = F.col("page_id")
    base = F.lit("train/images/")
    path = (
        F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(base, k.cast("string"), F.lit(".html")))
        .when(k % 4 == 2, F.concat(base, F.lit("../"), k.cast("string"))).otherwise(F.concat(base, F.regexp_replace("url", "^[a-z]+:", "")))
    )
    pages = B.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", L.valid_path(F.col("path"), "train", "images").alias("ok"))


# -- frame paths -------------------------------------------------------------

_FRAMES_SQL = """
frames AS (SELECT vec_id, label, t, list_transform(range(0, 8), lambda k: embedding[t * 8 + k + 1]) AS s
           FROM (SELECT vec_id, label, embedding, unnest(range(0, 8)) AS t FROM embeddings)),
best AS (SELECT vec_id, label, t, list_position(s, list_max(s)) - 1 AS k,
                list_position(m, list_max(m)) - 1 AS km
         FROM (SELECT *, list_transform(range(0, 8), lambda k: CASE WHEN k = 0 OR k % 2 = label % 2 THEN s[k + 1] END) AS m FROM frames)),
path AS (SELECT vec_id, any_value(label) AS label, list(k ORDER BY t) AS p, list(km ORDER BY t) AS pm FROM best GROUP BY vec_id)"""


def _frames(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8))).alias("frames"))


def _collapse_sql(p: str) -> str:
    return f"array_to_string(list_transform(list_filter(range(1, 9), lambda i: {p}[i] <> 0 AND (i = 1 OR {p}[i] <> {p}[i - 1])), lambda i: {p}[i]), ',')"


@query("p14_ctc_collapse", with_ctes("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) - 1 AS character_index, event_type
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS before FROM paths)
WHERE event_type <> 'view' AND before IS DISTINCT FROM event_type""", B.PATHS_SQL))
def p14(spark, sf):
    """Collapsed class path of every user; no user is gathered in one place."""
    e = B.paths(spark, sf).select("user_id", "day", "at_us", "event_id", "event_type")
    runs = run_length(e, ["user_id"], "day", ["at_us", "event_id"], "event_type", "view")
    return runs.where("event_type <> 'view'").select("user_id", "character_index", "event_type")


@query("p15_greedy_decode", with_ctes(f"SELECT vec_id, {_collapse_sql('p')} AS decoded, {_collapse_sql('pm')} AS role_decoded FROM path", _FRAMES_SQL))
def p15(spark, sf):
    """Best class per frame, free and limited to the classes legal for the role; class 0 is blank."""
    legal = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: (k == 0) | (k % 2 == F.col("label") % 2))
    f = _frames(spark, sf)
    return f.select(
        "vec_id", F.array_join(C.greedy_decode(F.col("frames")), ",").alias("decoded"),
        F.array_join(C.greedy_decode(F.col("frames"), legal), ",").alias("role_decoded"),
    )


@query("p16_path_stats", with_ctes("""
SELECT vec_id, 8 AS frames, len(list_filter(p, lambda x: x = 0))::INT AS blank_frames, len(list_filter(p, lambda x: x = 0)) / 8::DOUBLE AS blank_fraction,
       len(list_filter(range(2, 9), lambda i: p[i] = p[i - 1] AND p[i] <> 0))::INT AS repeated_nonblank_frames,
       len(list_filter(range(1, 9), lambda i: p[i] <> 0 AND (i = 1 OR p[i] <> p[i - 1])))::INT AS nonblank_runs,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT g - row_number() OVER (PARTITION BY x ORDER BY g) AS b, x FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS g)) GROUP BY x, b)) AS longest_run,
       round(e.entropy, 6) AS entropy_mean
FROM path JOIN (
  SELECT vec_id, avg(h) AS entropy FROM (
    SELECT vec_id, t, list_sum(list_transform(q, lambda x: -(x / list_sum(q)) * ln(x / list_sum(q)))) AS h
    FROM (SELECT vec_id, t, list_transform(s, lambda x: exp((x - list_max(s))::DOUBLE)) AS q FROM frames)) GROUP BY vec_id) e USING (vec_id)""", _FRAMES_SQL))
def p16(spark, sf):
    f = _frames(spark, sf)
    entropy = F.aggregate(F.transform("frames", lambda s: C.frame_entropy(C.softmax(s))), F.lit(0.0), lambda a, h: a + h) / F.size("frames")
    return f.select("vec_id", C.path_stats(C.best_path(F.col("frames"))).alias("s"), F.round(entropy, 6).alias("entropy_mean")).select("vec_id", "s.*", "entropy_mean")


# -- notation ----------------------------------------------------------------

@query("p17_token_kind", r"""
SELECT CASE WHEN strpos('ABCDEFGHIJKLMNPQ', c) > 0 THEN 'up' WHEN strpos('RSTUVWXYZ[\]^_', c) > 0 THEN 'down' WHEN strpos('abcdefghijklmnopqrstuvwxyz{|''()*+,', c) > 0 THEN 'count'
            WHEN c = ' ' THEN 'space' WHEN c = chr(10) THEN 'newline' ELSE 'other' END AS kind, sum(n)::BIGINT AS characters, count(*) AS distinct_characters
FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c) GROUP BY kind""")
def p17(spark, sf):
    """Characters of all texts by class; characters are counted before they are classed."""
    chars = character_counts(B.table(spark, sf, "documents"), "text")
    return chars.groupBy(N.token_kind(F.col("character")).alias("kind")).agg(
        F.sum("occurrences").alias("characters"), F.count(F.lit(1)).alias("distinct_characters")
    )


def _bad_sql(text: str, alphabet: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({text}, ''), lambda c: c NOT IN ('', ' ') AND strpos({alphabet}, c) = 0))), '')"


_UP, _DOWN, _CNT = "'ABCDEFGHIJKLMNPQ'", r"'RSTUVWXYZ[\]^_'", "'abcdefghijklmnopqrstuvwxyz{|''()*+,'"


@query("p18_check_tiers", rf"""
WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM conversations),
t AS (SELECT conv_id, turn, len(l) AS n, l[1] AS u, coalesce(l[2], '') AS c, array_to_string(l[3:], '') AS d FROM l),
b AS (SELECT *, {_bad_sql('u', _UP)} AS bu, {_bad_sql('c', _CNT)} AS bc, {_bad_sql('d', _DOWN)} AS bd FROM t)
SELECT conv_id, turn, length(u) AS upper_length, length(d) AS lower_length,
       array_to_string(list_filter([CASE WHEN n <> 3 THEN 'line_count:' || n END, CASE WHEN bu <> '' THEN 'upper:' || bu END, CASE WHEN bc <> '' THEN 'count:' || bc END,
         CASE WHEN bd <> '' THEN 'lower:' || bd END, CASE WHEN regexp_replace(c, '\s+', '', 'g') = '' THEN 'count_empty' END], lambda x: x IS NOT NULL), ' ') AS issues
FROM b""")
def p18(spark, sf):
    checked = B.table(spark, sf, "conversations").select("conv_id", "turn", N.check_tiers(F.col("text")).alias("t"))
    return checked.select(
        "conv_id", "turn", F.length("t.upper").alias("upper_length"), F.length("t.lower").alias("lower_length"), F.array_join("t.issues", " ").alias("issues")
    )


@query("p19_parse_runs", with_ctes(r"""
SELECT page, row, array_to_string(list_transform(r, lambda x: substr(x, 1, 1) || '=' || substr(x, 2)), ' ') AS runs,
       len(list_filter(r, lambda x: length(x) NOT IN (2, 3)))::INT AS bad_runs, length(regexp_extract(known, '^[a-z{|''()*+,]*')) AS early_counts,
       length(txt) - length(known) AS foreign_chars
FROM (SELECT *, regexp_extract_all(known, '[A-NPQR-Z\[\\\]^_][a-z{|''()*+,]*') AS r
      FROM (SELECT page, row, txt, regexp_replace(txt, '[^A-NPQR-Z\[\\\]^_a-z{|''()*+,]', '', 'g') AS known
            FROM (SELECT page, row, CASE WHEN tax = 3 THEN substr(run_text, 2) WHEN tax = 5 THEN run_text || 'O.' WHEN tax = 7 THEN upper ELSE run_text END AS txt FROM notation)))""", B.NOTATION_SQL))
def p19(spark, sf):
    """Run texts, some cut or extended, parsed with their issues."""
    coded = F.transform("runs", lambda r: F.struct(r["symbol"].alias("symbol"), N.encode_count(r["count"]).alias("encoded_count")))
    text = L.runs_text(coded)
    text = F.when(F.col("tax") == 3, F.substr(text, F.lit(2))).when(F.col("tax") == 5, F.concat(text, F.lit("O."))).when(F.col("tax") == 7, F.col("upper")).otherwise(text)
    parsed = B.notation(spark, sf).select("page", "row", N.parse_runs(text).alias("p"))
    return parsed.select(
        "page", "row", F.array_join(F.transform("p.runs", lambda r: F.concat_ws("=", r["symbol"], r["encoded_count"])), " ").alias("runs"),
        "p.bad_runs", "p.early_counts", "p.foreign_chars",
    )


@query("p20_count_code", """
SELECT p_partkey, n, CASE WHEN n BETWEEN 1 AND 259 THEN (CASE WHEN n >= 10 THEN substr('jklmnopqrstuvwxyz{|''()*+,', n // 10, 1) ELSE '' END) || (CASE WHEN n % 10 > 0 THEN substr('abcdefghi', n % 10, 1) ELSE '' END) END AS code,
       CASE WHEN n BETWEEN 1 AND 259 THEN n END AS decoded,
       n IN (1,2,3,4,5,6,7,8,9,259) OR (n BETWEEN 9 AND 250 AND (n % 10 = 0 OR n % 10 = 9)) AS boundary
FROM (SELECT p_partkey, (p_partkey % 300)::INT AS n FROM part)""")
def p20(spark, sf):
    n = (F.col("p_partkey") % 300).cast("int")
    return B.table(spark, sf, "part").select(
        "p_partkey", n.alias("n"), N.encode_count(n).alias("code"), N.decode_count(N.encode_count(n)).alias("decoded"), n.isin(N.count_boundaries()).alias("boundary")
    )


@query("p21_symbol_direction", r"""
SELECT symbol, CASE WHEN strpos('ABCDEFGHIJKLMNPQ', symbol) > 0 THEN 'UP' WHEN strpos('RSTUVWXYZ[\]^_', symbol) > 0 THEN 'DOWN' END AS direction, symbol = 'O' AS ambiguous, count(*) AS rows
FROM (SELECT unnest(string_split(upper(p_name), '')) AS symbol FROM part UNION ALL SELECT unnest(string_split(upper(p_type), '')) FROM part) WHERE symbol <> '' GROUP BY symbol""")
def p21(spark, sf):
    """Direction of every character of two text columns, with its rows."""
    every = F.concat(*[F.split(F.upper(c), "") for c in ("p_name", "p_type")])
    s = B.table(spark, sf, "part").select(F.explode(every).alias("symbol")).where("symbol <> ''")
    counts = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("symbol", N.symbol_direction(F.col("symbol")).alias("direction"), (F.col("symbol") == N.AMBIGUOUS_SYMBOLS).alias("ambiguous"), "rows")


@query("p22_canonical_rows", with_ctes("SELECT page, row, upper, count, lower FROM notation", B.NOTATION_SQL))
def p22(spark, sf):
    return B.notation(spark, sf).select("page", "row", "upper", "count", "lower")


@query("p23_semantic_key", with_ctes("SELECT page, sha256('[' || string_agg(row_json, ',' ORDER BY row) || ']') AS semantic_key FROM notation GROUP BY page", B.NOTATION_SQL))
def p23(spark, sf):
    return N.semantic_key(B.notation(spark, sf), ["page"], "row")


@query("p24_hash_rank", """
SELECT doc_id, sha256('[42,' || substr(to_json([lang, 'tier', doc_id::VARCHAR])::VARCHAR, 2)) AS rank, sha256('42:' || doc_id) AS parent_rank FROM documents""")
def p24(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", H.hash_rank(42, F.col("lang"), "tier", F.col("doc_id")).alias("rank"), H.tagged_hash("42:", F.col("doc_id")).alias("parent_rank")
    )


@query("p25_ratio", """
SELECT l_orderkey, round(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 6) AS rate,
       coalesce(round(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 6), 0) AS rate_or_zero
FROM lineitem GROUP BY l_orderkey""")
def p25(spark, sf):
    g = B.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    return g.select("l_orderkey", F.round(L.ratio(F.col("a"), F.col("b")), 6).alias("rate"), F.round(L.ratio(F.col("a"), F.col("b"), "zero"), 6).alias("rate_or_zero"))


# -- edit distances ----------------------------------------------------------

_TURNS_SQL = r"""
turns AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '[^\x00-\x7F]', '?', 'g') AS truth, regexp_replace(b.text, '[^\x00-\x7F]', '?', 'g') AS prediction
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def turns(spark, sf):
    """Whole user turns with the answer that follows them; characters folded to ASCII."""
    c = B.table(spark, sf, "conversations")
    fold = lambda t: F.regexp_replace(t, r"[^\x00-\x7F]", "?")
    a = c.where("role = 'user'").select("conv_id", "turn", fold(F.col("text")).alias("truth"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), fold(F.col("text")).alias("prediction"))
    return a.join(b, ["conv_id", "turn"])


@query("p26_edit_distance", with_ctes("SELECT conv_id, turn, levenshtein(truth, prediction) AS edits, length(truth) AS characters FROM turns", _TURNS_SQL))
def p26(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", edit_distance(F.col("truth"), F.col("prediction")).alias("edits"), F.length("truth").alias("characters"))


_PAIRS_SQL = "pairs AS (SELECT truth, prediction FROM readings)"
_READINGS_ONLY = B.READINGS_SQL[: B.READINGS_SQL.index("scored AS")].rstrip().rstrip(",")


def _ops(k: str) -> str:
    return f"len(list_filter(string_split(log, ';'), lambda e: e[1] = '{k}'))::INT"


@query("p27_edit_counts", with_ctes(f"""
SELECT r.truth, r.prediction, count(*) AS readings, any_value(coalesce(s, 0)) AS substitutions, any_value(coalesce(d, 0)) AS deletions, any_value(coalesce(i, 0)) AS insertions
FROM readings r LEFT JOIN (SELECT truth, prediction, {_ops('S')} AS s, {_ops('D')} AS d, {_ops('I')} AS i FROM aligned) a ON a.truth = r.truth AND a.prediction = r.prediction
GROUP BY r.truth, r.prediction""", _READINGS_ONLY, _PAIRS_SQL, B.ALIGN_SQL, recursive=True))
def p27(spark, sf):
    """Substitutions, deletions and insertions of every distinct reading."""
    pairs = B.readings(spark, sf).groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("readings"))
    return pairs.withColumn("c", edit_counts(F.col("truth"), F.col("prediction"))).select("truth", "prediction", "readings", "c.*")


@query("p28_edit_events", with_ctes("""
SELECT truth, prediction, e[1] AS op, string_split(e, '~')[2] AS reference, string_split(e, '~')[3] AS predicted,
       string_split(e, '~')[4]::INT AS reference_pos, string_split(e, '~')[5]::INT AS predicted_pos
FROM (SELECT truth, prediction, unnest(list_filter(string_split(log, ';'), lambda x: x <> '')) AS e FROM aligned)""", _READINGS_ONLY, _PAIRS_SQL, B.ALIGN_SQL, recursive=True))
def p28(spark, sf):
    pairs = B.readings(spark, sf).select("truth", "prediction").distinct().where("truth <> prediction")
    return pairs.select("truth", "prediction", F.explode(edit_events(F.col("truth"), F.col("prediction"))).alias("e")).select("truth", "prediction", "e.*")


@query("p29_ignore_whitespace", with_ctes(r"""
SELECT conv_id, turn, levenshtein(regexp_replace(truth, '\s+', '', 'g'), regexp_replace(prediction, '\s+', '', 'g')) AS edits_no_ws FROM turns""", _TURNS_SQL))
def p29(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", edit_distance(F.col("truth"), F.col("prediction"), ignore_ws=True).alias("edits_no_ws"))


@query("p30_page_errors", with_ctes("""
, truth_tiers AS (UNPIVOT (SELECT page, row, nullif(ltrim(upper), '') AS upper, count, nullif(ltrim(lower), '') AS lower FROM notation) ON upper, count, lower INTO NAME role VALUE t),
pred_tiers AS (UNPIVOT decoded ON upper, count, lower INTO NAME role VALUE p)
SELECT page, sum(levenshtein(coalesce(t, ''), coalesce(p, '')))::BIGINT AS edits, sum(length(coalesce(t, '')))::BIGINT AS characters, bool_and(t IS NOT DISTINCT FROM p) AS exact
FROM truth_tiers FULL OUTER JOIN pred_tiers USING (page, row, role) GROUP BY page""".strip(), B.NOTATION_SQL, B.DECODED_SQL))
def p30(spark, sf):
    """Edits over the union of true and decoded tiers of each page."""
    truth = B.notation(spark, sf).select("page", "row", *[F.nullif(F.ltrim(F.col(r)), F.lit("")).alias(r) for r in N.ROLES])
    long = lambda d: d.unpivot(["page", "row"], list(N.ROLES), "role", "text").where("text is not null")
    return page_errors(long(truth), long(B.decoded(spark, sf)), "page", ["row", "role"], "text")


@query("p31_fidelity_key", r"""
SELECT p_partkey, translate(trim(x), 'X', 'B') AS pattern_key, translate(replace(x, ' ', ''), 'X', 'B') AS ink_key, trim(x) AS plain_key
FROM (SELECT p_partkey, ' ' || upper(p_name) || ' ' || p_type || ' X' || p_size || '  ' AS x FROM part)""")
def p31(spark, sf):
    text = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_type"), F.lit(" X"), F.col("p_size").cast("string"), F.lit("  "))
    return B.table(spark, sf, "part").select("p_partkey", text.alias("x")).select(
        "p_partkey", L.fidelity_key(F.col("x"), aliases=True).alias("pattern_key"), L.fidelity_key(F.col("x"), True, True).alias("ink_key"), L.fidelity_key(F.col("x")).alias("plain_key")
    )


@query("p32_cohort", """
WITH d AS (SELECT source, doc_id, lang, l.doc_id IS NOT NULL AS labelled, substr(sha256('split:42:' || d.doc_id), 1, 1) AS h FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, CASE WHEN NOT labelled THEN []::VARCHAR[] WHEN h < '3' THEN ['test'] WHEN h < '6' THEN ['validation'] WHEN h < '9' THEN ['train'] ELSE ['test', 'train'] END AS splits,
             CASE WHEN lang = 'fr' THEN 'test' WHEN lang = 'es' THEN 'train' END AS declared, lang = 'en' AS verified FROM d)
SELECT lang, CASE WHEN list_contains(splits, 'train') OR list_contains(splits, 'validation') THEN 'excluded_seen_or_validation' WHEN declared = 'test' THEN 'positive_frozen_test'
       WHEN declared IS NOT NULL THEN 'excluded_stage2a_' || declared WHEN splits = ['test'] AND verified THEN 'general_stage1_test'
       WHEN splits = ['test'] THEN 'general_test_structure_match_exploratory' ELSE 'general_unassigned_exploratory' END AS cohort, count(*) AS documents
FROM s GROUP BY lang, cohort""")
def p32(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "lang")
    seen = B.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    h = F.substr(H.tagged_hash("split:42:", F.col("doc_id")), F.lit(1), F.lit(1))
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    splits = (
        F.when(F.col("labelled").isNull(), F.array().cast("array<string>")).when(h < "3", arr("test")).when(h < "6", arr("validation"))
        .when(h < "9", arr("train")).otherwise(arr("test", "train"))
    )
    declared = F.when(F.col("lang") == "fr", "test").when(F.col("lang") == "es", "train")
    named = docs.join(seen, "doc_id", "left").select("lang", L.cohort(splits, declared, F.col("lang") == "en").alias("cohort"))
    return named.groupBy("lang", "cohort").agg(F.count(F.lit(1)).alias("documents"))


@query("p33_length_group", with_ctes("""
SELECT CASE WHEN m <= 4 THEN 'short_le4' WHEN m < 65 THEN 'medium_5_to64' ELSE 'long_ge65' END AS length_group, CASE WHEN n = 1 THEN 'single_row' ELSE 'multi_row' END AS row_group, count(*) AS pages
FROM (SELECT page, count(*) AS n, max(greatest(length(ltrim(upper)), length(count), length(ltrim(lower)))) AS m FROM notation GROUP BY page) GROUP BY ALL""", B.NOTATION_SQL))
def p33(spark, sf):
    longest = F.max(F.greatest(*[F.length(F.ltrim(F.col(r))) for r in N.ROLES]))
    pages = B.notation(spark, sf).groupBy("page").agg(F.count(F.lit(1)).alias("n"), longest.alias("m"))
    return pages.groupBy(L.length_group(F.col("m")).alias("length_group"), L.row_group(F.col("n")).alias("row_group")).agg(F.count(F.lit(1)).alias("pages"))


@query("p34_validate_samples", with_ctes("""
SELECT issue, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN split <> 'train' THEN 'wrong_split' END, CASE WHEN split <> 'train' THEN 'invalid_image_path' END, CASE WHEN split <> 'train' THEN 'invalid_label_path' END,
    CASE WHEN training_label = '' THEN 'empty_training_labels' END, CASE WHEN unknown_characters <> '' THEN 'unknown_characters' END,
    CASE WHEN split = 'train' AND training_label = '' THEN 'missing_images' END, CASE WHEN split = 'train' AND training_label = '' THEN 'missing_labels' END,
    CASE WHEN NOT ctc_feasible THEN 'ctc_infeasible' END, CASE WHEN label_status <> 'ok' THEN 'source_status_not_ok' END], lambda x: x IS NOT NULL)) AS issue FROM tiers) GROUP BY issue""", B.TIERS_SQL))
def p34(spark, sf):
    """All tiers validated as if they were the training split; empty lines have no files."""
    t = B.tiers(spark, sf)
    files = t.where("training_label <> ''").select(F.explode(F.array("image_path", "label_path")).alias("path"))
    return A.sample_issues(t, "train", N.VOCABULARY, files).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("a04_recognition_metrics", with_ctes("""
SELECT role, count(*) AS samples, count(*) FILTER (WHERE exact) AS exact_matches, sum(edits)::BIGINT AS edits, sum(characters)::BIGINT AS characters,
       round(sum(edits) / sum(characters)::DOUBLE, 6) AS cer, round(count(*) FILTER (WHERE exact) / count(*)::DOUBLE, 6) AS exact_accuracy FROM scored GROUP BY role""", B.READINGS_SQL))
def a04(spark, sf):
    """Error rate and exact rate of all readings per tier (flagship)."""
    m = recognition_metrics(score_pairs(B.readings(spark, sf)), ["role"])
    return m.withColumn("cer", F.round("cer", 6)).withColumn("exact_accuracy", F.round("exact_accuracy", 6))
