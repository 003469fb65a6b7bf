"""Label files, nested annotations and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierlens.functions.bind import let
from tierlens.functions.labels import normalize_newlines, strip_newline_end

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RUN = _struct(symbol=_S, count=_I, direction=_S, encoded_count=_S)
LOGICAL_ROW = _struct(row_index=_I, upper=_S, count_line=_S, lower=_S, runs=T.ArrayType(RUN))
ANNOTATION = _struct(sample_id=_S, rows=_I, cells_per_row=_I, logical_rows=T.ArrayType(LOGICAL_ROW))
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")      # fixed values


def read_annotations(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Page annotations with their nested rows and runs."""
    return spark.read.schema(ANNOTATION).option("multiLine", str(multiline).lower()).option("recursiveFileLookup", "true").json(path)


def annotation_rows(pages: DataFrame) -> DataFrame:
    """One line per notation row; pages without rows stay with null columns."""
    rows = pages.select("sample_id", F.posexplode_outer("logical_rows").alias("row_index", "r"))
    tidy = lambda c: F.regexp_replace(c, r"[ \t]+$", "")
    return rows.select(
        "sample_id", "row_index", tidy(F.col("r.upper")).alias("upper"), tidy(F.col("r.count_line")).alias("count"),
        tidy(F.col("r.lower")).alias("lower"), F.col("r.runs").alias("runs"),
    )


def annotation_runs(pages: DataFrame) -> DataFrame:
    """One line per run."""
    return annotation_rows(pages).select("sample_id", "row_index", F.posexplode_outer("runs").alias("run_index", "run")).select(
        "sample_id", "row_index", "run_index", "run.*"
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per label file: path and text, newlines unified, trailing ones dropped."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), strip_newline_end(normalize_newlines(F.col("value"))).alias("raw_label"))


def file_inventory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Relative path and length of every file below root; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(base), "")
    return reader.load(root).select(relative.alias("path"), "length")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def discover_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples with their split, label path and optional annotation and image siblings.

    Layout `<split>/labels/x.txt`, `<split>/json/x.json`, `<split>/images/x.*`;
    a root without any `labels` folder is read as one flat folder.
    """
    files = file_inventory(spark, root)
    path = F.col("path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    parts = files.select(
        path, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("sample_id"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ending"),
        F.regexp_extract(path, r"^(?:(.*)/)?[^/]+/[^/]+$", 1).alias("base"),
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"),
    )
    nested = parts.where((F.col("folder") == "labels") & (F.col("ending") == "txt"))
    flat = nested.isEmpty()
    if flat:
        parts = parts.where(F.col("folder") == "").withColumn("base", F.lit(""))
    key = ["base", "sample_id"]

    def side(folder: str, endings: tuple[str, ...], out: str) -> DataFrame:
        kept = parts.where(F.col("ending").isin(*endings))
        if not flat:
            kept = kept.where(F.col("folder") == folder)
        return kept.groupBy(*key).agg(F.min("path").alias(out))

    labels = side("labels", ("txt",), "label_path")
    joined = labels.join(side("json", ("json",), "json_path"), key, "left").join(side("images", IMAGE_ENDINGS, "image_path"), key, "left")
    own_name = F.lit(root.rstrip("/").rsplit("/", 1)[-1])
    split = F.when(F.col("base") == "", own_name).otherwise(F.regexp_extract("base", r"([^/]+)$", 1))
    return joined.select("sample_id", split.alias("split"), "label_path", "json_path", "image_path")


def parse_rows(df: DataFrame, key: str, text: str, lines_per_row: int = 4) -> DataFrame:
    """Label texts as notation rows (upper, count, lower, empty separator).

    A missing last separator is tolerated.  A text that does not fit the layout
    gives one row with the reason in `error` and no tiers.
    """
    tidy = lambda c: F.regexp_replace(c, r"[ \t]+$", "")

    def rows(lines: Column) -> Column:
        """The rows of a text, or the one row that says why there are none."""
        filled = F.filter(lines, lambda x, i: (i % lines_per_row == lines_per_row - 1) & x.rlike(r"\S"))
        error = F.when(F.size(lines) % lines_per_row != 0, "line_count").when(F.size(filled) > 0, "separator_not_empty")
        starts = F.sequence(F.lit(0), (F.size(lines) / lines_per_row).cast("int") - 1)
        row = lambda r: F.struct(
            F.lit(None).cast("string").alias("error"), r.alias("row_index"),
            *[tidy(F.get(lines, r * lines_per_row + k)).alias(t) for k, t in enumerate(("upper", "count", "lower"))],
        )
        refused = lambda e: F.array(F.struct(
            e.alias("error"), F.lit(None).cast("int").alias("row_index"), *[F.lit(None).cast("string").alias(t) for t in ("upper", "count", "lower")]
        ))
        return let(error, lambda e: F.when(e.isNotNull(), refused(e)).when(F.size(lines) > 0, F.transform(starts, row)))

    def ended(lines: Column) -> Column:
        """Lines with the last separator, where only that is missing."""
        return F.when(F.size(lines) % lines_per_row == lines_per_row - 1, F.concat(lines, F.array(F.lit("")))).otherwise(lines)

    def split(clean: Column) -> Column:
        return F.when(~clean.rlike(r"\S"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(clean, r"\n\z", ""), "\n"))

    # every step is bound once; columns would be copied into the steps that read them, down to once per line
    parsed = let(let(let(normalize_newlines(F.col(text)), split), ended), rows)
    return df.select(key, F.explode(parsed).alias("r")).select(key, "r.*")


def label_agreement(text_rows: DataFrame, json_rows: DataFrame, key: str) -> DataFrame:
    """Rows on which the label text and the annotation disagree, in count or content."""
    a = text_rows.select(key, "row_index", F.struct("upper", "count", "lower").alias("t"))
    b = json_rows.select(key, "row_index", F.struct("upper", "count", "lower").alias("j"))
    state = F.when(F.col("t").isNull(), "only_in_json").when(F.col("j").isNull(), "only_in_text").when(F.col("t") != F.col("j"), "text_differs")
    return a.join(b, [key, "row_index"], "full_outer").select(key, "row_index", state.alias("state")).where("state is not null")


def unpivot_tiers(rows: DataFrame, row_id: str, keep: list[str]) -> DataFrame:
    """One line per non-blank tier with tier_id `<row>_<tier>` and tier_index."""
    long = rows.unpivot([row_id, *keep], ["upper", "count", "lower"], "tier_name", "raw_label")
    place = F.array_position(F.array(F.lit("upper"), F.lit("count"), F.lit("lower")), F.col("tier_name")) - 1
    return long.where(F.regexp_replace("raw_label", r"\s+", "") != "").select(
        F.concat_ws("_", row_id, "tier_name").alias("tier_id"), row_id, *keep, "tier_name", place.cast("int").alias("tier_index"), "raw_label"
    )


