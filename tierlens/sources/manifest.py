"""Manifest tables as CSV or Parquet, report sinks, subsets and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tierlens.functions.hashing import record_hash

# Column names and order of the tier manifest.
MANIFEST_COLUMNS = (
    "split", "tier_id", "image_path", "label_path", "raw_label", "training_label", "tier_name", "image_width",
    "image_height", "resized_width", "label_length", "parent_image_id", "row_id", "row_index", "tier_index",
    "leading_offset", "raw_label_length", "ctc_required_timesteps", "crnn_output_length", "ctc_feasible",
    "unknown_characters", "image_status", "label_status",
)
_INTS = {
    "image_width", "image_height", "resized_width", "label_length", "row_index", "tier_index", "leading_offset",
    "raw_label_length", "ctc_required_timesteps", "crnn_output_length",
}
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c in _INTS else T.BooleanType() if c == "ctc_feasible" else T.StringType())
        for c in MANIFEST_COLUMNS
    ]
)
# Labels carry meaning in their spaces: without these options Spark trims them
# and turns empty text into null.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8", "lineSep": "\n",
}


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST_SCHEMA, fmt: str = "csv") -> DataFrame:
    """Manifest scan with an explicit schema; a byte-order mark is skipped."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).options(enforceSchema="false", mode="FAILFAST", **CSV_OPTIONS).csv(path)


def write_subset(df: DataFrame, path: str, order: Sequence[str] = ("split", "tier_id"), files: int | None = None) -> None:
    """Ordered CSV with every field quoted; an existing target is an error.

    Rows are range-partitioned, so file order is key order on any cluster size.
    """
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").options(quoteAll="true", **CSV_OPTIONS).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Columnar manifest partitioned by split, for partition pruning."""
    df.repartitionByRange("split", "tier_id").sortWithinPartitions("split", "tier_id").write.mode("errorifexists").partitionBy("split").parquet(path)


def readback_differences(written: DataFrame, read: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records lost or gained by a write and read, with their number (duplicates count).

    Records are compared by the hash of all their columns, so texts do not
    travel through the shuffle, and the hashes travel as 32 bytes each.
    """
    signed = [
        df.select(*keep, F.unhex(record_hash(df)).alias("record"), F.lit(sign).alias("_s"))
        for df, sign in ((written, 1), (read.select(*written.columns), -1))
    ]
    both = signed[0].unionByName(signed[1])
    found = both.groupBy(*keep, "record").agg(F.sum("_s").alias("difference")).where("difference <> 0")
    return found.select(*keep, F.lower(F.hex("record")).alias("record"), "difference")


def file_order_violations(read: DataFrame, order: Sequence[str]) -> DataFrame:
    """Files that start before the previous one ends, in the order of their part numbers.

    Rows are only min/max-ed; one row per file passes one task.  The order inside a file isn't looked at.
    """
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    keyed = read.select(file.alias("file"), F.struct(*order).alias("k"))
    ends = keyed.groupBy("file").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    # part-100000 comes after part-99999
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    return ends.withColumn("_p", F.lag("hi").over(Window.orderBy(number, "file"))).where(F.col("_p") > F.col("lo")).drop("_p")


def nested_as_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, other columns unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report sink: JSON lines, or quoted CSV with nested values as JSON text."""
    if fmt == "json":
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        nested_as_json(df).write.mode("errorifexists").options(quoteAll="true", **CSV_OPTIONS).csv(path)
    else:
        raise ValueError("fmt is json or csv")


def head_subset(df: DataFrame, n: int, order: Sequence[str], key: str, companions: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The first n rows and the companion rows that share their keys."""
    head = df.orderBy(*order).limit(n)
    keys = head.select(key).distinct()
    return {"head": head, **{name: c.join(keys, key, "left_semi") for name, c in companions.items()}}


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of a table: rows, and the sum of each quarter of the record hashes.

    Sums combine map-side, so the whole table needs one tiny shuffle, and equal
    tables give equal values under any partitioning.
    """
    hashed = df.select(record_hash(df).alias("h"))
    quarter = lambda k: F.conv(F.substr("h", F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(quarter(k)), F.lit(0)).cast("string").alias(f"part{k}") for k in range(4)],
    )
