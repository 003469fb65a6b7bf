"""Runs of ordered rows: run-length encoding, gap merging, reduction to k runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tierlens.operators.ranking import numbered_runs, previous_row, running_sum
from tierlens.session import join_null_safe


def run_length(
    df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], value: str, blank: str | None = None
) -> DataFrame:
    """One row per run of equal values: number, value, first and last place, rows.

    Places are 0-based and the end is exclusive; `character_index` counts the
    non-blank runs before this one.
    """
    inked = F.lit(True) if blank is None else F.col(value) != blank
    placed = numbered_runs(df, by, bucket, order, [value], lambda before, now: before[value] != now[value], inked)
    runs = placed.groupBy(*by, "run", value).agg(
        (F.min("place") - 1).alias("start_frame"), F.max("place").alias("end_frame"),
        F.count(F.lit(1)).alias("frames"), (F.max("counted") - 1).alias("_k"),
    )
    return runs.withColumn("character_index", F.col("_k") if blank is None else F.when(F.col(value) != blank, F.col("_k"))).drop("_k")


def merge_runs(runs: DataFrame, by: Sequence[str], bucket: str, start: str, end: str, gap: int) -> DataFrame:
    """Joins neighbouring runs whose distance is at most `gap`."""
    opens = lambda before, now: now[start] - before[end] > gap
    numbered = numbered_runs(runs, by, bucket, [start], [start, end], opens).withColumnRenamed("run", "merged_run")
    return numbered.groupBy(*by, "merged_run").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")
    )


def reduce_runs(runs: DataFrame, by: Sequence[str], bucket: str, start: str, end: str, k: int) -> DataFrame:
    """Exactly k runs per group by keeping the k-1 widest gaps; groups with fewer runs yield none.

    Merging the smallest gap until k runs are left keeps the widest gaps; of
    equal gaps the later one stays.
    """
    seen = previous_row(runs, by, bucket, [start], [end]).withColumn("_gap", F.col(start) - F.col(f"prev.{end}")).drop("prev")
    widest = Window.partitionBy(*by).orderBy(F.col("_gap").desc_nulls_last(), F.col(start).desc())
    kept = (
        seen.withColumn("_r", F.row_number().over(widest)).where(F.col("_r") <= k)
        .where(F.col("_gap").isNotNull()).where(F.col("_r") <= k - 1)
        .select(*by, F.col(start).alias("_s"), F.lit(1).alias("_keep"))
    )
    enough = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(*by)
    marked = (
        join_null_safe(join_null_safe(runs, enough, by), kept.withColumnRenamed("_s", start), [*by, start], "left")
        .withColumn("_keep", F.coalesce("_keep", F.lit(0)))
    )
    numbered = running_sum(marked, by, bucket, [start], "_keep", "_k")
    return numbered.groupBy(*by, (F.col("_k") + 1).alias("reduced_run")).agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")
    )


def order_violations(df: DataFrame, bucket: str, position: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is smaller than the key of the row before them in file order."""
    seen = previous_row(df, [], bucket, [position], keys)
    return seen.where(F.col("prev").isNotNull() & (F.struct(*keys) < F.col("prev")))


def pad_targets(df: DataFrame, batch: str, ids: str) -> DataFrame:
    """Right-pads id arrays with 0 to the longest of their batch; widths come from one small aggregate."""
    widths = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_w"))
    return join_null_safe(df, widths, [batch]).withColumn("target_length", F.size(ids)).withColumn(
        "padded", F.concat(ids, F.array_repeat(F.lit(0), F.col("_w") - F.size(ids)))
    ).drop("_w")


def flat_targets(df: DataFrame, batch: str, ids: str, order: Sequence[str]) -> DataFrame:
    """(batch, targets, target_lengths): the id arrays of a batch one behind the other, in `order`, and how long each is.

    A batch is what one training step takes, so it fits one row; a null array counts as empty.
    """
    parts = df.select(batch, F.struct(*order, F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType)).alias("_ids")).alias("_p"))
    whole = parts.groupBy(batch).agg(F.sort_array(F.collect_list("_p")).alias("_all"))
    return whole.select(batch, F.flatten(F.transform("_all", lambda p: p["_ids"])).alias("targets"), F.transform("_all", lambda p: F.size(p["_ids"])).alias("target_lengths"))
